"""Oversized texts cut at natural boundaries.

One regular expression with bounded quantifiers takes a text apart: its alternatives are ordered by the strength of the
boundary they end at, each consumes as much as the limit allows, and single characters are the last resort. Array
functions turn the parts into pieces that repeat the end of what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 400, 40, 4

_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_BREAKS = [r"\n[ \t]{0,4}\n", r"\n", r"[.!?…][\"'”’)\]]?" + _SPACE + "|[。！？]", r"[,;:]" + _SPACE, _SPACE]


def max_chars(tokens: int) -> int:
    """Most characters whose estimate, floor(characters / 4), is within the tokens."""
    return (tokens + 1) * CHARS_PER_TOKEN - 1


def parts_pattern(body: int) -> str:
    """Alternatives by strength of boundary, in the upper half of the room first, then in all of it, then characters."""
    half = max(1, body // 2)
    ends = [f".{{1,{body}}}\\z"] + [f".{{{lo},{body}}}(?<={b})" for lo in (half, 1) for b in _BREAKS]
    return "(?s)" + "|".join([*ends, f".{{1,{body}}}"])


def oversized(content: Column, limit: int = LIMIT_TOKENS) -> Column:
    return F.floor(F.length(content) / CHARS_PER_TOKEN) > limit


def split_oversized(df: DataFrame, id_col: str = "turn_id", text: str = "content", limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """(id, forced, pieces): pieces is ARRAY<STRUCT<piece_no, start, new_from, text>> of each text over the limit.

    Each piece is within the limit; piece n > 0 begins with the overlap's characters before new_from; texts of pieces
    from new_from on, put together, are the content again. forced is 1 if one stretch without white space or 。！？ is
    itself over the limit. Texts within the limit, empty and NULL texts and NULL ids give no row. Repeated rows give
    one row; rows of one id with different texts give one each. A text is matched once, and each piece costs its own
    length, so work grows with the length of a text.
    """
    back = overlap * CHARS_PER_TOKEN
    room = max_chars(limit) - back
    if room < 1:
        raise ValueError("the overlap must leave room within the limit")
    few = 2 * -(-back // max(1, room - 1))
    d = df.select(F.col(id_col), F.col(text).alias("_t")).where(F.col(id_col).isNotNull() & oversized(F.col("_t"), limit))

    def pieces(parts: Column) -> Column:
        # Offsets of the parts: one pass over their lengths.
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))

        def of(at: Column) -> Column:
            # A part of less than half of the room comes before a stretch without a boundary, which fills the rest of the
            # room: each two parts fill it, so few parts hold the overlap, and the text isn't searched from its start.
            before = lambda i: F.right(F.concat(*[F.coalesce(F.get(parts, i - k), F.lit("")) for k in range(few, 0, -1)]), F.lit(back))
            return F.transform(parts, lambda x, i: F.struct(i.alias("piece_no"), (F.get(at, i) - F.least(F.lit(back), F.get(at, i))).alias("start"), F.get(at, i).alias("new_from"), (F.concat(before(i), x) if back else x).alias("text")))

        return F.flatten(F.transform(F.array(ends), of))

    # Lists of one bind the parts and their offsets, so that no piece works them out again.
    cut = F.flatten(F.transform(F.array(F.regexp_extract_all("_t", F.lit(parts_pattern(room)), F.lit(0))), pieces))
    stretch = F.col("_t").rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}。！？]{" + str(max_chars(limit) + 1) + "}")
    return d.select(id_col, stretch.cast("int").alias("forced"), cut.alias("pieces"))


def piece_rows(df: DataFrame, id_col: str = "turn_id", text: str = "content", limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """split_oversized with one row per piece, each piece once."""
    cut = split_oversized(df, id_col, text, limit, overlap)
    return cut.select(id_col, "forced", F.inline("pieces")).distinct()


def oversized_turns(turns: DataFrame) -> DataFrame:
    """(turn_id, forced) of the turns that come out in more than one piece: those with a second piece."""
    return split_oversized(turns).select("turn_id", "forced", F.inline(F.slice("pieces", 2, 1))).select("turn_id", "forced").distinct()
