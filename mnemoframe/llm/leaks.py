"""Evaluation passages inside a corpus, by template windows.

Numbers, names and units become typed placeholders, windows of the template are joined by their hash, and the slots
behind the placeholders tell a verbatim passage from a re-parameterised one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.text import words

WINDOW = 12
#: Bits a key of a filter, and most bits of a filter (512 KB). A fuller filter lets more through and changes no verbatim row.
BITS_PER_KEY, MAX_BITS = 32, 1 << 22
#: Windows of one hash are spread over so many parts of the join.
SALTS = 8

# Units of measure and money.
UNITS = [
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram",
    "kilograms", "ounce", "ounces", "pound", "pounds", "ml", "l", "litre", "litres", "liter", "liters", "percent", "dollar", "dollars", "euro",
    "euros", "usd", "eur", "coin", "coins", "degrees",
]


class KeyFilter:
    """Bloom filter of the 64-bit keys in column h: no key is missed, about one foreign key in a thousand passes.

    The bits are put together by Spark; the driver holds MAX_BITS of them at most, whatever the number of keys.
    """

    def __init__(self, keys: DataFrame):
        n = max(1, keys.count())
        self.bits = min(MAX_BITS, max(1024, 1 << (BITS_PER_KEY * n - 1).bit_length()))
        at = keys.select(F.explode(F.array(*self._places(F.col("h")))).alias("p"))
        rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).collect()
        table = [0] * (self.bits // 64)
        for r in rows:
            table[r["w"]] = r["b"]
        # One text literal, which the optimizer folds to an array once.
        self.table = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def _places(self, h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(self.bits - 1)) for s in (0, 21, 42)]

    def may_have(self, h: Column) -> Column:
        bit = lambda p: F.call_function("getbit", F.get(self.table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        a, b, c = map(bit, self._places(h))
        return a & b & c


def _canonical(w: Column, names: KeyFilter, known: KeyFilter) -> Column:
    """Template of a word array: each word or its placeholder. The same word gets the same on both sides of the join.

    A word of the items is a name if the items say so, whatever its case here; others go by their capital.
    """

    def one(x: Column) -> Column:
        low = F.lower(x)
        h = F.xxhash64(low)
        name = names.may_have(h) | (x.rlike(r"^\p{Lu}") & ~known.may_have(h))
        return F.when(low.rlike(r"^\p{N}+$"), "#n").when(low.isin(UNITS), "#u").when(name, "#p").otherwise(low)

    return F.transform(w, one)


def _windows(df: DataFrame, size: int, keep: KeyFilter | None = None) -> DataFrame:
    """(other columns, h, w): hash and words of each template window, of those whose hash may be in keep."""
    coded = F.transform("_c", lambda x: F.xxhash64(x))
    rest = [c for c in df.columns if c not in ("_w", "_c")]

    def windows(z: Column) -> Column:
        at = F.when(F.size(z) >= size, F.sequence(F.lit(1), F.size(z) - (size - 1)))
        found = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(z, i, size)).alias("h"), i.alias("i")))
        return found if keep is None else F.filter(found, lambda x: keep.may_have(x["h"]))

    # The word hashes are bound once a text, by a list of one, and not computed again for each window.
    d = df.select(*rest, "_w", F.inline(F.flatten(F.transform(F.array(coded), windows))))
    return d.select(*rest, "h", F.transform(F.slice("_w", F.col("i"), size), F.lower).alias("w"))


def leaks(documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, kind, n_windows): kind 'verbatim' or 'reparameterised'.

    verbatim: the document has size consecutive words of the item, whatever case, punctuation, white space, markup,
    invisible and wide characters. reparameterised: such a stretch only with other numbers, names or units, each value
    of the item replaced by one value throughout the window, and the reverse. NULL and empty texts, and texts shorter
    than the window, give no row. One plan at any number of items: their words and windows are filters of bounded size,
    which keep foreign windows out of the join; what passes is joined by hash, spread by salts, and compared exactly.
    """
    it = items.select("item_id", words(F.col("text")).alias("_w"), F.col("text").alias("_t")).where("item_id IS NOT NULL AND _w IS NOT NULL")
    # Names: words that the items write with a capital within sentences and never without.
    inner = F.regexp_extract_all("_t", F.lit(r"(?<=[\p{L}\p{N},;:] )\p{Lu}[\p{L}\p{M}]*"), F.lit(0))
    vocabulary = it.select(F.explode("_w").alias("x")).groupBy(F.xxhash64(F.lower("x")).alias("h")).agg(F.max((F.col("x") == F.lower("x")).cast("int")).alias("small"))
    capital = it.select(F.explode(inner).alias("x")).select(F.xxhash64(F.lower("x")).alias("h")).distinct()
    known = KeyFilter(vocabulary.select("h"))
    names = KeyFilter(capital.join(vocabulary.where("small = 1"), "h", "left_anti"))
    iw = _windows(it.select("item_id", "_w", _canonical(F.col("_w"), names, known).alias("_c")), size).distinct()
    docs = documents.select("doc_id", words(F.col("text")).alias("_w")).where("doc_id IS NOT NULL")
    docs = docs.select("doc_id", "_w", _canonical(F.col("_w"), names, known).alias("_c"))
    dw = _windows(docs, size, KeyFilter(iw.select("h").distinct()))
    iw = iw.select("item_id", "h", F.col("w").alias("iw"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hit = dw.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(iw, ["h", "salt"])
    slots = F.array_distinct(F.arrays_zip(F.col("iw").alias("a"), F.col("w").alias("b")))
    hit = hit.select("doc_id", "item_id", (F.col("w") == F.col("iw")).alias("same"), slots.alias("s"))
    one_to_one = (F.size(F.array_distinct(F.col("s.a"))) == F.size("s")) & (F.size(F.array_distinct(F.col("s.b"))) == F.size("s"))
    out = hit.where(F.col("same") | one_to_one).groupBy("doc_id", "item_id").agg(F.max("same").alias("same"), F.count("*").alias("n_windows"))
    return out.select("doc_id", "item_id", F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"), "n_windows")
