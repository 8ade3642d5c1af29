"""Comparable forms of text, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
_INVISIBLE = r"[\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]+"


def plain_text(c: Column) -> Column:
    """Text without invisible characters, wide forms, markup tags and character references."""
    c = F.translate(F.regexp_replace(c, _INVISIBLE, ""), _WIDE, _NARROW)
    c = F.regexp_replace(c, r"(?i)</?(?:p|br|div|li|ul|ol|td|tr|table|h[1-6]|blockquote)\b[^<>]*>", " ")
    c = F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", "")
    return F.regexp_replace(c, r"&(?:#\d{1,6}|#[xX][0-9A-Fa-f]{1,5}|[A-Za-z]{2,8});", " ")


def words(c: Column) -> Column:
    """Runs of letters, marks and digits of plain text, in the case they have; apostrophes within words vanish."""
    return F.regexp_extract_all(F.regexp_replace(plain_text(c), r"(?<=\p{L})['’](?=\p{L})", ""), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def norm_words(c: Column) -> Column:
    """words in lower case."""
    return words(F.lower(c))
