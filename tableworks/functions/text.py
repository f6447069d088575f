"""Text columns: trimming, tokens, chunks, prefixes, truncation, base64."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Instructions in front of texts that go to an embedding model.
PREFIXES = {"passage": "passage: ", "query": "query: "}


# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def words(col: Column) -> Column:
    """Lower-case words and numbers in order."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def prefixed(col: Column, kind: str) -> Column:
    return F.concat(F.lit(PREFIXES[kind]), col)


def fixed_windows(col: Column, size: int, overlap: int) -> Column:
    """Character windows with a fixed step; the last one ends with the text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(col) - overlap) / step) - 1).cast("int"))
    return F.when(
        F.length(col) > 0, F.transform(starts, lambda i: F.substring(col, i * step + 1, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def looks_base64(col: Column) -> Column:
    return (F.length(col) > 100) & (F.instr(F.substring(col, 1, 50), " ") == 0)


def decoded_base64(col: Column) -> Column:
    """Bytes, or null where the text is empty or cannot be decoded."""
    return F.when(F.length(col) > 0, F.try_to_binary(col, F.lit("base64")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each_match(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of ``pattern`` changed."""

    def changed(t: Column) -> Column:
        between, hits = F.split(t, pattern, -1), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        joined = F.array_join(F.zip_with(between, hits, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.regexp_like(t, F.lit(pattern)), joined).otherwise(t)

    return bound(text, changed)
