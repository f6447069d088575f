"""Personal data in texts: candidates by expression, checks by arithmetic, spans that do not overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, each_match

#: Kinds in the order of their priority, with the expression for candidates. An earlier kind takes its characters from later ones.
PATTERNS = {
    "SECRET": r"(?i:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*\"?[A-Za-z0-9+/_.-]{8,}\"?",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "IBAN": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "CARD": r"[0-9](?:[ -]?[0-9]){12,}",
    "SSN": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "PHONE": r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "IP": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ACCOUNT": r"[0-9]{12,}",
}
KINDS = list(PATTERNS)
#: Characters that no text may carry (Unicode noncharacters) mark found spans: one per kind for its first character, one for the rest.
FIRST, REST = 0xFDD0, 0xFDEF


def luhn(digits: Column) -> Column:
    """Whether the check digit of a card number is right: from the right, every second digit doubled, digits summed."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code is right: its first four characters moved to the end and letters read as 10 to 35, it leaves 1 over 97."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        value = F.when((c >= "0") & (c <= "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "IBAN":
        return mod97(hit)
    if kind == "CARD":
        digits = F.regexp_replace(hit, "[ -]", "")
        return F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)
    if kind == "SSN":
        return ~(F.substr(hit, F.lit(1), F.lit(3)).isin("000", "666") | hit.startswith("9") | F.substr(hit, F.lit(5), F.lit(2)).isin("00") | hit.endswith("0000"))
    if kind == "IP":
        return F.forall(F.split(hit, r"\."), lambda x: x.cast("int") <= 255)
    return F.lit(True)


def masked(text: Column) -> Column:
    """The text with each character of personal data replaced by a mark, kind after kind, so that lengths and places stay."""
    work = F.regexp_replace(text, f"[{chr(FIRST)}-{chr(REST)}]", "�")
    for kind, pattern in PATTERNS.items():
        work = each_match(work, pattern, _marker(kind))
    return work


def _marker(kind: str) -> Callable[[Column], Column]:
    first, rest = chr(FIRST + KINDS.index(kind)), chr(REST)

    def mark(hit: Column) -> Column:
        return F.when(_valid(kind, hit), F.concat(F.lit(first), F.repeat(F.lit(rest), F.length(hit) - 1))).otherwise(hit)

    return mark


SPAN = f"[{chr(FIRST)}-{chr(FIRST + len(KINDS) - 1)}]{chr(REST)}*"


def redacted(marks: Column) -> Column:
    """A masked text with the name of its kind in place of each span."""
    for k, kind in enumerate(KINDS):
        marks = F.regexp_replace(marks, f"{chr(FIRST + k)}{chr(REST)}*", f"[{kind}]")
    return marks


def pieces(marks: Column) -> Column:
    """array<struct<gap, kind, size>>: the spans of a masked text in order, with the characters before each since the last one."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def spans(m: Column) -> Column:
        hits = F.regexp_extract_all(m, F.lit(SPAN), F.lit(0))
        gaps = F.transform(F.split(m, SPAN, -1), F.length)
        return F.zip_with(
            F.slice(gaps, 1, F.size(hits)), hits,
            lambda gap, hit: F.struct(gap.cast("long").alias("gap"), F.get(kinds, F.ascii(hit) - FIRST).alias("kind"), F.length(hit).cast("long").alias("size")),
        )

    return bound(marks, spans)
