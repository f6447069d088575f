"""Strict JSON test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(col: Column) -> Column:
    """True for text that is exactly one JSON value.

    Spark's parser ignores what follows the first value. Wrapped in brackets and again as a
    member, such a remainder breaks at least one of the two.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), col, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), col, F.lit("}")))
    return in_list.isNotNull() & in_object.isNotNull()
