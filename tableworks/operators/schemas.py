"""Does a text column hold JSON of one schema: the merged schema of all rows, and where a row departs from a given one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import is_json

#: What a JSON scalar may be to pass as a type: whole numbers pass as any number, anything passes as null.
_NUMBER = r"^(BIGINT|DOUBLE|DECIMAL.*)$"
SCALARS = {T.LongType: r"^BIGINT$", T.IntegerType: r"^BIGINT$", T.DoubleType: _NUMBER, T.StringType: r"^STRING$", T.BooleanType: r"^BOOLEAN$"}


def _parsed(text: Column) -> Column:
    """The value of a JSON text; null where it is none, or has anything behind its first value."""
    return F.when(is_json(text), F.try_parse_json(text))


def infer_schema(df: DataFrame, *, text: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n_rows, n_json, schema): the least schema that all JSON texts of a group fit.

    Types form a lattice (null below whole below decimal numbers, strings and booleans beside them, all below any; objects join their fields,
    arrays their elements), so schemas merge in any order and each task sends one per group.
    """
    parsed = df.select(*(by or []), _parsed(F.col(text)).alias("_v"))
    return parsed.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.count("_v").alias("n_json"), F.schema_of_variant_agg("_v").alias("schema"))


def _departs(value: Column, kind: T.DataType, path: str, required: bool) -> Column:
    """The first path at which a value is not of a type, or null. Paths of array elements are those of the array with []."""
    name = F.schema_of_variant(value)
    absent = value.isNull() | (name == "VOID")
    if isinstance(kind, T.StructType):
        inner = [_departs(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, f"{path}.{f.name}", not f.nullable) for f in kind.fields]
        bad = F.when(~name.startswith("OBJECT"), path).otherwise(F.coalesce(*inner, F.lit(None).cast("string")))
    elif isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        found = F.filter(F.transform(items, lambda x: _departs(x, kind.elementType, f"{path}[]", not kind.containsNull)), lambda p: p.isNotNull())
        bad = F.when(~name.startswith("ARRAY"), path).otherwise(F.get(found, F.lit(0)))
    else:
        bad = F.when(~F.regexp_like(name, F.lit(SCALARS[type(kind)])), path)
    return F.when(absent, F.lit(path if required else None).cast("string")).otherwise(bad)


def schema_check(df: DataFrame, *, text: str, schema: T.StructType, out: str = "failed_path") -> DataFrame:
    """Adds the first path at which a row's JSON departs from ``schema``, in the order of its fields; null where it fits, ``$`` where the
    text is no JSON object. Fields that are not nullable have to be there; further fields do no harm. A null text is no JSON."""
    value = _parsed(F.col(text))
    return df.withColumn(out, F.when(value.isNull(), "$").otherwise(_departs(value, schema, "$", True)))
