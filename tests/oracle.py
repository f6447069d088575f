"""Side-by-side comparison of a Spark result and DuckDB on the same Parquet tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "quantize"):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value)


def compare(df, con, sql: str) -> list[str]:
    """Differences in column names, row count and values; empty when the results agree."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    order = sorted(names)
    kinds = {c[0]: str(c[1]) for c in result.description}
    types = dict(df.dtypes)
    whole = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c in order:
        want = whole.get(types[c])
        if want and kinds[c] not in (want, '"NULL"'):
            problems.append(f"type of {c}: {types[c]} vs {kinds[c]}")
    theirs = Counter(tuple(normal(row[names.index(c)]) for c in order) for row in result.fetchall())
    ours = Counter(tuple(normal(row[c]) for c in order) for row in df.select(*order).collect())
    if sum(ours.values()) != sum(theirs.values()):
        problems.append(f"rows {sum(ours.values())} vs {sum(theirs.values())}")
    if ours != theirs:
        extra, lacking = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        problems.append(f"only spark: {str(extra)[:900]}\nonly duckdb: {str(lacking)[:900]}")
    return problems
