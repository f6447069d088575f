"""Table profiling: shape, missing cells, column kinds, target statistics, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import is_missing, present, require_columns


def numeric_columns(df: DataFrame, rule: str = "any") -> list[str]:
    """``any``: every numeric width. ``strict64``: only 64-bit integers and doubles."""
    if rule == "strict64":
        kinds: tuple = (T.LongType, T.DoubleType)
    elif rule == "any":
        kinds = (T.NumericType,)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame, rule: str = "any") -> list[str]:
    """``any``: strings only. ``strict64``: whatever is not a 64-bit number."""
    if rule == "strict64":
        numeric = set(numeric_columns(df, rule))
        return [c for c in df.columns if c not in numeric]
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def _unpivot_wide(wide: DataFrame, columns: list[str], measures: list[str]) -> DataFrame:
    """One aggregated row with ``<measure>_<i>`` columns to one row per column."""
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("ordinal"),
            F.lit(c).alias("column"),
            *[F.col(f"{m}_{i}").alias(m) for m in measures],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def profile_missing(df: DataFrame, *, top: int | None = None) -> DataFrame:
    """Missing cells per column and in total, from one pass over the table.

    With ``top`` only the first ``top`` columns, in column order, that have any are returned.
    """
    wide = df.agg(*[F.count_if(is_missing(df, c)).alias(f"n_missing_{i}") for i, c in enumerate(df.columns)])
    total = sum((F.col(f"n_missing_{i}") for i in range(1, len(df.columns))), F.col("n_missing_0"))
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("ordinal"),
            F.lit(c).alias("column"),
            F.col(f"n_missing_{i}").alias("n_missing"),
            total.alias("n_missing_total"),
        )
        for i, c in enumerate(df.columns)
    ]
    out = F.array(*rows)
    if top is not None:
        out = F.slice(F.filter(out, lambda r: r["n_missing"] > 0), 1, top)
    return wide.select(F.inline(out))


def profile_types(df: DataFrame, *, rule: str = "any") -> DataFrame:
    """Kind of each column under a rule, with the number of cells that carry a value."""
    numeric, categorical = set(numeric_columns(df, rule)), set(categorical_columns(df, rule))
    wide = df.agg(*[F.count_if(~is_missing(df, c)).alias(f"n_present_{i}") for i, c in enumerate(df.columns)])
    kinds = {c: "numeric" if c in numeric else "categorical" if c in categorical else "other" for c in df.columns}
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("ordinal"),
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("kind"),
            F.col(f"n_present_{i}").alias("n_present"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def profile_numeric_target(df: DataFrame, *, col: str, approx: bool = False) -> DataFrame:
    require_columns(df, col)
    value = present(df, col)
    distinct = F.approx_count_distinct(value) if approx else F.countDistinct(value)
    return df.agg(
        distinct.cast("long").alias("n_distinct"),
        F.min(value).cast("double").alias("min_value"),
        F.max(value).cast("double").alias("max_value"),
        F.avg(value).alias("mean_value"),
    )


def profile_categorical_target(df: DataFrame, *, col: str, max_distinct: int = 10, top: int = 3) -> DataFrame:
    """Number of classes and, when there are few, the most frequent ones (ties by class)."""
    require_columns(df, col)
    n_distinct = df.agg(F.countDistinct(F.col(col))).scalar()
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("class")).agg(F.count("*").alias("n"))
    head = counts.orderBy(F.desc("n"), F.asc("class")).limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("class")))
    few = F.col("n_distinct") <= max_distinct
    return (
        head.withColumn("rank", rank.cast("long"))
        .withColumn("n_distinct", n_distinct)
        .where(few | (F.col("rank") == 1))
        .select("n_distinct", F.when(few, F.col("class")).alias("class"), F.when(few, F.col("n")).alias("n"), "rank")
    )


def preview(df: DataFrame, *, n: int = 5, key: str | list[str]) -> DataFrame:
    """First ``n`` rows by an explicit key; ``n`` is clamped to 1..20."""
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, *keys)
    return df.orderBy(*keys).limit(max(1, min(20, n)))


def profile_preview_columns(df: DataFrame, *, n: int = 5, key: str | list[str]) -> DataFrame:
    """Per column of the preview: type, rows, non-missing and distinct values."""
    head = preview(df, n=n, key=key)
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.lit(1)).alias(f"n_rows_{i}"))
        aggs.append(F.count(present(df, c)).alias(f"n_present_{i}"))
        aggs.append(F.countDistinct(present(df, c)).alias(f"n_distinct_{i}"))
    out = _unpivot_wide(head.agg(*aggs), df.columns, ["n_rows", "n_present", "n_distinct"])
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return out.withColumn("dtype", types[F.col("column")])


def context_sample(df: DataFrame, *, n: int = 3, key: str | list[str]) -> DataFrame:
    """What a prompt about a table needs, in long form: the first rows, the column types and
    the missing cells of the first ten columns."""
    head = preview(df, n=n, key=key)
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.orderBy(*keys))
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]
    rows = head.withColumn("_r", rank.cast("string")).select(
        F.concat(F.lit("row "), "_r").alias("section"), F.inline(F.array(*cells))
    )
    missing = profile_missing(df)
    counts = missing.where(F.col("ordinal") < 10).select(
        F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("n_missing").cast("string").alias("value")
    )
    types = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    dtypes = missing.select(F.lit("type").alias("section"), F.col("column").alias("name"), types[F.col("column")].alias("value"))
    return rows.unionByName(dtypes).unionByName(counts)


def task_gate(df: DataFrame, *, target: str, task: str, max_classes: int = 20) -> DataFrame:
    """May the target be used for the task? Classification refuses a numeric target with many
    distinct values, regression refuses a target that is not numeric."""
    require_columns(df, target)
    numeric = target in numeric_columns(df)
    out = df.agg(F.countDistinct(present(df, target)).alias("n_distinct"))
    if task == "classification":
        refused = (F.col("n_distinct") > max_classes) & F.lit(numeric)
    elif task == "regression":
        refused = F.lit(not numeric)
    else:
        raise ValueError(f"unknown task {task!r}")
    return out.select(
        F.lit(target).alias("target"), F.lit(task).alias("task"), "n_distinct", (~refused).alias("allowed")
    )


def value_distribution(df: DataFrame, *, col: str) -> DataFrame:
    require_columns(df, col)
    total = df.agg(F.count("*")).scalar()
    return (
        df.groupBy(F.col(col).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("pct", F.col("n") * 100.0 / total)
    )


def filter_by_subtype(df: DataFrame, *, subtype: str, item: str = "metadata") -> DataFrame:
    """Items whose nested content subtype matches; items without one never do."""
    return df.where(F.col(f"{item}.content_metadata.subtype") == subtype)


def last_item(df: DataFrame, *, order: str) -> DataFrame:
    """The last row in an order, found by aggregation rather than a sort."""
    fields = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.max_by(fields, order).alias("_last")).where(F.col("_last").isNotNull()).select("_last.*")


def modality_counts(df: DataFrame, *, image: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col(image).isNotNull()).alias("n_with_image"),
        F.count_if(F.col(image).isNull()).alias("n_text_only"),
    )


def select_pages(df: DataFrame, *, start: int = 0, stop: int, page: str = "page") -> DataFrame:
    """Half-open slice of 0-based page ordinals; a short document gives what it has."""
    return df.where((F.col(page) >= start) & (F.col(page) < stop))
