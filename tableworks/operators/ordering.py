"""Ranks and carried values over groups of any size.

A plain window sorts each group in one task, and one group may hold a third of all rows. The
functions here cut a group into buckets along its order, let a window work inside
(group, bucket), and carry what earlier buckets contribute through a small per-bucket table.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 4096
MAX_RANGES = 8192
ROWS_PER_RANGE = 250_000
MAX_DIGITS = 6
#: Partitions for each core of rows that many passes read, and rows of a partition above which there are more.
PARTS_PER_CORE = 2
ROWS_PER_PART = 2_000_000


def _bucket_of(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {width}")


def fail_on_null(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a null group key would vanish in the joins below, so they stop the job instead."""
    return df.withColumns(
        {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in key column {c}"))).otherwise(F.col(c)) for c in cols}
    )


def _add_offsets(
    df: DataFrame, by: list[str], bucket: str, order: list[Column], out: str, small: bool, total: str | None = None,
    any_of: tuple[str, Column] | None = None,
) -> DataFrame:
    """1-based rank inside ``by`` from the count of earlier buckets plus the rank in its own.

    ``small`` says that the number of buckets has a fixed bound, so their table may be broadcast.
    ``any_of`` adds a column that tells whether a condition holds for any row of the group.
    """
    flag = [F.max(any_of[1]).alias("_any")] if any_of else []
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias("_n"), *flag)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *([F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []),
        *([F.coalesce(F.max("_any").over(Window.partitionBy(*by)), F.lit(False)).alias(any_of[0])] if any_of else []),
    )
    if small:
        offsets = F.broadcast(offsets)
    inner = Window.partitionBy(*by, bucket).orderBy(*order)
    return (
        df.join(offsets, [*by, bucket])
        .withColumn(out, (F.row_number().over(inner) + F.col("_off")).cast("long"))
        .drop("_off", bucket)
    )


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows, stored or cached, in partitions for all cores but not many more, for fits that pass over them often.

    Each partition of a pass costs a task, and in a forest the sums of all nodes of a level, however few its rows are. Rows are
    dealt one by one in their order, so partitions are even and the same in every run. Enough partitions and not too many stay as they are.
    """
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    most = PARTS_PER_CORE * cores
    if cores <= parts <= most:
        return rows
    wanted = cores if parts < cores else max(most, rows.count() // ROWS_PER_PART)
    if most < parts <= wanted:
        return rows
    placed = rows.withColumns({"_i": F.monotonically_increasing_id(), "_p": F.spark_partition_id()})
    turn = (F.col("_i").bitwiseAND((1 << 33) - 1) + F.col("_p")) % wanted
    return placed.withColumn("_p", turn.cast("int")).repartitionById(wanted, "_p").sortWithinPartitions("_i").drop("_i", "_p")


def rank_by_hash(
    df: DataFrame, *, hash_col: str, by: list[str] | None = None, tie: list[str] = (), out: str, total: str | None = None, rows: int
) -> DataFrame:
    """1-based rank by a hexadecimal hash column, and the size of the group if ``total`` is named.

    Leading digits are the bucket; there are as many as keep a bucket of a table with ``rows``
    rows near ``ROWS_PER_RANGE``, whatever the sizes of the groups.
    """
    digits = 1
    while digits < MAX_DIGITS and rows > ROWS_PER_RANGE * 16**digits:
        digits += 1
    work = fail_on_null(df, *(by or []), hash_col).withColumn("_b", F.substring(hash_col, 1, digits))
    order = [F.col(hash_col), *[F.col(c) for c in tie]]
    return _add_offsets(work, list(by or []), "_b", order, out, small=not by and digits <= 4, total=total)


def global_position(df: DataFrame, *, key: str, out: str, rows: int | None = None) -> DataFrame:
    """0-based position in the order of a numeric, unique key over the whole table.

    Range borders come from one quantile sketch and are literals in the plan, so they stay the
    same when a task is run again.
    """
    rows = df.count() if rows is None else rows
    ranges = max(1, min(MAX_RANGES, rows // ROWS_PER_RANGE))
    if ranges == 1:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))
    work = fail_on_null(df, key).withColumn("_kd", F.col(key).cast("double"))
    borders = sorted(set(work.approxQuantile("_kd", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    splits = [-float("inf"), *borders, float("inf")]
    work = Bucketizer(splits=splits, inputCol="_kd", outputCol="_b").transform(work)
    ranked = _add_offsets(work, [], "_b", [F.col(key)], out, small=True)
    return ranked.withColumn(out, F.col(out) - 1).drop("_kd")


def position_in_group(
    df: DataFrame, *, by: list[str], order: str, out: str, width: int = BUCKET_WIDTH, any_of: tuple[str, Column] | None = None,
    total: str | None = None,
) -> DataFrame:
    """0-based position in each group, ordered by an integral column that is unique per group.

    ``total`` names a column for the size of the group, ``any_of`` one that tells whether a
    condition holds for any of its rows.
    """
    work = fail_on_null(df, *by, order).withColumn("_b", _bucket_of(order, width))
    ranked = _add_offsets(work, by, "_b", [F.col(order)], out, small=False, total=total, any_of=any_of)
    return ranked.withColumn(out, F.col(out) - 1)


def last_value_before(
    df: DataFrame, *, by: list[str], order: str, value: str, out: str, inclusive: bool = False, width: int = BUCKET_WIDTH,
    segment: str | None = None,
) -> DataFrame:
    """Last non-null ``value`` before each row (or up to it), ordered by an integral column.

    ``segment`` keeps the bucket number under that name and adds ``<segment>_is_last``. Rows are
    already partitioned by it, so grouping by it next needs no shuffle.
    """
    bucket = segment or "_b"
    work = fail_on_null(df, *by, order).withColumn(bucket, _bucket_of(order, width).cast("long"))
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    heads = work.groupBy(*by, bucket).agg(last.alias("_v"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = [(F.col(bucket) == F.max(bucket).over(Window.partitionBy(*by))).alias(f"{segment}_is_last")] if segment else []
    heads = heads.select(*by, bucket, F.last("_v", ignorenulls=True).over(earlier).alias("_carry"), *ends)
    inner = Window.partitionBy(*by, bucket).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    out_rows = work.join(heads, [*by, bucket]).withColumn(
        out, F.coalesce(F.last(value, ignorenulls=True).over(inner), F.col("_carry"))
    )
    return out_rows.drop("_carry") if segment else out_rows.drop("_b", "_carry")


def join_segments(
    df: DataFrame, *, by: list[str], position: str, parts: dict[str, str], sep: str = "", width: int = BUCKET_WIDTH,
    keep: list[str] = (), numbered: bool = False,
) -> DataFrame:
    """Concatenate text parts in order, ``width`` parts to a row.

    Groups of up to ``width`` parts give one row with segment 0. A longer group gives as many
    rows as it needs, and its segments joined by ``sep`` in order are the whole text. ``parts``
    maps output names to text columns; null parts are left out. ``keep`` are columns with one
    value per segment. ``numbered`` rows bring their ``segment`` with them.
    """
    work = df if numbered else df.withColumn("segment", _bucket_of(position, width).cast("long"))
    texts = []
    for name, col in parts.items():
        items = F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), F.struct(F.col(position), F.col(col).alias("_t")))))
        texts.append(F.array_join(F.transform(items, lambda x: x["_t"]), sep).alias(name))
    return work.groupBy(*by, "segment").agg(*texts, *[F.first(c).alias(c) for c in keep])
