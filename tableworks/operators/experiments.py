"""Queries over the experiment log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LOWER_IS_BETTER, METRIC_ALIASES


def resolve_metric(name: str) -> tuple[str, bool]:
    """Logged name of a metric, and whether a higher value is better.

    Prefixed names such as ``test_rmse`` follow the metric they contain.
    """
    logged = METRIC_ALIASES.get(name.lower(), name)
    return logged, not any(part in LOWER_IS_BETTER for part in logged.lower().split("_"))


def exp_best(log: DataFrame, *, metric: str) -> DataFrame:
    """The record with the best value; the earliest wins a tie; records without it are skipped."""
    logged, higher = resolve_metric(metric)
    score = F.col("metrics")[logged]
    scored = log.withColumn("score", score).where(F.col("score").isNotNull())
    best = F.desc("score") if higher else F.asc("score")
    return scored.orderBy(best, F.asc_nulls_last("timestamp"), F.asc("model")).limit(1)


def exp_recent(log: DataFrame, *, limit: int = 10) -> DataFrame:
    """Newest first; a record without a time stamp counts as the oldest."""
    return log.orderBy(F.desc(F.coalesce("timestamp", F.lit(0.0))), F.asc("model")).limit(limit)


def exp_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_experiments"))
