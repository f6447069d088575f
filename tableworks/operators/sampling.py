"""Deterministic splits and folds by hash rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import require_columns
from .ordering import rank_by_hash


def _hash_ranked(df: DataFrame, key: str, by: str | None, seed: int) -> DataFrame:
    require_columns(df, key, *([by] if by else []))
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    return rank_by_hash(hashed, hash_col="_h", by=[by] if by else None, tie=[key], out="_rank", total="_total", rows=df.count()).drop("_h")


def _with_split(ranked: DataFrame, test_size: float) -> DataFrame:
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_total"))
    return ranked.withColumn("split", F.when(F.col("_rank") <= n_test, "test").otherwise("train")).drop("_rank", "_total")


def split_random(df: DataFrame, *, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly ceil(test_size * n) rows are ``test``."""
    return _with_split(_hash_ranked(df, key, None, seed), test_size)


def split_stratified(df: DataFrame, *, key: str, by: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` with the test share taken inside every class."""
    return _with_split(_hash_ranked(df, key, by, seed), test_size)


def _with_fold(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_total")


def kfold(df: DataFrame, *, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1; fold sizes differ by at most one."""
    return _with_fold(_hash_ranked(df, key, None, seed), k)


def kfold_stratified(df: DataFrame, *, key: str, by: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold`` dealt out inside every class."""
    return _with_fold(_hash_ranked(df, key, by, seed), k)
