"""Scores of predictions, from plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification_metrics(df: DataFrame, *, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted F1 (0 for a class where it is undefined).

    Rows are counted into a confusion table first, so hot classes cost nothing extra.
    """
    confusion = df.groupBy(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("l").alias("c"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
                F.struct(F.col("p").alias("c"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
            )
        )
    )
    classes = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("support") + F.col("predicted")), F.lit(0.0))
    return classes.agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def regression_metrics(df: DataFrame, *, label: str, prediction: str) -> DataFrame:
    y, error = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction).cast("double")
    sums = df.agg(
        F.count("*").alias("n"),
        F.sum(error * error).alias("sse"),
        F.sum(F.abs(error)).alias("sae"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
    )
    return sums.select(
        "n",
        (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
        F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"),
        F.try_divide(F.col("sae"), F.col("n")).alias("mae"),
    )


def prediction_summary(df: DataFrame, *, task: str, prediction: str = "predictions") -> DataFrame:
    """Class counts for classification; mean, population spread and range for regression."""
    if task == "classification":
        total = df.agg(F.count("*")).scalar()
        return df.groupBy(F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n")).withColumn(
            "n_total", total
        )
    if task == "regression":
        p = F.col(prediction).cast("double")
        return df.agg(
            F.count("*").alias("n_total"),
            F.avg(p).alias("mean"),
            F.stddev_pop(p).alias("std"),
            F.min(p).alias("min"),
            F.max(p).alias("max"),
        )
    raise ValueError(f"unknown task {task!r}")
