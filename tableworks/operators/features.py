"""Preparation of table columns for model training, fitted on training rows only."""

from __future__ import annotations

import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .guards import present, require_columns
from .profile import categorical_columns, numeric_columns

DIRECT_ROWS = 1_000_000
RANGES = 500


def medians(df: DataFrame, cols: list[str], *, direct_rows: int = DIRECT_ROWS) -> dict[str, float | None]:
    """Exact interpolated medians.

    The built-in exact median keeps every distinct value in one task, so it is used on at most
    ``direct_rows`` values. Above that a quantile sketch gives a bracket that is certain to hold
    the middle, the rows outside it are only counted, and the bracket is narrowed again.
    """
    if not cols:
        return {}
    clean = df.select(*[present(df, c).cast("double").alias(c) for c in cols])
    sizes = clean.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    small = [c for c in cols if sizes[c] <= direct_rows]
    out: dict[str, float | None] = {}
    if small:
        row = clean.agg(*[F.median(F.col(f"`{c}`")).alias(c) for c in small]).first()
        out.update({c: row[c] for c in small})
    for c in cols:
        if c not in out:
            n = sizes[c]
            values = clean.select(F.col(f"`{c}`").alias("v")).where("v IS NOT NULL")
            lower, upper = _ranked_values(values, n, (n - 1) // 2, n // 2, direct_rows)
            out[c] = (lower + upper) / 2
    return out


def _ranked_values(values: DataFrame, n: int, first: int, second: int, direct_rows: int) -> tuple[float, float]:
    """Values at two equal or neighbouring 0-based ranks of a one-column frame ``v`` with ``n`` rows."""
    v, error = F.col("v"), 0.001
    while n > direct_rows:
        low, high = values.approxQuantile(
            "v", [max(0.0, first / n - 2 * error), min(1.0, (second + 1) / n + 2 * error)], error
        )
        between = (v > low) & (v < high)
        c = values.agg(
            F.count_if(v <= low).alias("upto_low"), F.count_if(between).alias("between"),
            F.min(F.when(between, v)).alias("least"), F.max(F.when(between, v)).alias("most"),
        ).first()

        def place(rank: int) -> float | None:
            if rank < c["upto_low"]:
                return low
            return high if rank >= c["upto_low"] + c["between"] else None

        a, b = place(first), place(second)
        if a is not None or b is not None:
            return (c["most"] if a is None else a), (c["least"] if b is None else b)
        values, n = values.where(between), c["between"]
        first, second = first - c["upto_low"], second - c["upto_low"]
    ranked = values.withColumn("r", F.row_number().over(Window.orderBy("v")) - 1).where(F.col("r").isin(first, second))
    found = {row["r"]: row["v"] for row in ranked.collect()}
    return found[first], found[second]


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value per column as text, the smallest one on a tie; all columns in one grouped pass."""
    if not cols:
        return {}
    pairs = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(cols)]
    counts = df.select(F.inline(F.array(*pairs))).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b"))
    found = {r["i"]: r["b"]["v"] for r in best.collect()}
    return {c: found.get(i) for i, c in enumerate(cols)}


def moments(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation, with 1 in place of a zero spread."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(present(df, c)).alias(f"m{i}"), F.stddev_pop(present(df, c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def impute_median(train: DataFrame, test: DataFrame, *, cols: list[str]) -> DataFrame:
    """``test`` with missing numbers replaced by the medians of ``train``. A column without any
    observed training value is dropped."""
    require_columns(train, *cols)
    fitted = medians(train, cols)
    empty = [c for c in cols if fitted[c] is None]
    return test.withColumns(
        {c: F.coalesce(present(test, c).cast("double"), F.lit(fitted[c])) for c in cols if c not in empty}
    ).drop(*empty)


def impute_mode(train: DataFrame, test: DataFrame, *, cols: list[str]) -> DataFrame:
    """``test`` with missing classes replaced by the most frequent ones of ``train``."""
    require_columns(train, *cols)
    fitted = modes(train, cols)
    empty = [c for c in cols if fitted[c] is None]
    return test.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(fitted[c])) for c in cols if c not in empty}
    ).drop(*empty)


def standardize(train: DataFrame, test: DataFrame, *, cols: list[str]) -> DataFrame:
    require_columns(train, *cols)
    fitted = moments(train, cols)
    return test.withColumns({c: (F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]) for c in cols})


def to_float32(df: DataFrame, *, cols: list[str]) -> DataFrame:
    require_columns(df, *cols)
    return df.withColumns({c: F.col(c).cast("float") for c in cols})


def one_hot_stages(cols: list[str]) -> list:
    """Sorted categories, none dropped; unseen and missing values give a zero vector.

    The indexer gives unknown values one more, last index and the encoder drops the last one.
    """
    if not cols:
        return []
    index = [f"{c}__index" for c in cols]
    return [
        StringIndexer(inputCols=cols, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=[f"{c}__onehot" for c in cols]),
    ]


def one_hot(train: DataFrame, test: DataFrame, *, cols: list[str]) -> DataFrame:
    """``test`` with ``<col>__onehot`` for each column: sorted categories of ``train``, unseen and missing values all zero.

    Any number of categories: they are ranked in a table that is joined, and only their count comes to the driver.
    """
    require_columns(train, *cols)
    out = test
    for c in cols:
        places, n = _category_places(train.select(F.col(f"`{c}`").cast("string").alias("_seen")).where("_seen IS NOT NULL").distinct())
        joined = out.join(places, F.col(f"`{c}`").cast("string") == F.col("_seen"), "left")
        indexed = joined.withColumn(f"{c}__index", F.coalesce("_place", F.lit(n)).cast("double")).drop("_seen", "_place")
        out = _encoder(train.sparkSession, f"{c}__index", f"{c}__onehot", n).transform(indexed).drop(f"{c}__index")
    return out


def _category_places(seen: DataFrame) -> tuple[DataFrame, int]:
    """(_seen, _place): the rank of each distinct text, and their number. About ``RANGES`` texts, picked by a hash, cut the order
    into ranges; a task ranks one range, and the ranges' sizes give the offsets."""
    n = seen.count()
    step = max(1, n // RANGES)
    borders = sorted(r["_seen"] for r in seen.where(F.pmod(F.xxhash64("_seen"), F.lit(step)) == 0).collect()) if step > 1 else []
    area = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b <= F.col("_seen"))) if borders else F.lit(0)
    ranged = seen.withColumn("_range", area)
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    offsets, total = [], 0
    for place, size in sizes:
        offsets.append((place, total))
        total += size
    table = F.broadcast(seen.sparkSession.createDataFrame(offsets or [(0, 0)], "_range INT, _first BIGINT"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_seen")) - 1
    return ranged.withColumn("_r", rank).join(table, "_range").select("_seen", (F.col("_first") + F.col("_r")).alias("_place")), n


def _encoder(spark: SparkSession, column: str, out: str, n: int) -> OneHotEncoderModel:
    """A stock encoder of ``n`` places; index ``n`` gives zeros."""
    gateway = spark.sparkContext._gateway
    sizes = gateway.new_array(gateway.jvm.int, 1)
    sizes[0] = n + 1
    uid = f"OneHotEncoder_{uuid.uuid4().hex[:12]}"
    model = OneHotEncoderModel(gateway.jvm.org.apache.spark.ml.feature.OneHotEncoderModel(uid, sizes))
    model._resetUid(uid)
    return model.setInputCols([column]).setOutputCols([out])


def assemble(df: DataFrame, *, numeric: list[str], categorical: list[str], out: str = "features") -> DataFrame:
    """Numeric block, then categorical block."""
    return VectorAssembler(inputCols=[*numeric, *categorical], outputCol=out).transform(df)


class TableFeaturizer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median and mode imputation, scaling, float rounding, one-hot and assembly in one fit.

    The fitted result is a pipeline of stock stages with the statistics as literals, so it can be
    stored and loaded like any other model. Categories become places of the vector and, as model data, are kept by the driver;
    for columns with more of them than that can hold, ``hashedWidth`` sends all categorical columns to so many hashed places.
    """

    targetCol = Param(Params._dummy(), "targetCol", "target column, left out of the features", TypeConverters.toString)
    numericRule = Param(Params._dummy(), "numericRule", "any or strict64", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    ignoreCols = Param(Params._dummy(), "ignoreCols", "columns that are no features", TypeConverters.toListString)

    hashedWidth = Param(Params._dummy(), "hashedWidth", "places for hashed categories, 0 for one place each", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, targetCol=None, numericRule="strict64", outputCol="features", ignoreCols=(), hashedWidth=0):
        super().__init__()
        self._setDefault(numericRule="strict64", outputCol="features", ignoreCols=[], hashedWidth=0)
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._set(**{**given, "ignoreCols": list(ignoreCols)})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        target, rule = self.getOrDefault(self.targetCol), self.getOrDefault(self.numericRule)
        skip = {target, *self.getOrDefault(self.ignoreCols)}
        numeric = [c for c in numeric_columns(dataset, rule) if c not in skip]
        categorical = [c for c in categorical_columns(dataset, rule) if c not in skip]
        middle, spread, frequent = medians(dataset, numeric), {}, modes(dataset, categorical)
        numeric = [c for c in numeric if middle[c] is not None]
        categorical = [c for c in categorical if frequent[c] is not None]
        filled = dataset.select(*[F.coalesce(present(dataset, c).cast("double"), F.lit(middle[c])).alias(c) for c in numeric])
        spread = moments(filled, numeric)
        exprs = []
        for c in numeric:
            mean, std = spread[c]
            value = f"nanvl(coalesce(cast(`{c}` AS DOUBLE), {middle[c]!r}D), {middle[c]!r}D)"
            exprs.append(f"cast(cast(({value} - {mean!r}D) / {std!r}D AS FLOAT) AS DOUBLE) AS `{c}__scaled`")
        for c in categorical:
            text = frequent[c].replace("\\", "\\\\").replace("'", "\\'")
            exprs.append(f"coalesce(cast(`{c}` AS STRING), '{text}') AS `{c}__filled`")
        prepare = SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")
        texts = [f"{c}__filled" for c in categorical]
        width, encode, encoded = self.getOrDefault(self.hashedWidth), one_hot_stages(texts), [f"{c}__onehot" for c in texts]
        if width and texts:
            encode, encoded = [FeatureHasher(inputCols=texts, outputCol="categories__hashed", numFeatures=width)], ["categories__hashed"]
        assembler = VectorAssembler(inputCols=[f"{c}__scaled" for c in numeric] + encoded, outputCol=self.getOrDefault(self.outputCol))
        return Pipeline(stages=[prepare, *encode, assembler]).fit(dataset)


def fit_transform_features(
    train: DataFrame, test: DataFrame, *, target: str, numeric_rule: str = "strict64", ignore: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train`` alone and give both frames with a ``features`` vector."""
    require_columns(train, target)
    model = TableFeaturizer(targetCol=target, numericRule=numeric_rule, ignoreCols=list(ignore)).fit(train)
    drop = [c for c in model.transform(train.limit(0)).columns if "__" in c]
    return model.transform(train).drop(*drop), model.transform(test).drop(*drop)
