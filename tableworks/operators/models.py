"""Training, ranking, search and application of models on tables."""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegression, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import metrics as M
from .features import TableFeaturizer
from .forests import validated_forests, with_node_ids
from .guards import require_columns
from .margin import EXACT_WIDTH, Problem, Report, fit_margins
from .ordering import dealt
from .sampling import kfold, kfold_stratified
from .tube import Tube, fit_tubes, sparse_rows

LABEL = "label__"
#: One rule for every least-squares step: Spark solves exactly up to 4096 features and iterates above, here to a tight end.
LEAST_SQUARES = {"solver": "auto", "maxIter": 1000, "tol": 1e-9, "elasticNetParam": 0.0, "standardization": False}


class _PenaltyEstimator(Estimator, HasLabelCol, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Estimators whose Spark penalty depends on the rows being fitted."""

    C = Param(Params._dummy(), "C", "inverse penalty strength", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half width of the free band", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "tolerance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol=LABEL, featuresCol="features", C=1.0, alpha=1.0, epsilon=0.0, maxIter=100, tol=1e-4):
        super().__init__()
        self._setDefault(labelCol=LABEL, featuresCol="features", C=1.0, alpha=1.0, epsilon=0.0, maxIter=100, tol=1e-4)
        self._set(**self._input_kwargs)

    def _cols(self) -> dict:
        return {"labelCol": self.getLabelCol(), "featuresCol": self.getFeaturesCol()}


class PenalizedLogistic(_PenaltyEstimator):
    """Logistic regression with an L2 penalty of 1/C on the summed loss."""

    def _fit(self, dataset):
        n = dataset.count()
        return LogisticRegression(
            **self._cols(), regParam=1.0 / (self.getOrDefault(self.C) * n), elasticNetParam=0.0, standardization=False,
            maxIter=self.getOrDefault(self.maxIter), tol=self.getOrDefault(self.tol),
        ).fit(dataset)


def _margin_model(spark: SparkSession, coefficients: np.ndarray, intercept: float, features: str, raw: str) -> LinearSVCModel:
    """A stock linear model from known coefficients."""
    weights = _py2java(spark.sparkContext, Vectors.dense(coefficients))
    uid = f"LinearSVC_{uuid.uuid4().hex[:12]}"
    ml = spark.sparkContext._jvm.org.apache.spark.ml
    model = LinearSVCModel(ml.classification.LinearSVCModel(uid, weights, float(intercept)))
    return model.setFeaturesCol(features).setRawPredictionCol(raw)


def _line_model(spark: SparkSession, coefficients: np.ndarray, intercept: float, features: str) -> LinearRegressionModel:
    """A stock regression model from known coefficients."""
    weights = _py2java(spark.sparkContext, Vectors.dense(coefficients))
    ml = spark.sparkContext._jvm.org.apache.spark.ml
    model = LinearRegressionModel(ml.regression.LinearRegressionModel(f"LinearRegression_{uuid.uuid4().hex[:12]}", weights, float(intercept)))
    return model.setFeaturesCol(features)


class PenalizedSVC(_PenaltyEstimator):
    """Linear support vector machine, one against the rest for more than two classes: penalty "l2" or "l1", loss "squared_hinge" or,
    with l2, "hinge". Solved by ``margin``; the fitted model's ``report`` tells rounds, residual and whether it converged."""

    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    loss = Param(Params._dummy(), "loss", "hinge or squared_hinge", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol=LABEL, featuresCol="features", C=1.0, maxIter=100, tol=1e-4, penalty="l2", loss="squared_hinge"):
        super(_PenaltyEstimator, self).__init__()
        self._setDefault(labelCol=LABEL, featuresCol="features", C=1.0, maxIter=100, tol=1e-4, penalty="l2", loss="squared_hinge")
        self._set(**self._input_kwargs)

    def problem(self) -> Problem:
        penalty, loss = self.getOrDefault(self.penalty), self.getOrDefault(self.loss)
        if (penalty, loss) not in (("l2", "hinge"), ("l2", "squared_hinge"), ("l1", "squared_hinge")):
            raise ValueError(f"no solver for penalty {penalty} with loss {loss}")
        return Problem(self.getOrDefault(self.C), penalty, loss, self.getOrDefault(self.maxIter), self.getOrDefault(self.tol))

    def _fit(self, dataset):
        return self.fit_all(dataset, [self])[0]

    def fit_all(self, dataset, estimators: list[PenalizedSVC]) -> list:
        """The models of several estimators with this one's columns, from the same passes over the rows."""
        label, features = self.getLabelCol(), self.getFeaturesCol()
        problems = [e.problem() for e in estimators]
        rows = dataset.select(F.col(features).alias("features"), F.col(label).cast("double").alias("class")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            classes = int(rows.agg(F.max("class")).first()[0]) + 1
            wanted = [1] if classes <= 2 else list(range(classes))
            solved = fit_margins(rows, wanted, len(rows.select("features").first()["features"]), problems)
        finally:
            rows.unpersist()
        out = []
        for weights, report in solved:
            models = [_margin_model(dataset.sparkSession, weights[c][:-1], weights[c][-1], features, "rawPrediction") for c in wanted]
            model = models[0] if classes <= 2 else OneVsRestModel(models=models).setFeaturesCol(features)
            model.report = report
            out.append(model)
        return out


#: Estimators of Spark that pass over the rows many times.
FORESTS = (RandomForestClassifier, RandomForestRegressor)
MANY_PASSES = (PenalizedLogistic, *FORESTS)


class RidgeRegression(_PenaltyEstimator):
    """Least squares with the penalty ``alpha`` on the summed squares. Spark scales the label
    inside, hence the factor of its spread."""

    def _fit(self, dataset):
        n, spread = dataset.agg(F.count("*"), F.stddev_pop(self.getLabelCol())).first()
        return LinearRegression(
            **self._cols(), regParam=self.getOrDefault(self.alpha) * (spread or 0.0) / n, **LEAST_SQUARES,
        ).fit(dataset)


class LinearSVR(_PenaltyEstimator):
    """Linear epsilon-insensitive regression by iteratively reweighted least squares.

    Each hinge is replaced by the parabola that touches it at the current residual, and the
    resulting weighted ridge problem is solved exactly. The objective falls in every
    round; rows never leave the executors. Up to ``EXACT_WIDTH`` features ``tube`` sums the normal equations, of several
    estimators in the same passes; above, a round is one Spark least-squares fit. The model's ``report`` has the rounds, the last relative fall as its residual, and
    whether that is within the tolerance; without it the fit ended at its cap on rounds.
    """

    def _rows(self, dataset) -> DataFrame:
        return dataset.select(F.col(self.getFeaturesCol()).alias("features"), F.col(self.getLabelCol()).cast("double").alias("y"))

    def _fit(self, dataset):
        return self.fit_all(dataset, [self])[0]

    def fit_all(self, dataset, estimators: list[LinearSVR]) -> list:
        """The models of several estimators with this one's columns, from the same passes over the rows."""
        rows, spark = self._rows(dataset), dataset.sparkSession
        width = len(rows.select("features").first()["features"])
        if width > EXACT_WIDTH:
            return [e._fit_wide(dataset) for e in estimators]
        sparse = sparse_rows(rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            spread = sparse.agg(F.stddev_pop("y")).first()[0]
            tubes = [Tube(*(e.getOrDefault(p) for p in (e.C, e.epsilon, e.maxIter, e.tol))) for e in estimators]
            solved = fit_tubes(sparse, width, max(1e-9, 1e-3 * (spread or 1.0)), tubes)
        finally:
            sparse.unpersist()
        out = []
        for weights, report in solved:
            model = _line_model(spark, weights[:-1], weights[-1], self.getFeaturesCol())
            model.report = report
            out.append(model)
        return out

    def _fit_wide(self, dataset):
        C, eps = self.getOrDefault(self.C), self.getOrDefault(self.epsilon)
        rows = self._rows(dataset).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, spread = rows.agg(F.count("*"), F.stddev_pop("y")).first()
            floor = max(1e-9, 1e-3 * (spread or 1.0))
            model = LinearRegression(
                labelCol="y", regParam=(spread or 0.0) / (C * n), **LEAST_SQUARES,
            ).fit(rows)
            previous, rounds, converged = math.inf, 0, False
            for rounds in range(1, self.getOrDefault(self.maxIter) + 1):
                r = F.col("y") - F.col("prediction")
                over, under = r - eps, -r - eps
                wide, wide2 = F.greatest(F.abs(over), F.lit(floor)), F.greatest(F.abs(under), F.lit(floor))
                a, b = 1 / (4 * wide), 1 / (4 * wide2)
                target = (a * (F.col("y") - eps + wide) + b * (F.col("y") + eps - wide2)) / (a + b)
                scored = model.transform(rows).select(
                    "features", target.alias("t"), (2 * C * (a + b)).alias("w"),
                    F.greatest(F.lit(0.0), over, under).alias("loss"),
                )
                w, wt, wtt, loss = scored.agg(
                    F.sum("w"), F.sum(F.col("w") * F.col("t")), F.sum(F.col("w") * F.col("t") * F.col("t")), F.sum("loss")
                ).first()
                coefficients = model.coefficients.toArray()
                objective = 0.5 * float(coefficients @ coefficients) + C * loss
                fall = (previous - objective) / max(1.0, abs(objective))
                if fall <= self.getOrDefault(self.tol):
                    converged = True
                    break
                previous = objective
                deviation = math.sqrt(max(wtt / w - (wt / w) ** 2, 0.0))
                model = LinearRegression(labelCol="t", weightCol="w", regParam=deviation / w, **LEAST_SQUARES).fit(scored)
            model.report = Report(rounds, fall, converged)
            return model
        finally:
            rows.unpersist()


@dataclass
class Trained:
    """A fitted pipeline with its task, kept together so later steps need not guess the task."""

    name: str
    task: str
    model: PipelineModel
    metrics: dict


@contextmanager
def _cached(rows: DataFrame) -> Iterator[None]:
    """Rows that are read several times, cached meanwhile; a cache of the caller's is used and kept."""
    own = not (rows.storageLevel.useMemory or rows.storageLevel.useDisk)
    if own:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        if own:
            rows.unpersist()


def _fit_pipeline(train: DataFrame, *, target: str, task: str, estimator: Estimator, ignore: list[str] = ()) -> PipelineModel:
    """Preparation and model fitted on the same rows."""
    require_columns(train, target)
    rows, vectors = train, None
    with _cached(train):
        try:
            fitted = TableFeaturizer(targetCol=target, ignoreCols=list(ignore)).fit(rows)
            decode = []
            if task == "classification":
                indexer = _label_indexer(target).fit(rows)
                decode = [IndexToString(inputCol="prediction", outputCol="predictions", labels=indexer.labels)]
                labelled = indexer.transform(rows)
            else:
                labelled = rows.withColumn(LABEL, F.col(target).cast("double"))
            vectors = fitted.transform(labelled).select("features", LABEL).persist(StorageLevel.MEMORY_AND_DISK)
            estimator = _named(estimator)
            fit_rows = dealt(vectors) if isinstance(estimator, MANY_PASSES) else vectors
            if isinstance(estimator, FORESTS):
                estimator = with_node_ids(estimator, vectors)
            return PipelineModel(stages=[fitted, estimator.fit(fit_rows), *decode])
        finally:
            if vectors is not None:
                vectors.unpersist()


def _spread(vectors: DataFrame) -> DataFrame:
    """The same rows from a table of their own, for all cores. A plan that starts from a table is planned
    quickly by the many jobs of a fold, but small tables come in few files, and every pass would have few tasks; others in
    so many that every pass would be busy with its tasks."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    vectors.write.parquet(path)
    stored, cores = spark.read.schema(vectors.schema).parquet(path), spark.sparkContext.defaultParallelism
    return dealt(stored) if stored.rdd.getNumPartitions() >= cores else stored.repartition(cores)


def _label_indexer(target: str) -> StringIndexer:
    return StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc")


def _named(estimator: Estimator) -> Estimator:
    return estimator if isinstance(estimator, _PenaltyEstimator) else estimator.copy().setLabelCol(LABEL)


def train_logistic(train: DataFrame, *, target: str, max_iter: int = 500, C: float = 1.0, ignore=()) -> PipelineModel:
    return _fit_pipeline(train, target=target, task="classification", estimator=PenalizedLogistic(C=C, maxIter=max_iter), ignore=ignore)


def train_forest_classifier(train: DataFrame, *, target: str, trees: int = 100, depth: int = 10, seed: int = 42, ignore=()) -> PipelineModel:
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    return _fit_pipeline(train, target=target, task="classification", estimator=forest, ignore=ignore)


def train_linear_svc(train: DataFrame, *, target: str, C: float = 1.0, max_iter: int = 100, ignore=()) -> PipelineModel:
    return _fit_pipeline(train, target=target, task="classification", estimator=PenalizedSVC(C=C, maxIter=max_iter), ignore=ignore)


def train_ridge(train: DataFrame, *, target: str, alpha: float = 1.0, ignore=()) -> PipelineModel:
    return _fit_pipeline(train, target=target, task="regression", estimator=RidgeRegression(alpha=alpha), ignore=ignore)


def train_forest_regressor(train: DataFrame, *, target: str, trees: int = 100, depth: int = 10, seed: int = 42, ignore=()) -> PipelineModel:
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    return _fit_pipeline(train, target=target, task="regression", estimator=forest, ignore=ignore)


def train_linear_svr(train: DataFrame, *, target: str, C: float = 1.0, epsilon: float = 0.0, max_iter: int = 100, tol: float = 1e-3, ignore=()) -> PipelineModel:
    svr = LinearSVR(C=C, epsilon=epsilon, maxIter=max_iter, tol=tol)
    return _fit_pipeline(train, target=target, task="regression", estimator=svr, ignore=ignore)


def predict_with(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input columns plus ``predictions``."""
    out = model.transform(df)
    if "predictions" not in out.columns:
        out = out.withColumn("predictions", F.col("prediction"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "predictions")


def holdout_score(model: PipelineModel, test: DataFrame, *, target: str, task: str) -> dict:
    """Metrics of a fitted model on held-out rows."""
    scored = predict_with(model, test)
    if task == "classification":
        row = M.classification_metrics(scored, label=target, prediction="predictions").first()
        return {"accuracy": row["accuracy"], "f1_weighted": row["f1_weighted"]}
    row = M.regression_metrics(scored, label=target, prediction="predictions").first()
    return {"r2": row["r2"], "rmse": row["rmse"], "mae": row["mae"]}


FAMILIES = {
    "classification": [
        ("Logistic Regression", train_logistic),
        ("Random Forest", train_forest_classifier),
        ("Linear Support Vector Machine", train_linear_svc),
    ],
    "regression": [
        ("Ridge Regression", train_ridge),
        ("Random Forest", train_forest_regressor),
        ("Linear SVR", train_linear_svr),
    ],
}
RANKINGS = {"f1_weighted": True, "accuracy": True, "train_accuracy": True, "r2": True, "rmse": False, "mae": False}


def train_all_and_rank(
    train: DataFrame, test: DataFrame, *, target: str, task: str, primary_metric: str | None = None, parallelism: int = 3, ignore=()
) -> list[Trained]:
    """Fit the model family of a task and sort it by the metric, best first."""
    primary = primary_metric or ("f1_weighted" if task == "classification" else "r2")
    if primary not in RANKINGS:
        raise ValueError(f"unknown metric {primary!r}")

    def run(item):
        name, fit = item
        model = fit(train, target=target, ignore=ignore)
        scores = holdout_score(model, test, target=target, task=task)
        if task == "classification":
            scores["train_accuracy"] = holdout_score(model, train, target=target, task=task)["accuracy"]
        return Trained(name, task, model, scores)

    with _cached(train), ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(run, FAMILIES[task]))
    sign = -1 if RANKINGS[primary] else 1
    return sorted(results, key=lambda t: (sign * t.metrics[primary], t.name))


def results_frame(spark: SparkSession, results: list[Trained]) -> DataFrame:
    """Ranked results as rows ready for the experiment log."""
    rows = [(i + 1, t.name, t.task, {k: float(v) for k, v in t.metrics.items()}) for i, t in enumerate(results)]
    return spark.createDataFrame(rows, "rank BIGINT, model STRING, task STRING, metrics MAP<STRING, DOUBLE>")


def save_champion(model: PipelineModel, path: str, *, task: str, metrics: dict) -> None:
    """Store the latest best model with its task; an earlier one is overwritten."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(task, json.dumps(metrics))], "task STRING, metrics STRING").write.mode("overwrite").json(f"{path}/about")


def load_champion(spark: SparkSession, path: str) -> Trained:
    about = spark.read.schema("task STRING, metrics STRING").json(f"{path}/about").first()
    return Trained("champion", about["task"], PipelineModel.load(f"{path}/model"), json.loads(about["metrics"]))


def batch_predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input columns, ``predictions`` and, where the model gives them, ``prob_<class>`` per class."""
    out = model.transform(df)
    probs = []
    decode = [s for s in model.stages if isinstance(s, IndexToString)]
    if "probability" in out.columns and decode:
        array = vector_to_array("probability")
        probs = [array[i].alias(f"prob_{name}") for i, name in enumerate(decode[0].getLabels())]
    prediction = F.col("predictions") if decode else F.col("prediction").alias("predictions")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], prediction, *probs)


# --- search -----------------------------------------------------------------------------------


@dataclass
class SearchResult:
    trials: DataFrame
    model: PipelineModel
    best_params: dict
    cv_score: float
    metrics: dict


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def _search(
    train: DataFrame, *, target: str, task: str, key: str, draw, build, trials: int, k: int, seed: int, parallelism: int
) -> SearchResult:
    """Seeded random search with k-fold validation. A trial's row tells the most rounds, the largest residual and whether all of its
    fits converged, for the estimators that report them.

    Preparation is fitted once per fold, not once per trial, and its output is shared by the
    trials of that fold. Forests that differ in trees and depth alone are read off one grown forest per fold.
    """
    spark = train.sparkSession
    rng = random.Random(seed)
    candidates = [draw(rng) for _ in range(trials)]
    if task == "classification":
        indexer: StringIndexerModel = _label_indexer(target).fit(train)
        labelled = indexer.transform(kfold_stratified(train, key=key, by=target, k=k, seed=seed))
    else:
        labelled = kfold(train, key=key, k=k, seed=seed).withColumn(LABEL, F.col(target).cast("double"))
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    scores: list[list[float]] = [[] for _ in candidates]
    reports: list[list[Report]] = [[] for _ in candidates]
    for fold in range(k):
        fitted = TableFeaturizer(targetCol=target, ignoreCols=[key, "fold", LABEL]).fit(labelled.where(F.col("fold") != fold))
        vectors = _spread(fitted.transform(labelled).select("features", LABEL, "fold")).persist(StorageLevel.MEMORY_AND_DISK)
        fit_rows, check_rows = vectors.where(F.col("fold") != fold), vectors.where(F.col("fold") == fold)

        estimators = [_named(build(params)) for params in candidates]
        # estimators that can be fitted together share their passes over the rows
        together = estimators[0].fit_all(fit_rows, estimators) if hasattr(estimators[0], "fit_all") else [None] * trials
        checked, cached = [None] * trials, []
        if isinstance(estimators[0], FORESTS):
            checked, cached = validated_forests(fit_rows, check_rows, estimators, LABEL, task == "classification")

        def run(estimator, fitted, scored, fit_rows=fit_rows, check_rows=check_rows):
            if scored is None:
                fitted = fitted or estimator.fit(fit_rows)
                scored = fitted.transform(check_rows)
            report = getattr(fitted, "report", None)
            if task == "classification":
                return M.classification_metrics(scored, label=LABEL, prediction="prediction").first()["f1_weighted"], report
            return M.regression_metrics(scored, label=LABEL, prediction="prediction").first()["r2"], report

        with ThreadPoolExecutor(parallelism) as pool:
            for i, (score, report) in enumerate(pool.map(run, estimators, together, checked)):
                scores[i].append(score)
                reports[i] += [report] if report else []
        for table in (*cached, vectors):
            table.unpersist()
    labelled.unpersist()
    means = [sum(s) / k for s in scores]
    best = max(range(trials), key=lambda i: (means[i], -i))
    model = _fit_pipeline(train, target=target, task=task, estimator=build(candidates[best]), ignore=[key])
    scored = holdout_score(model, train, target=target, task=task)
    fitted_metric = {"train_accuracy": scored["accuracy"]} if task == "classification" else {"train_r2": scored["r2"]}
    rows = []
    for i, told in enumerate(reports):
        ended = (max(r.rounds for r in told), max(r.residual for r in told), all(r.converged for r in told)) if told else (None, None, None)
        rows.append((i, json.dumps(candidates[i], sort_keys=True), float(means[i]), i == best, *ended))
    table = spark.createDataFrame(rows, "trial BIGINT, params STRING, cv_score DOUBLE, best BOOLEAN, rounds BIGINT, residual DOUBLE, converged BOOLEAN")
    return SearchResult(table, model, candidates[best], means[best], {**fitted_metric, "cv_score": means[best]})


def _searcher(task: str, draw, build):
    def search(train: DataFrame, *, target: str, key: str, trials: int = 20, k: int = 3, seed: int = 42, parallelism: int = 8) -> SearchResult:
        with _cached(train):
            return _search(train, target=target, task=task, key=key, draw=draw, build=build, trials=trials, k=k, seed=seed, parallelism=parallelism)

    return search


search_logistic = _searcher(
    "classification",
    lambda rng: {"C": _log_uniform(rng, 0.01, 100), "max_iter": rng.randint(100, 50_000)},
    lambda p: PenalizedLogistic(C=p["C"], maxIter=p["max_iter"], tol=1e-3),
)
search_forest_classifier = _searcher(
    "classification",
    lambda rng: {"n_estimators": rng.randint(50, 100), "max_depth": rng.randint(5, 12)},
    lambda p: RandomForestClassifier(numTrees=p["n_estimators"], maxDepth=p["max_depth"], seed=42),
)


def _draw_svc(rng: random.Random) -> dict:
    """Only combinations that exist: l1 goes with the squared hinge and the primal problem, the plain hinge with the dual one. The solver
    is the same for both, so ``dual`` does not change a fit."""
    drawn = {"C": _log_uniform(rng, 0.01, 100), "penalty": rng.choice(["l1", "l2"]), "max_iter": rng.randint(100, 50_000)}
    if drawn["penalty"] == "l1":
        return drawn | {"loss": "squared_hinge", "dual": False}
    loss = rng.choice(["hinge", "squared_hinge"])
    return drawn | {"loss": loss, "dual": True if loss == "hinge" else rng.choice([True, False])}


search_svc = _searcher(
    "classification",
    _draw_svc,
    lambda p: PenalizedSVC(C=p["C"], penalty=p["penalty"], loss=p["loss"], maxIter=p["max_iter"], tol=1e-4),
)
search_ridge = _searcher(
    "regression",
    lambda rng: {"alpha": _log_uniform(rng, 10, 10_000)},
    lambda p: RidgeRegression(alpha=p["alpha"]),
)
search_forest_regressor = _searcher(
    "regression",
    lambda rng: {
        "n_estimators": rng.randint(10, 30), "max_depth": rng.randint(3, 8), "min_samples_leaf": rng.randint(2, 5),
    },
    lambda p: RandomForestRegressor(
        numTrees=p["n_estimators"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples_leaf"], seed=42
    ),
)
search_svr = _searcher(
    "regression",
    lambda rng: {"C": _log_uniform(rng, 0.01, 100), "epsilon": _log_uniform(rng, 0.01, 1.0)},
    lambda p: LinearSVR(C=p["C"], epsilon=p["epsilon"], maxIter=2000, tol=1e-4),
)
