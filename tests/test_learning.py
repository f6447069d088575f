import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tableworks.operators import experiments as E
from tableworks.operators import features as X
from tableworks.operators import margin, tube
from tableworks.operators import models as L
from tableworks.operators.forests import nested_predictions
from tableworks.operators.ordering import dealt
from tableworks.operators import sampling as K


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(size=501).tolist(),
    [1.0] * 300 + [2.0] * 300,
    [1.0] * 400 + list(map(float, range(2, 30))),
    [5.0] * 1000,
    list(map(float, range(1000))),
    [0.0] * 499 + [1.0, 2.0] + [3.0] * 499,
])
def test_median_by_narrowing_equals_the_plain_one(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v DOUBLE")
    assert X.medians(df, ["v"], direct_rows=10)["v"] == pytest.approx(float(np.median(values)))


def test_mode_takes_the_smallest_on_a_tie_and_empty_columns_are_dropped(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)], "c STRING, e STRING")
    assert X.modes(df, ["c"]) == {"c": "a"}
    assert X.impute_mode(df, df, cols=["c", "e"]).columns == ["c"]


def test_zero_spread_divides_by_one(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE")
    assert [r.v for r in X.standardize(df, df, cols=["v"]).collect()] == [0.0, 0.0]


def test_unseen_category_gives_zeros_and_test_rows_do_not_leak(spark):
    train = spark.createDataFrame([("x", 1.0, 1.0), ("y", 3.0, 2.0)], "c STRING, n DOUBLE, t DOUBLE")
    test = spark.createDataFrame([("new", 100.0, 5.0), (None, None, 5.0)], "c STRING, n DOUBLE, t DOUBLE")
    _, out = X.fit_transform_features(train, test, target="t")
    rows = [r.f for r in out.select(vector_to_array("features").alias("f")).collect()]
    assert rows[0] == [98.0, 0.0, 0.0]  # mean 2, spread 1 of the training rows
    assert rows[1] == [0.0, 1.0, 0.0]  # median 2; the mode is x


def test_any_number_of_categories(spark):
    n = 120_000
    df = spark.range(n).select(F.format_string("%07d", "id").alias("c"))
    more = df.limit(1000).union(spark.createDataFrame([("unseen",), (None,)], "c STRING"))
    rows = X.one_hot(df, more, cols=["c"]).collect()
    for r in rows:
        want = [] if r.c in (None, "unseen") else [int(r.c)]
        assert r["c__onehot"].size == n and r["c__onehot"].indices.tolist() == want


def test_hashed_categories_have_a_fixed_width(spark):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("c"), (F.col("id") * 1.5).alias("y"))
    model = X.TableFeaturizer(targetCol="y", ignoreCols=["id"], hashedWidth=32).fit(df)
    assert {r.features.size for r in model.transform(df).select("features").collect()} == {32}


def test_least_squares_on_both_sides_of_the_exact_width(spark):
    from pyspark.ml.linalg import Vectors

    for width in (20, 5000):
        rows = [(Vectors.sparse(width, {i % 20: 1.0, (7 * i + 3) % width: 0.5}), float(i % 20)) for i in range(400)]
        df = spark.createDataFrame(rows, ["features", "label__"])
        model = L.RidgeRegression(alpha=1.0).fit(df)
        x = np.array([r[0].toArray() for r in rows])
        y = np.array([r[1] for r in rows])
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + np.eye(width), xc.T @ yc)
        assert np.allclose(model.coefficients.toArray(), want, atol=1e-3)
        svr = L.LinearSVR(C=1.0, maxIter=2).fit(df)
        assert len(svr.coefficients) == width


def test_a_cache_of_the_caller_survives_training(numbers):
    rows = numbers.drop("id", "f").persist()
    try:
        rows.count()
        L.train_ridge(rows, target="y")
        assert rows.storageLevel.useMemory
        L.train_all_and_rank(rows, rows, target="y", task="regression", parallelism=1)
        assert rows.storageLevel.useMemory
    finally:
        rows.unpersist()


def test_split_sizes_shares_and_folds(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("c"))
    assert K.split_random(df, key="id").where("split = 'test'").count() == 201
    shares = {r.c: r["count"] for r in K.split_stratified(df, key="id", by="c").where("split = 'test'").groupBy("c").count().collect()}
    assert shares == {"rare": 21, "often": 181}
    sizes = [r["count"] for r in K.kfold_stratified(df, key="id", by="c").groupBy("fold").count().collect()]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 2
    assert sorted(K.kfold(df, key="id").collect()) == sorted(K.kfold(df.repartition(5), key="id").collect())


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.normal(size=400) * 0.3
    flag = np.where(x @ [1.0, 1.0] + rng.normal(size=400) * 0.5 > 0, "yes", "no")
    rows = [(i, float(a), float(b), float(t), str(f)) for i, ((a, b), t, f) in enumerate(zip(x, y, flag))]
    return spark.createDataFrame(rows, "id BIGINT, a DOUBLE, b DOUBLE, y DOUBLE, f STRING").cache()


def scaled(numbers):
    model = X.TableFeaturizer(targetCol="y", ignoreCols=["id", "f"]).fit(numbers)
    rows = model.transform(numbers).withColumns({"label__": F.col("y"), "class": (F.col("f") == "yes").cast("double")}).cache()
    table = rows.select(vector_to_array("features").alias("x"), "y", "class").toPandas()
    return rows, np.stack(table["x"].map(np.array)), table["y"].to_numpy(), table["class"].to_numpy()


def test_ridge_equals_the_closed_form(numbers):
    rows, x, y, _ = scaled(numbers)
    fitted = L.RidgeRegression(alpha=50.0).fit(rows)
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + 50 * np.eye(2), centred.T @ (y - y.mean()))
    assert fitted.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_svc_is_at_the_minimum_of_its_objective(numbers):
    rows, x, _, c = scaled(numbers)
    fitted = L.PenalizedSVC(labelCol="class", C=2.0, maxIter=50, tol=1e-10).fit(rows)
    w, b, sign = fitted.coefficients.toArray(), fitted.intercept, 2 * c - 1
    gap = np.maximum(0, 1 - sign * (x @ w + b))
    gradient = w - 2 * 2.0 * (x * (gap * sign)[:, None]).sum(0)
    assert np.abs(gradient).max() < 1e-3 and abs((gap * sign).sum()) < 1e-3


@pytest.mark.parametrize("width", [1024, 1])
def test_svc_with_l1_meets_the_optimality_conditions(numbers, monkeypatch, width):
    monkeypatch.setattr(margin, "EXACT_WIDTH", width)  # Newton steps, and gradient steps alone
    rows, x, _, c = scaled(numbers)
    x = np.concatenate((x, np.random.default_rng(1).normal(size=(400, 3))), axis=1)
    sign, spark = 2 * c - 1, rows.sparkSession
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, c)], ["features", "class"])
    for C in (0.002, 0.01, 1.0):
        fitted = L.PenalizedSVC(labelCol="class", C=C, penalty="l1", maxIter=3000, tol=1e-6 if width > 1 else 1e-5).fit(df)
        w, b = fitted.coefficients.toArray(), fitted.intercept
        gap = np.maximum(0, 1 - sign * (x @ w + b))
        slope = -2 * C * (x * (gap * sign)[:, None]).sum(0)
        assert fitted.report.converged and fitted.report.residual <= 1e-5
        assert np.abs(np.where(w == 0, np.maximum(np.abs(slope) - 1, 0), slope + np.sign(w))).max() < 1e-2 and abs((gap * sign).sum()) < 1
        if C < 0.01:
            assert (w == 0).sum() >= 3


def test_svc_with_the_plain_hinge_beats_nearby_coefficients(numbers):
    rows, x, _, c = scaled(numbers)
    fitted = L.PenalizedSVC(labelCol="class", C=0.5, loss="hinge", maxIter=500).fit(rows)
    w, b, sign = fitted.coefficients.toArray(), fitted.intercept, 2 * c - 1

    def objective(w, b):
        return 0.5 * w @ w + 0.5 * np.maximum(0, 1 - sign * (x @ w + b)).sum()

    best, rng = objective(w, b), np.random.default_rng(0)
    moved = min(objective(w + rng.normal(size=2) * s, b + rng.normal() * s) for s in (0.1, 0.02, 0.005) for _ in range(300))
    assert best <= moved * 1.002 and fitted.report.converged
    with pytest.raises(ValueError, match="no solver"):
        L.PenalizedSVC(labelCol="class", penalty="l1", loss="hinge").fit(rows)


def test_a_fit_that_ends_at_its_cap_says_so(numbers):
    rows, *_ = scaled(numbers)
    assert not L.PenalizedSVC(labelCol="class", C=5.0, maxIter=1, tol=1e-9).fit(rows).report.converged
    assert not L.LinearSVR(C=1.0, epsilon=0.1, maxIter=2, tol=1e-12).fit(rows).report.converged


def test_svc_search_draws_the_whole_space(numbers):
    import json

    rng = random.Random(0)
    drawn = [L._draw_svc(rng) for _ in range(400)]
    assert {(d["penalty"], d["loss"], d["dual"]) for d in drawn} == {
        ("l1", "squared_hinge", False), ("l2", "hinge", True), ("l2", "squared_hinge", True), ("l2", "squared_hinge", False),
    }
    assert min(d["max_iter"] for d in drawn) >= 100 and 45_000 < max(d["max_iter"] for d in drawn) <= 50_000
    found = L.search_svc(numbers.drop("y"), target="f", key="id", trials=4)
    trials = found.trials.collect()
    assert all(t.converged and t.residual <= 1e-4 and 1 <= t.rounds <= json.loads(t.params)["max_iter"] for t in trials)


def test_svr_beats_nearby_coefficients(numbers):
    rows, x, y, _ = scaled(numbers)
    fitted = L.LinearSVR(C=1.0, epsilon=0.1, maxIter=200, tol=1e-9).fit(rows)
    w, b = fitted.coefficients.toArray(), fitted.intercept

    def objective(w, b):
        return 0.5 * w @ w + np.maximum(0, np.abs(y - x @ w - b) - 0.1).sum()

    best, rng = objective(w, b), np.random.default_rng(0)
    moved = min(objective(w + rng.normal(size=2) * s, b + rng.normal() * s) for s in (0.1, 0.02, 0.005) for _ in range(300))
    assert best <= moved * 1.002


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_svr_fits_of_a_search_share_their_passes_and_equal_single_fits_by_spark(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) if kind == "dense" else np.eye(12)[rng.integers(12, size=300)] + 0.5 * np.eye(12)[rng.integers(12, size=300)]
    y = x @ np.arange(x.shape[1]) + 2 + rng.normal(size=300) * 0.4
    vector = Vectors.dense if kind == "dense" else lambda v: Vectors.sparse(12, {int(i): float(v[i]) for i in np.flatnonzero(v)})
    rows = spark.createDataFrame([(vector(a), float(b)) for a, b in zip(x, y)], ["features", "label__"])
    svrs = [L.LinearSVR(C=C, epsilon=e, maxIter=n, tol=1e-5) for C, e, n in ((0.05, 0.1, 100), (1.0, 0.3, 100), (20.0, 0.0, 100), (1.0, 0.1, 2))]
    passes, sums = [], tube._sums
    monkeypatch.setattr(tube, "_sums", lambda *a: passes.append(len(a[-1])) or sums(*a))
    fitted = svrs[0].fit_all(rows, svrs)
    assert passes[:2] == [1, 4] and len(passes) == 1 + max(m.report.rounds for m in fitted)
    for svr, model in zip(svrs, fitted):
        want = svr._fit_wide(rows)
        assert model.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-6) and model.intercept == pytest.approx(want.intercept, abs=1e-6)
        assert (model.report.rounds, model.report.converged) == (want.report.rounds, want.report.converged)
    assert [m.report.converged for m in fitted] == [True, True, True, False]
    with pytest.raises(Exception, match="labels must not be null"):
        svrs[0].fit(rows.union(spark.createDataFrame([(vector(x[0]), None)], rows.schema)))


def test_svr_search_fits_its_trials_together(numbers, monkeypatch):
    passes, sums = [], tube._sums
    monkeypatch.setattr(tube, "_sums", lambda *a: passes.append(len(a[-1])) or sums(*a))
    trials = L.search_svr(numbers.drop("f"), target="y", key="id", trials=3, k=2).trials.collect()
    assert len(trials) == 3 and all(t.converged and t.rounds >= 1 for t in trials) and max(t.cv_score for t in trials) > 0.9
    assert passes[:2] == [1, 3] and passes.count(1) >= 3


def test_champion_round_trip_and_probabilities(spark, numbers, tmp_path):
    model = L.train_logistic(numbers, target="f", ignore=["id", "y"])
    L.save_champion(model, str(tmp_path), task="classification", metrics={"accuracy": 1.0})
    L.save_champion(model, str(tmp_path), task="classification", metrics={"accuracy": 0.5})
    champion = L.load_champion(spark, str(tmp_path))
    assert champion.task == "classification" and champion.metrics == {"accuracy": 0.5}
    out = L.batch_predict(champion.model, numbers)
    assert out.columns == [*numbers.columns, "predictions", "prob_no", "prob_yes"]
    assert out.where("abs(prob_no + prob_yes - 1) > 1e-9").count() == 0
    assert L.holdout_score(champion.model, numbers, target="f", task="classification")["accuracy"] > 0.8


def test_search_refits_the_best_trial(numbers):
    found = L.search_ridge(numbers.drop("f"), target="y", key="id", trials=3)
    trials = found.trials.collect()
    best = max(trials, key=lambda r: r.cv_score)
    assert best.best and len(trials) == 3 and found.cv_score == best.cv_score
    assert set(found.metrics) == {"train_r2", "cv_score"}
    assert 10 <= found.best_params["alpha"] <= 10_000


def test_three_classes_and_ranking(spark, numbers):
    three = numbers.withColumn("f", F.when(F.col("a") > 0.7, "top").otherwise(F.col("f"))).drop("y")
    model = L.train_linear_svc(three, target="f", ignore=["id"])
    assert L.holdout_score(model, three, target="f", task="classification")["accuracy"] > 0.7
    with pytest.raises(ValueError, match="unknown metric"):
        L.train_all_and_rank(three, three, target="f", task="classification", primary_metric="nonsense")


def test_metric_direction_and_ties(spark):
    rows = [("m1", {"test_accuracy": 0.5, "test_rmse": 1.0}, 2.0), ("m2", {"test_accuracy": 0.9, "test_rmse": 3.0}, 3.0),
            ("m3", {"test_accuracy": 0.9}, 1.0), ("m4", {}, 9.0)]
    log = spark.createDataFrame(rows, "model STRING, metrics MAP<STRING, DOUBLE>, timestamp DOUBLE")
    assert E.exp_best(log, metric="acc").first().model == "m3"
    assert E.exp_best(log, metric="test_rmse").first().model == "m1"
    assert E.exp_best(log, metric="absent").count() == 0
    assert [r.model for r in E.exp_recent(log, limit=2).collect()] == ["m4", "m2"]


def test_logistic_is_at_the_minimum_of_its_objective(numbers):
    rows, x, _, c = scaled(numbers)
    fitted = L.PenalizedLogistic(labelCol="class", C=0.5, maxIter=500, tol=1e-10).fit(rows)
    w, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + 0.5 * x.T @ (p - c)).max() < 1e-3 and abs((p - c).sum()) < 1e-3


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_forests_read_off_a_larger_one_are_those_of_spark(spark, task):
    """Without a choice of features a forest of lower depth has the same draws, so it has to be the cut one row by row."""
    classes = task == "classification"
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(rng.integers(3)) if classes else float(rng.normal()), Vectors.dense(rng.normal(size=4).round(1))) for _ in range(400)], ["y", "features"])
    kind = RandomForestClassifier if classes else RandomForestRegressor
    grown = {d: kind(labelCol="y", numTrees=7, maxDepth=d, seed=5, featureSubsetStrategy="all").fit(rows) for d in (1, 3, 6)}
    sizes = [(7, 1), (7, 3), (7, 6), (2, 6)]
    got = np.array([r.predictions for r in nested_predictions(grown[6], sizes, rows, "y", classes).collect()])
    for i, (_, depth) in enumerate(sizes[:3]):
        want = [r.prediction for r in grown[depth].transform(rows).collect()]
        assert got[:, i] == pytest.approx(want, abs=1e-12)
    if not classes:
        first = [np.mean([t.predict(r.features) for t in grown[6].trees[:2]]) for r in rows.limit(5).collect()]
        assert got[:5, 3] == pytest.approx(first)


def test_a_forest_search_grows_one_forest_for_each_fold_and_leaf_size(spark, monkeypatch):
    fits, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows, *a: fits.append(self.getMinInstancesPerNode()) or fit(self, rows, *a))
    rows = spark.createDataFrame([(i, float(i % 17), float(i % 17) ** 2) for i in range(300)], "id LONG, x DOUBLE, y DOUBLE")
    found = L.search_forest_regressor(rows, target="y", key="id", trials=6, k=2)
    assert len(fits) == 2 * len(set(fits[:-1])) + 1 < 6 * 2 + 1
    trials = found.trials.collect()
    assert len(trials) == 6 and sum(t.best for t in trials) == 1 and max(t.cv_score for t in trials) > 0.9


def test_the_fits_of_a_search_have_as_many_tasks_as_there_are_cores(spark, monkeypatch):
    seen, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, rows, *a: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows, *a))
    rows = spark.createDataFrame([(i, float(i % 17), float(i % 17) ** 2) for i in range(300)], "id LONG, x DOUBLE, y DOUBLE").coalesce(1)
    L.search_forest_regressor(rows, target="y", key="id", trials=1, k=2)
    assert seen[0] == spark.sparkContext.defaultParallelism


def test_rows_of_many_partitions_are_dealt_evenly_and_stay_whole(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i, None if i % 7 == 0 else float(i % 3)) for i in range(1003)], 10 * cores), "id LONG, x DOUBLE")
    parts = dealt(rows).rdd.glom().collect()
    assert len(parts) == 2 * cores and max(map(len, parts)) - min(map(len, parts)) <= 10 * cores and min(map(len, parts)) > 20
    assert sorted(r for part in parts for r in part) == sorted(rows.collect()) and parts == dealt(rows).rdd.glom().collect()
    assert all([r.id for r in part] == sorted(r.id for r in part) for part in parts)
    for kept in (cores, 2 * cores):
        assert dealt(rows.coalesce(kept)).rdd.getNumPartitions() == kept
    assert dealt(rows.coalesce(1)).rdd.getNumPartitions() == cores


@pytest.mark.parametrize("kind, train, target", [(RandomForestRegressor, L.train_forest_regressor, "y"), (RandomForestClassifier, L.train_forest_classifier, "c")])
def test_the_tasks_of_a_forest_pass_do_not_grow_with_the_partitions_of_its_rows(spark, monkeypatch, kind, train, target):
    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, rows, *a: seen.append((rows.rdd.getNumPartitions(), rows.count())) or fit(self, rows, *a))
    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(float(i % 17), float(i % 17) ** 2, str(i % 17 > 8)) for i in range(600)], 10 * cores), "x DOUBLE, y DOUBLE, c STRING")
    model = train(rows, target=target, trees=3, depth=4, ignore=["c" if target == "y" else "y"])
    assert seen == [(2 * cores, 600)] and not rows.storageLevel.useMemory
    scores = L.holdout_score(model, rows, target=target, task="regression" if target == "y" else "classification")
    assert scores.get("r2", 0) > 0.9 or scores.get("accuracy") == 1.0


def test_the_tasks_of_a_logistic_search_do_not_grow_with_the_partitions_of_its_rows(spark, monkeypatch):
    seen, fit, cores = [], L.LogisticRegression.fit, spark.sparkContext.defaultParallelism
    monkeypatch.setattr(L.LogisticRegression, "fit", lambda self, rows, *a: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows, *a))
    plain = spark.sparkContext.parallelize([(i, float(i % 17), str(i % 17 > 8)) for i in range(600)], 10 * cores)
    rows = spark.createDataFrame(plain, "id LONG, x DOUBLE, c STRING")
    found = L.search_logistic(rows, target="c", key="id", trials=2, k=2)
    assert len(seen) == 5 and max(seen) <= 2 * cores and not rows.storageLevel.useMemory
    assert found.cv_score > 0.9 and found.metrics["train_accuracy"] > 0.9


@pytest.mark.parametrize("kind, search, train", [(RandomForestRegressor, L.search_forest_regressor, L.train_forest_regressor), (RandomForestClassifier, L.search_forest_classifier, L.train_forest_classifier)])
def test_forests_keep_the_nodes_that_rows_have_reached_and_stay_the_same(spark, monkeypatch, kind, search, train):
    from tableworks.operators import forests

    seen, fit = [], kind.fit
    monkeypatch.setattr(kind, "fit", lambda self, rows, *a: seen.append(self.getCacheNodeIds()) or fit(self, rows, *a))
    rows = spark.createDataFrame([(i, float(i % 17), float(i * 7 % 23), str(i % 5 + i % 2)) for i in range(400)], "id LONG, x DOUBLE, z DOUBLE, c STRING")
    rows = rows.withColumn("y", rows.c.cast("double")).drop("c") if kind is RandomForestRegressor else rows.withColumnRenamed("c", "y")
    found = []
    for most in (1 << 30, 0):
        monkeypatch.setattr(forests, "NODE_ID_BYTES", most)
        search(rows, target="y", key="id", trials=2, k=2)
        model = train(rows, target="y", trees=5, depth=6, ignore=["id"])
        stage = next(s for s in model.stages if hasattr(s, "toDebugString"))
        found.append(stage.toDebugString.partition("\n")[2])
        assert seen and all(kept == (most > 0) for kept in seen)
        seen.clear()
    assert found[0] == found[1]
