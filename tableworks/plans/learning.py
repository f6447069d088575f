"""Queries over feature preparation, splits, models, metrics and the experiment log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as E
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as L
from ..operators import sampling as K
from ..session import scratch_path, table
from .registry import query
from .tabular import GAPS_SQL, LOG_SQL, customer_with_gaps, experiment_log

# --- splits -----------------------------------------------------------------------------------


@query("split_random", """
SELECT o_orderkey,
       CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= ceil(0.2::DOUBLE * count(*) OVER ())
            THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_random(spark, sf):
    return K.split_random(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey")


@query("split_stratified", """
SELECT o_orderkey, o_orderstatus,
       CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey)
                 <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY o_orderstatus))
            THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_stratified(spark, sf):
    return K.split_stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), key="o_orderkey", by="o_orderstatus")


@query("kfold", """
SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 3)::INTEGER AS fold FROM orders""")
def kfold(spark, sf):
    return K.kfold(table(spark, sf, "orders").select("o_orderkey"), key="o_orderkey")


@query("kfold_stratified", """
SELECT o_orderkey, o_orderstatus,
       ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 3)::INTEGER AS fold
FROM orders""")
def kfold_stratified(spark, sf):
    return K.kfold_stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), key="o_orderkey", by="o_orderstatus")


# --- features ---------------------------------------------------------------------------------

SPLIT_GAPS_SQL = GAPS_SQL + """,
parts AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS is_test FROM gaps),
train AS (SELECT * FROM parts WHERE NOT is_test),
test AS (SELECT * FROM parts WHERE is_test)
"""


def gap_parts(spark, sf):
    rows = K.split_random(customer_with_gaps(spark, sf), key="c_custkey")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


@query("impute_median", SPLIT_GAPS_SQL + """
SELECT c_custkey, round(CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal)
  THEN (SELECT median(c_acctbal) FROM train WHERE NOT isnan(c_acctbal)) ELSE c_acctbal END, 6) AS c_acctbal FROM test""")
def impute_median(spark, sf):
    train, test = gap_parts(spark, sf)
    out = X.impute_median(train, test, cols=["c_acctbal"])
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("impute_mode", SPLIT_GAPS_SQL + """
SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM train WHERE c_mktsegment IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM test""")
def impute_mode(spark, sf):
    train, test = gap_parts(spark, sf)
    return X.impute_mode(train, test, cols=["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("standardize", """
SELECT l_orderkey, l_linenumber, l_partkey,
       round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice,
       round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity
FROM lineitem""")
def standardize(spark, sf):
    lines = table(spark, sf, "lineitem")
    out = X.standardize(lines, lines, cols=["l_extendedprice", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in ("l_extendedprice", "l_quantity")])


@query("to_float32", """
SELECT p_partkey, round(p_retailprice::FLOAT::DOUBLE, 6) AS p_retailprice, round(p_size::FLOAT::DOUBLE, 6) AS p_size FROM part""")
def to_float32(spark, sf):
    out = X.to_float32(table(spark, sf, "part"), cols=["p_retailprice", "p_size"])
    return out.select("p_partkey", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("p_retailprice", "p_size")])


@query("one_hot", SPLIT_GAPS_SQL + """,
seen AS (SELECT DISTINCT c_mktsegment FROM train WHERE c_mktsegment IS NOT NULL),
places AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS slot FROM seen)
SELECT c_custkey, slot, 1.0::DOUBLE AS value, (SELECT count(*) FROM places) AS width
FROM test JOIN places USING (c_mktsegment)""")
def one_hot(spark, sf):
    from pyspark.ml.functions import vector_to_array

    train, test = gap_parts(spark, sf)
    out = X.one_hot(train, test, cols=["c_mktsegment"])
    array = vector_to_array("c_mktsegment__onehot")
    long = out.select("c_custkey", F.size(array).cast("long").alias("width"), F.posexplode_outer(array).alias("slot", "value"))
    return long.where("value <> 0").withColumn("slot", F.col("slot").cast("long"))


@query("assemble", """
WITH places AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS slot FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, 0::BIGINT AS slot, o_totalprice AS value FROM orders
UNION ALL SELECT o_orderkey, slot, 1.0 FROM orders JOIN places USING (o_orderpriority)""")
def assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array

    orders = table(spark, sf, "orders")
    encoded = X.one_hot(orders, orders, cols=["o_orderpriority"])
    out = X.assemble(encoded, numeric=["o_totalprice"], categorical=["o_orderpriority__onehot"])
    long = out.select("o_orderkey", F.posexplode_outer(vector_to_array("features")).alias("slot", "value"))
    return long.where("value <> 0").withColumn("slot", F.col("slot").cast("long"))


def labelled_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")
    rows = K.split_stratified(rows, key="o_orderkey", by="o_orderstatus")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


def priced_parts(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
    rows = K.split_random(rows, key="p_partkey")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


def labelled_documents(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", "n_chars", "lang", "quality")
    rows = K.split_stratified(rows, key="doc_id", by="quality")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


@query("fit_transform_features", SPLIT_GAPS_SQL + """,
middle AS (SELECT median(c_acctbal) AS m FROM train WHERE NOT isnan(c_acctbal)),
frequent AS (SELECT c_mktsegment AS s FROM train WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT c_custkey, is_test, CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN (SELECT m FROM middle) ELSE c_acctbal END AS x,
                  coalesce(c_mktsegment, (SELECT s FROM frequent)) AS s FROM parts),
fitted AS (SELECT avg(x) AS mean, stddev_pop(x) AS spread FROM filled WHERE NOT is_test),
places AS (SELECT s, row_number() OVER (ORDER BY s) AS slot FROM (SELECT DISTINCT s FROM filled WHERE NOT is_test))
SELECT c_custkey, 0::BIGINT AS slot, round(((x - mean) / spread)::FLOAT::DOUBLE, 5) AS value FROM filled, fitted WHERE is_test
UNION ALL SELECT c_custkey, slot, 1.0 FROM filled JOIN places USING (s) WHERE is_test""")
def fit_transform_features(spark, sf):
    """Fitted on the training rows; the features of the test rows in long form."""
    train, test = gap_parts(spark, sf)
    _, out = X.fit_transform_features(train, test, target="c_nationkey", ignore=["c_custkey", "c_name"])
    from pyspark.ml.functions import vector_to_array

    long = out.select("c_custkey", F.posexplode_outer(vector_to_array("features")).alias("slot", "value"))
    long = long.where("value <> 0 OR slot = 0")
    return long.select("c_custkey", F.col("slot").cast("long").alias("slot"), F.round("value", 5).alias("value"))


# --- metrics ----------------------------------------------------------------------------------

GUESS_SQL = """
WITH scored AS (
  SELECT l_returnflag AS label,
         CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount < 0.05 THEN 'A' ELSE 'R' END AS guess,
         l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
"""


def guesses(spark, sf):
    flag = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_discount") < 0.05, "A").otherwise("R")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("label"), flag.alias("guess"), F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500).alias("p"),
    )


@query("classification_metrics", GUESS_SQL + """,
c AS (SELECT DISTINCT label AS c FROM scored),
f AS (SELECT c, (SELECT count(*) FROM scored WHERE label = c) AS support,
             (SELECT count(*) FROM scored WHERE guess = c) AS predicted,
             (SELECT count(*) FROM scored WHERE guess = c AND label = c) AS tp FROM c)
SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(support * coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) / sum(support), 6) AS f1_weighted FROM f""")
def classification_metrics(spark, sf):
    out = M.classification_metrics(guesses(spark, sf), label="label", prediction="guess")
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"))


@query("regression_metrics", GUESS_SQL + """
SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
       round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae FROM scored""")
def regression_metrics(spark, sf):
    out = M.regression_metrics(guesses(spark, sf), label="y", prediction="p")
    return out.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("prediction_summary", GUESS_SQL + """
SELECT guess AS prediction, count(*) AS n, (SELECT count(*) FROM scored) AS n_total FROM scored GROUP BY guess""")
def prediction_summary(spark, sf):
    return M.prediction_summary(guesses(spark, sf), task="classification", prediction="guess")


@query("prediction_summary_regression", GUESS_SQL + """
SELECT count(*) AS n_total, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std, min(p) AS min, max(p) AS max FROM scored""")
def prediction_summary_regression(spark, sf):
    out = M.prediction_summary(guesses(spark, sf), task="regression", prediction="p")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


# --- experiment log ---------------------------------------------------------------------------


@query("exp_best", LOG_SQL + """
(SELECT 'test_accuracy' AS metric, model, test_accuracy AS score, timestamp FROM log ORDER BY test_accuracy DESC, timestamp LIMIT 1)
UNION ALL (SELECT 'rmse', model, rmse, timestamp FROM log ORDER BY rmse, timestamp LIMIT 1)""")
def exp_best(spark, sf):
    log = experiment_log(spark, sf)
    best = [
        E.exp_best(log, metric=name).select(F.lit(E.resolve_metric(name)[0]).alias("metric"), "model", "score", "timestamp")
        for name in ("accuracy", "rmse")
    ]
    return best[0].unionByName(best[1])


@query("exp_recent", LOG_SQL + "SELECT model, timestamp FROM log ORDER BY timestamp DESC LIMIT 10")
def exp_recent(spark, sf):
    return E.exp_recent(experiment_log(spark, sf)).select("model", "timestamp")


@query("exp_count", LOG_SQL + "SELECT count(*) AS n_experiments FROM log")
def exp_count(spark, sf):
    return E.exp_count(experiment_log(spark, sf))


# --- models -----------------------------------------------------------------------------------


def _fitted(name, fit, parts, target, task, ignore):
    @query(name)
    def run(spark, sf):
        train, test = parts(spark, sf)
        model = fit(train, target=target, ignore=ignore)
        scored = L.predict_with(model, test)
        metric = M.classification_metrics if task == "classification" else M.regression_metrics
        return metric(scored, label=target, prediction="predictions")

    return run


for _name, _fit in [
    ("train_logistic", L.train_logistic), ("train_forest_classifier", L.train_forest_classifier),
]:
    _fitted(_name, _fit, labelled_orders, "o_orderstatus", "classification", ["o_orderkey"])
_fitted("train_linear_svc", L.train_linear_svc, labelled_orders, "o_orderstatus", "classification", ["o_orderkey"])
for _name, _fit in [
    ("train_ridge", L.train_ridge), ("train_forest_regressor", L.train_forest_regressor), ("train_linear_svr", L.train_linear_svr),
]:
    _fitted(_name, _fit, priced_parts, "p_retailprice", "regression", [])


LINE_SQL = """
WITH parts AS (SELECT o_orderkey, o_custkey::DOUBLE AS x, o_totalprice AS y,
                      row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS is_test FROM orders),
scale AS (SELECT avg(x) AS mean, stddev_pop(x) AS spread FROM parts WHERE NOT is_test),
z AS (SELECT o_orderkey, is_test, y, ((x - mean) / spread)::FLOAT::DOUBLE AS z FROM parts, scale),
centre AS (SELECT avg(z) AS mz, avg(y) AS my FROM z WHERE NOT is_test),
slope AS (SELECT sum((z - mz) * (y - my)) / (sum((z - mz) ** 2) + 1) AS b FROM z, centre WHERE NOT is_test),
scored AS (SELECT o_orderkey, y, my + b * (z - mz) AS p FROM z, centre, slope WHERE is_test)
"""


def priced_orders(spark, sf):
    rows = K.split_random(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), key="o_orderkey")
    return rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")


@query("train_ridge_line", LINE_SQL + """
SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 3) AS rmse,
       round(avg(abs(y - p)), 3) AS mae FROM scored""")
def train_ridge_line(spark, sf):
    """Ridge on one feature, where the solution is a formula."""
    train, test = priced_orders(spark, sf)
    model = L.train_ridge(train, target="o_totalprice", ignore=["o_orderkey"])
    out = M.regression_metrics(L.predict_with(model, test), label="o_totalprice", prediction="predictions")
    return out.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query("batch_predict_regression", LINE_SQL + "SELECT o_orderkey, y AS o_totalprice, round(p, 3) AS predictions FROM scored")
def batch_predict_regression(spark, sf):
    """The same model stored, loaded and applied to the held-out rows."""
    train, test = priced_orders(spark, sf)
    path = scratch_path(spark, "champion")
    L.save_champion(L.train_ridge(train, target="o_totalprice", ignore=["o_orderkey"]), path, task="regression", metrics={})
    out = L.batch_predict(L.load_champion(spark, path).model, test)
    return out.select("o_orderkey", "o_totalprice", F.round("predictions", 3).alias("predictions"))


@query("train_all_and_rank")
def train_all_and_rank(spark, sf):
    train, test = priced_parts(spark, sf)
    return L.results_frame(spark, L.train_all_and_rank(train, test, target="p_retailprice", task="regression"))


@query("save_champion")
def save_champion(spark, sf):
    train, test = priced_parts(spark, sf)
    model = L.train_ridge(train, target="p_retailprice")
    path = scratch_path(spark, "champion")
    L.save_champion(model, path, task="regression", metrics=L.holdout_score(model, test, target="p_retailprice", task="regression"))
    champion = L.load_champion(spark, path)
    return L.predict_with(champion.model, test).select("p_partkey", F.round("predictions", 6).alias("predictions"))


@query("holdout_score")
def holdout_score(spark, sf):
    train, test = labelled_orders(spark, sf)
    model = L.train_logistic(train, target="o_orderstatus", ignore=["o_orderkey"])
    scores = L.holdout_score(model, test, target="o_orderstatus", task="classification")
    return test.agg(F.count("*").alias("n_test")).withColumns({k: F.lit(v) for k, v in scores.items()})


@query("batch_predict")
def batch_predict(spark, sf):
    train, test = labelled_orders(spark, sf)
    model = L.train_logistic(train, target="o_orderstatus", ignore=["o_orderkey"])
    return L.batch_predict(model, test)


for _name, _search, _parts, _target, _key in [
    ("search_logistic", L.search_logistic, labelled_orders, "o_orderstatus", "o_orderkey"),
    ("search_forest_classifier", L.search_forest_classifier, labelled_orders, "o_orderstatus", "o_orderkey"),
    ("search_svc", L.search_svc, labelled_documents, "quality", "doc_id"),
    ("search_ridge", L.search_ridge, priced_parts, "p_retailprice", "p_partkey"),
    ("search_forest_regressor", L.search_forest_regressor, priced_parts, "p_retailprice", "p_partkey"),
    ("search_svr", L.search_svr, priced_parts, "p_retailprice", "p_partkey"),
]:

    def _run(spark, sf, search=_search, parts=_parts, target=_target, key=_key):
        train, _ = parts(spark, sf)
        return search(train, target=target, key=key).trials

    query(_name)(_run)
