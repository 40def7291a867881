"""Anomalies, models, neighbours."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, models, neighbors
from ..storage import load
from .basic_queries import LINE_KEY, PRICES
from .registry import query, union_all


def _marked(spark, folder) -> DataFrame:
    return anomaly.isolation_forest(load(spark, folder, "lineitem"), LINE_KEY, PRICES)


@query("isolation_forest")
def isolation_forest(spark, folder):
    return _marked(spark, folder).select(*LINE_KEY, *PRICES, F.round("score", 6).alias("score"), "severity", "is_anomaly", "status")


@query("anomaly_summary")
def anomaly_summary(spark, folder):
    return anomaly.anomaly_summary(_marked(spark, folder))


@query("anomaly_topk")
def anomaly_topk(spark, folder):
    return anomaly.anomaly_topk(_marked(spark, folder), LINE_KEY).withColumn("score", F.round("score", 6))


# What must hold for results that SQL cannot compute; the shares are checked against their bounds.


@query("isolation_forest_facts", sql="""
SELECT count(*) AS "rows", count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS keys, 0.0::DOUBLE AS least_severity,
  1.0::DOUBLE AS most_severity, true AS share_holds, true AS labels_agree, true AS flagged_are_most_severe FROM lineitem""")
def isolation_forest_facts(spark, folder):
    flagged = F.col("is_anomaly")
    facts = _marked(spark, folder).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(*LINE_KEY).alias("keys"), F.min("severity").alias("least_severity"),
        F.max("severity").alias("most_severity"), F.avg(flagged.cast("double")).alias("share"),
        F.bool_and(flagged == (F.col("status") == "Anomaly")).alias("labels_agree"),
        F.min(F.when(flagged, F.col("severity"))).alias("worst"), F.max(F.when(~flagged, F.col("severity"))).alias("rest"),
    )
    return facts.select(
        "rows", "keys", "least_severity", "most_severity", F.col("share").between(0.045, 0.0505).alias("share_holds"),
        "labels_agree", (F.col("worst") >= F.col("rest")).alias("flagged_are_most_severe"),
    )


TASK_CASE = "CASE WHEN n = 0 THEN NULL WHEN textual OR d <= 2 OR (d <= 10 AND d / n < 0.15) THEN 'classification' ELSE 'regression' END"


@query("task_types", sql=f'SELECT "column", {TASK_CASE} AS task FROM (' + union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS d, {t} AS textual FROM lineitem" for c, t in
    [(c, False) for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PRICES, "l_shipdate"]]
    + [(c, True) for c in ["l_returnflag", "l_linestatus"]]) + ")")
def task_types(spark, folder):
    return models.task_types(load(spark, folder, "lineitem"))


@query("feature_roles", sql=union_all(
    [f"SELECT '{c}' AS \"column\", 'numeric' AS role" for c in ["o_orderkey", "o_custkey"]]
    + [f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) BETWEEN 2 AND 25 THEN 'categorical' ELSE 'dropped' END FROM orders"
       for c in ["o_orderstatus", "o_orderdate", "o_orderpriority"]]))
def feature_roles(spark, folder):
    return models.feature_roles(load(spark, folder, "orders"), "o_totalprice")


@query("holdout_split")
def holdout_split(spark, folder):
    return models.holdout_split(load(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"])


@query("holdout_split_facts", sql="""
SELECT count(*) AS "rows", count(DISTINCT o_orderkey) AS keys, true AS share_holds, true AS same_after_repartition FROM orders""")
def holdout_split_facts(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey")
    one = models.holdout_split(orders, ["o_orderkey"])
    two = models.holdout_split(orders.repartition(7), ["o_orderkey"]).withColumnRenamed("is_train", "again")
    return one.join(two, "o_orderkey").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"),
        F.avg((~F.col("is_train")).cast("double")).between(0.17, 0.23).alias("share_holds"),
        F.bool_and(F.col("is_train") == F.col("again")).alias("same_after_repartition"),
    )


GUESS = "CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END"


def _guessed(spark, folder):
    return load(spark, folder, "orders").select(F.col("o_orderstatus").alias("label"), F.expr(GUESS).alias("prediction"))


@query("confusion_matrix", sql=f'SELECT o_orderstatus AS label, {GUESS} AS prediction, count(*) AS "count" FROM orders GROUP BY ALL')
def confusion_matrix(spark, folder):
    return models.confusion_matrix(_guessed(spark, folder))


@query("classification_metrics", sql=f"""
WITH t AS (SELECT o_orderstatus AS l, {GUESS} AS p FROM orders),
c AS (SELECT l, count(*) AS support, count(*) FILTER (l = p) AS hits FROM t GROUP BY l),
g AS (SELECT p, count(*) AS given FROM t GROUP BY p),
m AS (SELECT support, hits, coalesce(hits / given, 0) AS pr, hits / support AS re FROM c LEFT JOIN g ON l = p)
SELECT round(sum(hits) / sum(support), 4) AS accuracy, round(sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / sum(support), 4) AS f1,
  round(sum(support * pr) / sum(support), 4) AS "precision", round(sum(support * re) / sum(support), 4) AS recall FROM m""")
def classification_metrics(spark, folder):
    return models.classification_metrics(_guessed(spark, folder))


@query("regression_metrics", sql="""
SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae
FROM (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 2000 AS e FROM lineitem)""")
def regression_metrics(spark, folder):
    rows = load(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))
    return models.regression_metrics(rows)


HITS = """hits AS (SELECT a.vec_id, b.vec_id AS neighbor, b.label, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
    lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) <= 5)"""


@query("nearest_neighbors", sql=f"""
WITH {HITS} SELECT vec_id, neighbor, round(distance, 4) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY hits.distance, neighbor) AS rank FROM hits""")
def nearest_neighbors(spark, folder):
    e = load(spark, folder, "embeddings")
    return neighbors.nearest_neighbors(e, e, "vec_id", "embedding", itself=True).withColumn("distance", F.round("distance", 4))


@query("nearest_neighbors_large", sql=f"""
WITH {HITS} SELECT vec_id, neighbor, round(distance, 4) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY hits.distance, neighbor) AS rank FROM hits""")
def nearest_neighbors_large(spark, folder):
    """The plan of training rows that may not be broadcast."""
    e = load(spark, folder, "embeddings")
    return neighbors.nearest_neighbors(e, e, "vec_id", "embedding", itself=True, broadcast_bytes=100_000).withColumn("distance", F.round("distance", 4))


@query("nearest_orders", sql="""
WITH o AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS x, o_custkey / 10 AS y FROM orders),
h AS (SELECT a.k AS o_orderkey, b.k AS neighbor, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM (SELECT * FROM o WHERE k % 100 = 0) a JOIN o b ON a.k <> b.k
  QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY d, b.k) <= 3)
SELECT o_orderkey, round(sqrt(d), 4) AS distance, row_number() OVER (PARTITION BY o_orderkey ORDER BY d, neighbor) AS rank FROM h""")
def nearest_orders(spark, folder):
    """Orders like every hundredth one, by price and customer: few dimensions, so most cells stay unseen."""
    o = load(spark, folder, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 1000, F.col("o_custkey") / 10).alias("v"))
    got = neighbors.nearest_neighbors(o.where("o_orderkey % 100 = 0"), o, "o_orderkey", "v", k=3, itself=True)
    return got.select("o_orderkey", F.round("distance", 4).alias("distance"), "rank")


@query("knn_classify", sql=f"""
WITH {HITS}, v AS (SELECT vec_id, label, count(*) AS votes FROM hits GROUP BY ALL)
SELECT vec_id, label AS prediction, votes FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1""")
def knn_classify(spark, folder):
    e = load(spark, folder, "embeddings")
    return neighbors.knn_classify(e, e, "vec_id", "embedding", "label", itself=True)


@query("knn_regress", sql=f"WITH {HITS} SELECT vec_id, avg(label) AS prediction FROM hits GROUP BY 1")
def knn_regress(spark, folder):
    e = load(spark, folder, "embeddings")
    return neighbors.knn_regress(e, e, "vec_id", "embedding", "label", itself=True)


# --- tournaments ------------------------------------------------------------------------------


def _labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


def _quality_tournament(spark: SparkSession, folder: str) -> models.Tournament:
    return models.run_tournament(_labelled_documents(spark, folder), "quality", ["doc_id"])


@query("leaderboard")
def leaderboard(spark, folder):
    return _quality_tournament(spark, folder).leaderboard()


@query("leaderboard_regression")
def leaderboard_regression(spark, folder):
    parts = load(spark, folder, "part").drop("p_name")
    return models.run_tournament(parts, "p_retailprice", ["p_partkey"]).leaderboard()


@query("leaderboard_facts", sql="""
SELECT CAST(r AS BIGINT) AS rank, 'regression' AS task, true AS fitted, true AS in_order FROM range(1, 6) AS t(r)""")
def leaderboard_facts(spark, folder):
    parts = load(spark, folder, "part").drop("p_name")
    board = models.run_tournament(parts, "p_retailprice", ["p_partkey"]).leaderboard()
    # the board holds one row per candidate
    better = board.select((F.col("rank") + 1).alias("rank"), F.col("r2").alias("above"))
    return board.join(better, "rank", "left").select(
        "rank", "task", (F.col("error").isNull() & (F.col("rmse") >= F.col("mae"))).alias("fitted"),
        F.coalesce(F.col("r2") <= F.col("above"), F.lit(True)).alias("in_order"),
    )


@query("feature_importance")
def feature_importance(spark, folder):
    return _quality_tournament(spark, folder).feature_importance()


@query("batch_score")
def batch_score(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return _quality_tournament(spark, folder).score(docs).drop("probabilities")


@query("batch_score_facts", sql="""
SELECT count(*) AS "rows", count(DISTINCT doc_id) AS keys, true AS known_classes, true AS confidence_holds FROM documents""")
def batch_score_facts(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    scored = _quality_tournament(spark, folder).score(docs)
    likeliest = F.element_at("probabilities", F.col("prediction"))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("keys"),
        F.bool_and(F.col("prediction").isin("0", "1")).alias("known_classes"),
        F.bool_and(F.col("confidence").between(0.5, 1.0) & (likeliest == F.col("confidence"))).alias("confidence_holds"),
    )
