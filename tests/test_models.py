"""Anomalies, neighbours, metrics and the tournament."""

import os
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabsense.operators import anomaly, models, neighbors


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": range(81), "f1": rng.normal(10, 2, 81), "f2": rng.normal(5, 1, 81)})
    pdf.loc[80, ["f1", "f2"]] = [100.0, -50.0]
    pdf.loc[3, "f1"] = np.nan
    return spark.createDataFrame(pdf)


def test_planted_row_is_flagged(planted):
    out = anomaly.isolation_forest(planted, ["id"], ["f1", "f2"])
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 81 and rows[80]["is_anomaly"] and rows[80]["status"] == "Anomaly" and rows[80]["severity"] == 1.0
    s = anomaly.anomaly_summary(out).first()
    assert 0 < s["outlier_count"] <= 6 and s["total_records"] == 81
    assert anomaly.anomaly_topk(out, ["id"]).first()["id"] == 80


def test_scores_do_not_depend_on_partitions(planted):
    scores = [
        {r["id"]: r["score"] for r in anomaly.isolation_forest(df, ["id"], ["f1", "f2"], trees=20).collect()}
        for df in (planted.repartition(7), planted.coalesce(1))
    ]
    assert scores[0] == scores[1]


def test_pool_sampling_on_more_rows(spark):
    df = spark.range(3000).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    df = df.withColumn("a", F.when(F.col("id") == 7, 50.0).otherwise(F.col("a")))
    out = anomaly.isolation_forest(df, ["id"], ["a", "b"], trees=4)
    assert out.where("id = 7").first()["is_anomaly"] in (True, False)
    assert 0 < out.where("is_anomaly").count() <= 150 and out.count() == 3000


def test_forest_input_checks(spark, planted):
    with pytest.raises(ValueError):
        anomaly.isolation_forest(planted, ["id"], ["f1"])
    with pytest.raises(ValueError):
        anomaly.isolation_forest(planted.limit(5), ["id"], ["f1", "f2"])


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (10.0, None)], "x double, void double")
    out = anomaly.median_impute(df, ["x", "void"])
    assert out.columns == ["x"] and sorted(r["x"] for r in out.collect()) == [1.0, 3.0, 3.0, 10.0]
    scaled = sorted(r["x"] for r in anomaly.robust_scale(out, ["x"]).collect())
    assert scaled[1] == 0.0


@pytest.mark.parametrize("limit", [1 << 20, 900])
def test_neighbours_match_brute_force(spark, limit):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (90, 3)).astype(float)  # many equal distances
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id bigint, v array<double>, label int")
    got = neighbors.nearest_neighbors(df, df, "id", "v", 5, itself=True, broadcast_bytes=limit).orderBy("id", "rank").collect()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(90):
        want = sorted((d[i, j], j) for j in range(90) if j != i)[:5]
        mine = [(r["distance"], r["neighbor"]) for r in got if r["id"] == i]
        assert [j for _, j in mine] == [j for _, j in want]
        assert np.allclose([a for a, _ in mine], np.sqrt([a for a, _ in want]))
    votes = neighbors.knn_classify(df, df, "id", "v", "label", itself=True, broadcast_bytes=limit)
    assert votes.count() == 90
    mean = neighbors.knn_regress(df, df, "id", "v", "label", itself=True, broadcast_bytes=limit).where("id = 0").first()
    first = sorted((d[0, j], j) for j in range(1, 90))[:5]
    assert mean["prediction"] == pytest.approx(np.mean([j % 4 for _, j in first]))


@pytest.mark.parametrize("limit", [1 << 30, 40_000])
def test_cells_leave_most_rows_unseen(spark, limit):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.5, (100, 3)) for c in rng.uniform(-50, 50, (20, 3))])
    x[::97] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    pairs = spark.sparkContext.accumulator(0)
    got = neighbors.nearest_neighbors(df, df, "id", "v", 4, itself=True, broadcast_bytes=limit, pairs=pairs).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:4])}
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == want
    assert len(x) < pairs.value < len(x) ** 2 / 10


def _nearest(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])}


def test_large_plan_writes_little(spark):
    """Queries used to be written once for every cell they may need."""
    x = np.random.default_rng(6).integers(-50, 50, (1500, 32)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    before = size()
    got = neighbors.nearest_neighbors(df, df, "id", "v", 3, itself=True, broadcast_bytes=100_000).collect()
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == _nearest(x, 3)
    assert size() - before < 8 * x.nbytes


def test_shelves_are_dealt_alike(spark):
    """Groups of shelf and slice used to meet in a few tasks by the hash of their numbers."""
    keys = neighbors._dealing(spark, [1.0] * 100, 100)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert df.repartition(100, "k").select(F.spark_partition_id().alias("p")).distinct().count() == 100
    weights = [float(1 + i % 7) for i in range(90)]
    keys = neighbors._dealing(spark, weights, 8)
    df = spark.createDataFrame(list(zip(keys, weights)), "k bigint, w double")
    loads = [r["w"] for r in df.repartition(8, "k").groupBy(F.spark_partition_id()).agg(F.sum("w").alias("w")).collect()]
    assert len(set(keys)) == 90 and len(loads) == 8 and max(loads) - min(loads) <= 7


@pytest.mark.parametrize("limit", [1 << 30, 40_000])
@pytest.mark.parametrize("scale", [1e20, 1.0])
def test_products_of_large_numbers(spark, limit, scale):
    """Squares beyond single precision used to lose neighbours."""
    x = np.random.default_rng(9).normal(0, scale, (900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = neighbors.nearest_neighbors(df, df, "id", "v", 3, itself=True, broadcast_bytes=limit).collect()
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == _nearest(x, 3)


@pytest.mark.parametrize("scale, away", [(1.0, 0.0), (1.0, 1e6), (1e-8, 1.0), (1e20, 0.0)])
def test_distances_to_centres_are_bounded_by_products(scale, away):
    """All centres used to be measured one dimension at a time, the longest task of 100,000 rows."""
    rng = np.random.default_rng(3)
    x, centres = rng.normal(away, scale, (2000, 64)), rng.normal(away, scale, (400, 64))
    x[:400] = centres
    began = time.perf_counter()
    lo, hi = neighbors._distances(x, centres)
    fast, began = time.perf_counter() - began, time.perf_counter()
    exact = np.sqrt(neighbors._squared(x, centres))
    assert fast < (time.perf_counter() - began) / 2
    assert (lo <= exact).all() and (exact <= hi).all()
    far = exact > exact.max() / 10
    assert (hi - lo)[far].max() < 1e-9 * exact.max()


def test_few_dimensions_are_measured():
    x = np.random.default_rng(3).normal(0, 1, (50, 3))
    lo, hi = neighbors._distances(x, x[:7])
    assert (lo == hi).all() and (lo == np.sqrt(neighbors._squared(x, x[:7]))).all()


@pytest.mark.parametrize("limit", [1 << 30, 40_000])
def test_clusters_of_many_dimensions(spark, limit):
    """Cells are left out by bounds of their distances."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.01, (60, 16)) for c in rng.uniform(-50, 50, (20, 16))])
    x[::97] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    pairs = spark.sparkContext.accumulator(0)
    got = neighbors.nearest_neighbors(df, df, "id", "v", 4, itself=True, broadcast_bytes=limit, pairs=pairs).collect()
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == _nearest(x, 4)
    assert len(x) < pairs.value < len(x) ** 2 / 4


@pytest.mark.parametrize("limit", [1 << 30, 40_000])
@pytest.mark.parametrize("dims", [3, 16])
def test_a_nan_costs_the_others_nothing(spark, limit, dims):
    """One in twenty vectors has a NaN; as a centre, or beside other rows in a product, it used to hide their neighbours."""
    x = np.random.default_rng(14).normal(0, 1, (1800, dims))
    x[::20, 1] = np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = neighbors.nearest_neighbors(df, df, "id", "v", 3, itself=True, broadcast_bytes=limit).collect()
    want = {at: j for at, j in _nearest(np.nan_to_num(x, nan=1e6), 3).items() if at[0] % 20}
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == want


@pytest.mark.parametrize("limit", [1 << 30, 1000])
def test_equal_vectors_are_searched_once(spark, limit):
    """Rows far more than vectors, in more dimensions than a few."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (20, 12)).astype(float)[rng.integers(0, 20, 1200)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(5)
    pairs = spark.sparkContext.accumulator(0)
    got = neighbors.nearest_neighbors(df, df, "id", "v", 4, itself=True, broadcast_bytes=limit, pairs=pairs).collect()
    assert {(r["id"], r["rank"]): r["neighbor"] for r in got} == _nearest(x, 4)
    assert pairs.value <= 20 * 20 * 5
    lone = df.where("id = 7")
    other = neighbors.nearest_neighbors(lone, df.where("id <> 7"), "id", "v", 4, broadcast_bytes=limit).orderBy("rank").collect()
    assert [r["neighbor"] for r in other] == [j for (i, _), j in sorted(_nearest(x, 4).items()) if i == 7]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Broadcast rows used to name a class that workers outside the repository can't import."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from tabsense.operators import neighbors
df = spark.range(50).select("id", F.array(F.col("id").cast("double")).alias("v"))
got = neighbors.nearest_neighbors(df.where("id = 7"), df, "id", "v", 3, itself=True).orderBy("rank").collect()
assert [r["neighbor"] for r in got] == [6, 8, 5], got
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    m = models.classification_metrics(df).first()
    # per class: a p=1 r=.5, b p=1/3 r=1, c p=0 r=0
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.5, round((2 * 1 + 1 / 3) / 4, 4), 0.5)
    assert m["f1"] == round((2 * (2 / 3) + 0.5) / 4, 4)
    reg = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "label double, prediction double")
    r = models.regression_metrics(reg).first()
    assert (r["r2"], r["rmse"], r["mae"]) == (0.0, 0.8165, 0.6667)


@pytest.fixture(scope="module")
def churn(spark):
    rng = np.random.default_rng(10)
    age = rng.integers(18, 70, 120)
    pdf = pd.DataFrame({
        "id": range(120), "age": age, "income": rng.normal(50000, 9000, 120), "plan": rng.choice(["basic", "pro", "max"], 120),
        "churn": (age > 40).astype(int),
    })
    return spark.createDataFrame(pdf)


def test_task_rules(spark, churn):
    tasks = {r["column"]: r["task"] for r in models.task_types(churn).collect()}
    assert tasks["churn"] == "classification" and tasks["plan"] == "classification" and tasks["income"] == "regression"
    with pytest.raises(ValueError):
        models.infer_task(churn, "nope")
    with pytest.raises(ValueError):
        models.infer_task(churn.withColumn("none", F.lit(None).cast("double")), "none")


def test_roles_and_preparation(spark, churn):
    roles = {r["column"]: r["role"] for r in models.feature_roles(churn, "churn").collect()}
    assert roles == {"id": "numeric", "age": "numeric", "income": "numeric", "plan": "categorical"}
    prep = models.fit_preparation(churn, "churn", ["id"])
    assert prep.names == ["num__age", "num__income", "cat__plan_basic", "cat__plan_max", "cat__plan_pro"]
    row = spark.createDataFrame([(None, None, "unknown")], "age int, income double, plan string")
    cells = row.select(prep.features(row).alias("f")).first()["f"]
    assert cells[2:] == [0.0, 0.0, 0.0] and all(abs(v) < 1 for v in cells[:2])
    with pytest.raises(ValueError):
        models.fit_preparation(churn.select("churn"), "churn")


def test_split_is_stable(churn):
    a = {r["id"]: r["is_train"] for r in models.holdout_split(churn.repartition(5), ["id"]).collect()}
    b = {r["id"]: r["is_train"] for r in models.holdout_split(churn.coalesce(1), ["id"]).collect()}
    assert a == b and 0.6 < sum(a.values()) / len(a) < 0.95


def test_classification_tournament(churn):
    # an observed query leaves state in the session that must not travel with a model
    churn.observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    t = models.run_tournament(churn, "churn", ["id"], models=["Logistic Regression", "Decision Tree", "K-Nearest Neighbors"])
    board = t.leaderboard().collect()
    assert [(r["rank"], r["error"]) for r in board] == [(1, None), (2, None), (3, None)]
    assert board[0]["f1"] >= board[-1]["f1"] and board[0]["f1"] > 0.8 and board[0]["classes"] == "0, 1"
    cells = t.confusion().collect()
    train = {r["id"]: r["is_train"] for r in models.holdout_split(churn, ["id"]).collect()}
    for r in board:
        own = [c for c in cells if c["model"] == r["model"]]
        tested = sum(c["count"] for c in own)
        assert tested == sum(not v for v in train.values()) and {c["label"] for c in own} <= {"0", "1"}
        assert r["accuracy"] == round(sum(c["count"] for c in own if c["label"] == c["prediction"]) / tested, 4)
    assert t.confusion("Decision Tree").count() == len([c for c in cells if c["model"] == "Decision Tree"])
    imp = t.feature_importance("Decision Tree").collect()
    assert imp[0]["feature"] == "num__age" and len(imp) <= 15
    assert t.feature_importance("K-Nearest Neighbors").count() == 0
    scored = t.score(churn).collect()
    assert len(scored) == 120 and {r["prediction"] for r in scored} <= {"0", "1"}
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-3 for r in scored)
    assert all(r["confidence"] == max(r["probabilities"].values()) for r in scored)
    t.close()


def test_regression_tournament(spark):
    rng = np.random.default_rng(11)
    units = rng.integers(1, 100, 120)
    pdf = pd.DataFrame({"id": range(120), "units": units, "region": rng.choice(list("NSEW"), 120), "revenue": 2.5 * units + rng.normal(0, 1, 120)})
    df = spark.createDataFrame(pdf)
    t = models.run_tournament(df, "revenue", ["id"], models=["Ridge Regression", "Decision Tree", "K-Nearest Neighbors"])
    best = t.leaderboard().first()
    assert best["r2"] > 0.95 and t.task == "regression"
    assert t.score(df).where("prediction IS NULL").count() == 0


def test_a_table_in_one_split_is_dealt_to_all_cores(spark):
    one = spark.range(0, 90_000, 1, 1).select("id", (F.col("id") % 97).alias("a"), (F.sin("id") + F.col("id") % 7).alias("y"))
    boards, importances = [], []
    for df in (one, one.repartition(5)):
        t = models.run_tournament(df, "y", ["id"], models=["Decision Tree"])
        sizes = [r["count"] for r in t.train.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.1 * min(sizes)
        boards.append([r["r2"] for r in t.leaderboard().collect()])
        importances.append(t.fitted["Decision Tree"].importances)
        t.close()
    assert boards[0] == boards[1] and importances[0] == importances[1]


def test_multiclass_boosting_runs_one_model_per_class(churn):
    t = models.run_tournament(churn.select("id", "age", "plan"), "plan", ["id"], models=["Gradient Boosting"])
    r = t.leaderboard().first()
    assert r["error"] is None and r["classes"] == "basic, max, pro"
    assert t.score(churn.select("id", "age", "plan")).count() == 120


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (2, 3.0, 1)], "id int, x double, y int")
    with pytest.raises(ValueError, match="15 rows"):
        models.run_tournament(df, "y", ["id"])


def test_a_failing_candidate_is_recorded(churn, monkeypatch):
    real = models._fitters

    def broken(*args):
        out = real(*args)
        out["Decision Tree"] = lambda train: (_ for _ in ()).throw(RuntimeError("no fit"))
        return out

    monkeypatch.setattr(models, "_fitters", broken)
    board = models.run_tournament(churn, "churn", ["id"], models=["Decision Tree", "Logistic Regression"]).leaderboard().collect()
    assert board[-1]["model"] == "Decision Tree" and "no fit" in board[-1]["error"] and board[-1]["f1"] is None
