"""Predictive models: task inference, preparation, a tournament, metrics and batch scoring."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, is_text, named, number, present
from ..functions.rounding import half_up
from ..storage import new_folder, shared_dir
from .basics import distinct_where_unclear
from .neighbors import knn_regress, nearest_neighbors
from .ordering import numeric_quantiles, value_counts

CLASSIFICATION, REGRESSION = "classification", "regression"
MAX_CATEGORIES = 25
MIN_ROWS = 15
# class labels are held on the driver; by default a target with more is not taken for a class label
MAX_CLASSES = 1000
# a fit has tasks of so many rows at least, and at most, even if that makes more than two tasks a core
ROWS_PER_PARTITION = 20_000
MOST_PER_PARTITION = 250_000


# --- what to predict, and from what ------------------------------------------


def _task_rule(textual: Column, unique: Column, n: Column) -> Column:
    few = (unique <= 2) | ((unique <= 10) & (unique / n < 0.15))
    return F.when(textual | few, CLASSIFICATION).otherwise(REGRESSION)


def task_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, task)``: the task each column would set as a target."""
    chosen = list(columns or df.columns)
    rows = df.agg(*[F.count(present(df, c)).alias(c) for c in chosen]).unpivot([], [named(c) for c in chosen], "column", "n")
    textual = F.col("column").isin(
        [c for c in chosen if is_text(df, c) or isinstance(df.schema[c].dataType, T.BooleanType)]
    )
    # the rules look at ten values at most: a clear estimate above that is enough
    counts = distinct_where_unclear(df, chosen, lambda estimate, n: estimate > 50)
    both = rows.join(F.broadcast(counts), "column")
    return both.select("column", F.when(F.col("n") > 0, _task_rule(textual, F.col("distinct"), F.col("n"))).alias("task"))


def infer_task(df: DataFrame, target: str) -> str:
    if target not in df.columns:
        raise ValueError(f"no column named {target!r} to predict")
    task = task_types(df, [target]).first()["task"]
    if task is None:
        raise ValueError(f"{target!r} has no value to learn from")
    return task


def feature_roles(df: DataFrame, target: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """``(column, role)``: numeric, categorical (2 to 25 values) or dropped."""
    rest = [c for c in df.columns if c != target]
    numbers = [c for c in rest if is_numeric(df, c)]
    others = [c for c in rest if c not in numbers]
    spark = df.sparkSession
    known = spark.createDataFrame([(c, "numeric") for c in numbers], "column string, role string")
    if not others:
        return known
    counts = distinct_where_unclear(df, others, lambda estimate, n: estimate > 3 * max_categories + 20)
    role = F.when((F.col("distinct") > 1) & (F.col("distinct") <= max_categories), "categorical").otherwise("dropped")
    return known.unionByName(counts.select("column", role.alias("role")))


@dataclass
class Preparation:
    """Fitted preprocessing as plain column expressions: a few constants per column."""

    numeric: dict[str, tuple[float, float, float]]  # median, mean, population std
    categorical: dict[str, tuple[str, list[str]]]  # mode, known values

    @property
    def names(self) -> list[str]:
        out = [f"num__{c}" for c in self.numeric]
        for c, (_, values) in self.categorical.items():
            out += [f"cat__{c}_{v}" for v in values]
        return out

    def features(self, df: DataFrame) -> Column:
        """Scaled numbers, then one 0/1 slot per known value; unseen values are all zeros."""
        cells = []
        for c, (med, mean, sd) in self.numeric.items():
            cells.append((F.coalesce(number(df, c), F.lit(med)) - F.lit(mean)) / F.lit(sd))
        for c, (mode, values) in self.categorical.items():
            v = F.coalesce(present(df, c).cast("string"), F.lit(mode))
            cells += [(v == x).cast("double") for x in values]
        return F.array(*cells)


def fit_preparation(df: DataFrame, target: str, exclude: Sequence[str] = (), train: DataFrame | None = None) -> Preparation:
    """Roles are read off the whole table, the constants off the training rows."""
    table = df.drop(*exclude)
    roles = {r["column"]: r["role"] for r in feature_roles(table, target).collect()}
    numbers = [c for c in table.columns if roles.get(c) == "numeric"]
    categories = [c for c in table.columns if roles.get(c) == "categorical"]
    train = df if train is None else train
    med = {c: (q[0] if q else None) for c, q in numeric_quantiles(train, numbers, [0.5]).items()}
    numbers = [c for c in numbers if med[c] is not None]
    numeric = {}
    if numbers:
        filled = {c: F.coalesce(number(train, c), F.lit(med[c])) for c in numbers}
        s = train.agg(
            *[F.avg(filled[c]).alias(f"m{i}") for i, c in enumerate(numbers)],
            *[F.stddev_pop(filled[c]).alias(f"s{i}") for i, c in enumerate(numbers)],
        ).first()
        numeric = {c: (med[c], s[f"m{i}"], s[f"s{i}"] or 1.0) for i, c in enumerate(numbers)}
    categorical = {}
    if categories:
        counted = value_counts(train, {c: present(train, c).cast("string") for c in categories})
        per: dict[str, list] = {c: [] for c in categories}
        for r in counted.collect():  # at most 25 values per column
            per[r["column"]].append((-r["n"], r["value"]))
        categorical = {c: (min(v)[1], sorted(x for _, x in v)) for c, v in per.items() if v}
    if not numeric and not categorical:
        raise ValueError("none of the columns can serve as a feature")
    return Preparation(numeric, categorical)


def holdout_split(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_train``. A hash of the key decides, so a row never changes sides between runs."""
    h = F.pmod(F.xxhash64(*[named(k) for k in key], F.lit(seed)), F.lit(10_000))
    return df.withColumn("is_train", h >= int(test_share * 10_000))


# --- metrics -------------------------------------------------------------------


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(named(label).alias("label"), named(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1, precision and recall from the confusion counts."""
    cm = confusion_matrix(df, label, prediction)
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0))
    truth = cm.groupBy("label").agg(F.sum("count").alias("support"), hit.alias("hits"))
    given = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    per = truth.join(given, "label", "left").select(
        "support", "hits",
        F.coalesce(F.try_divide("hits", F.coalesce("predicted", F.lit(0))), F.lit(0.0)).alias("p"),
        F.try_divide("hits", "support").alias("r"),
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    weighted = lambda c: F.round(F.sum(F.col("support") * c) / F.sum("support"), 4)
    return per.agg(
        F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"), weighted(f1).alias("f1"),
        weighted(F.col("p")).alias("precision"), weighted(F.col("r")).alias("recall"),
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2, RMSE and MAE in one aggregate."""
    y, e = named(label).cast("double"), named(label).cast("double") - named(prediction).cast("double")
    return df.agg(
        F.round(1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y)), 4).alias("r2"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"),
    )


# --- candidates ------------------------------------------------------------------


@dataclass
class Candidate:
    """A fitted model: adds ``prediction`` (class index or value) and ``probability`` (array or null)."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    importances: list[float] = field(default_factory=list)


def _without_summary(spark: SparkSession, model):
    """A training summary holds the session, which cannot always travel with the scoring job: reload without it."""
    if not getattr(model, "hasSummary", False):
        return model
    path = new_folder(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def _spark_model(name: str, model, classes: int) -> Candidate:
    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        p = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
        keep = [c for c in df.columns]
        return out.select(*keep, F.col("prediction").cast("double").alias("prediction"), p.alias("probability"))

    imp: list[float] = []
    if hasattr(model, "featureImportances"):
        imp = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficientMatrix"):
        m = abs(model.coefficientMatrix.toArray()).mean(axis=0)
        imp = [float(v) for v in m]
    elif hasattr(model, "coefficients"):
        imp = [float(v) for v in abs(model.coefficients.toArray())]
    elif hasattr(model, "models"):  # one model per class
        arrays = [m.featureImportances.toArray() for m in model.models]
        imp = [float(v) for v in sum(arrays) / len(arrays)]
    return Candidate(name, apply, imp)


def _knn_model(name: str, train: DataFrame, task: str, classes: int) -> Candidate:
    known = train.select("row_id", "cells", "label")

    def apply(df: DataFrame) -> DataFrame:
        if task == REGRESSION:
            got = knn_regress(df, known, "row_id", "cells", "label").withColumn(
                "probability", F.lit(None).cast("array<double>")
            )
        else:
            hits = nearest_neighbors(df, known, "row_id", "cells").join(
                known.select(F.col("row_id").alias("neighbor"), F.col("label").alias("_l")), "neighbor"
            )
            shares = [F.avg((F.col("_l") == float(i)).cast("double")) for i in range(classes)]
            got = hits.groupBy("row_id").agg(F.array(*shares).alias("probability")).withColumn(
                "prediction", F.array_position("probability", F.array_max("probability")).cast("double") - 1
            )
        return df.join(got.select("row_id", F.col("prediction").cast("double").alias("prediction"), "probability"), "row_id")

    return Candidate(name, apply)


def _fitters(task: str, classes: int, n: int, y_std: float, seed: int) -> dict[str, Callable[[DataFrame], Candidate]]:
    """The five candidates per task. Boosted trees on more than two classes run one model per class."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if task == CLASSIFICATION:
        gbt = GBTClassifier(maxIter=60, maxDepth=4, stepSize=0.1, seed=seed, **common)
        models = {
            "Random Forest": RandomForestClassifier(numTrees=75, maxDepth=10, featureSubsetStrategy="sqrt", seed=seed, **common),
            "Gradient Boosting": gbt if classes <= 2 else OneVsRest(classifier=gbt, **common),
            # an L2 penalty of strength one, as a share of the rows
            "Logistic Regression": LogisticRegression(
                maxIter=500, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, **common),
            "Decision Tree": DecisionTreeClassifier(maxDepth=6, seed=seed, **common),
        }
    else:
        models = {
            "Random Forest": RandomForestRegressor(numTrees=75, maxDepth=10, featureSubsetStrategy="all", seed=seed, **common),
            "Gradient Boosting": GBTRegressor(maxIter=60, maxDepth=4, stepSize=0.1, seed=seed, **common),
            "Ridge Regression": LinearRegression(
                regParam=y_std / n, elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=500, **common),
            "Decision Tree": DecisionTreeRegressor(maxDepth=6, seed=seed, **common),
        }
    out: dict[str, Callable[[DataFrame], Candidate]] = {
        name: (lambda train, name=name, est=est: _spark_model(name, _without_summary(train.sparkSession, est.fit(train)), classes)) for name, est in models.items()
    }
    out["K-Nearest Neighbors"] = lambda train: _knn_model("K-Nearest Neighbors", train, task, classes)
    return out


@dataclass
class Tournament:
    target: str
    task: str
    key: list[str]
    classes: list[str] | None
    preparation: Preparation
    rows: list[dict]
    winner: Candidate | None
    fitted: dict[str, Candidate]
    train: DataFrame
    matrices: list[tuple] = field(default_factory=list)  # (model, label, prediction, count)

    def confusion(self, model: str | None = None) -> DataFrame:
        """``(model, label, prediction, count)`` on the holdout, of one candidate or all; no rows for a regression."""
        rows = [r for r in self.matrices if model is None or r[0] == model]
        return self.train.sparkSession.createDataFrame(rows, "model string, label string, prediction string, count bigint")

    def leaderboard(self) -> DataFrame:
        """Best first; a candidate that failed is listed last with its error."""
        schema = (
            "rank bigint, model string, task string, accuracy double, f1 double, precision double, recall double, "
            "r2 double, rmse double, mae double, fit_seconds double, classes string, error string"
        )
        main = "f1" if self.task == CLASSIFICATION else "r2"
        ranked = sorted(self.rows, key=lambda r: (r.get(main) is None, -(r.get(main) or 0.0)))
        names = ", ".join(self.classes) if self.classes else None
        data = [
            (i + 1, r["model"], self.task, *[r.get(m) for m in ("accuracy", "f1", "precision", "recall", "r2", "rmse", "mae")],
             r["seconds"], names, r.get("error"))
            for i, r in enumerate(ranked)
        ]
        return self.train.sparkSession.createDataFrame(data, schema)

    def feature_importance(self, model: str | None = None, top_n: int = 15) -> DataFrame:
        """``(model, rank, feature, importance)``; models without importances give no rows."""
        rows = []
        for name, c in self.fitted.items():
            if (model is None or name == model) and c.importances:
                pairs = sorted(zip(self.preparation.names, c.importances), key=lambda p: (-abs(round(p[1], 4)), p[0]))
                rows += [(name, i + 1, f, round(v, 4)) for i, (f, v) in enumerate(pairs[:top_n])]
        return self.train.sparkSession.createDataFrame(rows, "model string, rank bigint, feature string, importance double")

    def score(self, df: DataFrame, candidate: Candidate | None = None) -> DataFrame:
        """Batch scoring: the table with ``prediction``, and for classes ``probabilities`` and ``confidence``."""
        model = candidate or self.winner
        cells = self.preparation.features(df)
        ready = df.withColumn("cells", cells).withColumn("features", array_to_vector("cells")).withColumn(
            "row_id", _row_id(self.key)
        )
        out = model.apply(ready).drop("cells", "features", "row_id")
        if self.task == REGRESSION:
            return out.withColumn("prediction", F.round("prediction", 4)).drop("probability")
        labels = F.array(*[F.lit(c) for c in self.classes])
        rounded = F.transform("probability", lambda p: F.round(p, 4))
        return out.withColumns({
            "prediction": F.element_at(labels, (F.col("prediction") + 1).cast("int")),
            "probabilities": F.map_from_arrays(labels, rounded),
            "confidence": F.round(F.array_max("probability"), 4),
        }).drop("probability")

    def close(self) -> None:
        self.train.unpersist()


def _row_id(key: Sequence[str]) -> Column:
    """The key as one bigint: itself when it is a single whole number, else its hash."""
    return named(key[0]).cast("bigint") if len(key) == 1 else F.xxhash64(*[named(k) for k in key])


def _evaluate(candidates: Sequence[Candidate], test: DataFrame, task: str) -> tuple[dict[str, dict], list[tuple]]:
    """Metrics by model, and the confusion counts (model, label, prediction, count): one aggregate over the predictions of all."""
    if not candidates:
        return {}, []
    parts = [c.apply(test).select(F.lit(c.name).alias("model"), "label", "prediction") for c in candidates]
    stacked = reduce(DataFrame.unionByName, parts)
    if task == REGRESSION:
        e = F.col("label") - F.col("prediction")
        found = stacked.groupBy("model").agg(F.sum(e * e).alias("ee"), (F.var_pop("label") * F.count("label")).alias("yy"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")).collect()
        return {
            r["model"]: {"r2": half_up(1 - r["ee"] / r["yy"], 4) if r["yy"] else None, "rmse": half_up(math.sqrt(r["mse"]), 4), "mae": half_up(r["mae"], 4)}
            for r in found if r["ee"] is not None
        }, []
    cells = [tuple(r) for r in stacked.groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("n")).orderBy("model", "label", "prediction").collect()]
    out = {}
    for name in {c[0] for c in cells}:
        own = [c[1:] for c in cells if c[0] == name]
        total = sum(n for *_, n in own)
        sums = {"accuracy": sum(n for label, p, n in own if label == p) / total, "f1": 0.0, "precision": 0.0, "recall": 0.0}
        for label in {c[0] for c in own}:
            support, given = sum(n for a, _, n in own if a == label), sum(n for _, p, n in own if p == label)
            hits = sum(n for a, p, n in own if a == p == label)
            precision, recall = hits / given if given else 0.0, hits / support
            f1 = 2 * precision * recall / (precision + recall) if hits else 0.0
            for k, v in (("f1", f1), ("precision", precision), ("recall", recall)):
                sums[k] += support * v / total
        out[name] = {k: half_up(v, 4) for k, v in sums.items()}
    return out, cells


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows for iterative fits, dealt by key and put in order, so that a model does not depend on the files' splits.

    A fit pays per partition and round, and every partition of a forest sends the statistics of all open nodes: a small
    table gets few partitions, a large one twice the cores or as many as its rows need.
    """
    parts = max(1, min(n // ROWS_PER_PARTITION, 2 * rows.sparkSession.sparkContext.defaultParallelism), n // MOST_PER_PARTITION)
    return rows.repartition(parts, "row_id").sortWithinPartitions("row_id").persist(StorageLevel.MEMORY_AND_DISK)


def run_tournament(
    df: DataFrame, target: str, key: Sequence[str], task: str | None = None, test_share: float = 0.2, seed: int = 42,
    models: Sequence[str] | None = None, max_classes: int = MAX_CLASSES,
) -> Tournament:
    """Fit the candidates on the training rows, rank them on the holdout.

    ``max_classes`` bounds the labels of a classification; more of them raise an error.
    The candidates are independent Spark jobs and are submitted together; they
    share one persisted training set, which Spark recomputes if executors go.
    """
    shared_dir(df.sparkSession)  # boosted trees cut their lineage as they go
    task = task or infer_task(df, target)
    clean = df.where(present(df, target).isNotNull())
    split = holdout_split(clean, key, test_share, seed)
    train_rows, test_rows = split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")
    rows = clean.count()
    if rows < MIN_ROWS:
        raise ValueError("a tournament needs 15 rows with a target or more")
    prep = fit_preparation(clean, target, key, train_rows)

    classes = None
    if task == CLASSIFICATION:
        texts = clean.select(named(target).cast("string").alias("c"), named(target).alias("v")).distinct()
        found = texts.orderBy("v").limit(max_classes + 1).collect()
        if len(found) > max_classes:
            raise ValueError(f"{target!r} has over {max_classes} classes")
        classes = [r["c"] for r in found]
        label = (F.array_position(F.array(*[F.lit(c) for c in classes]), named(target).cast("string")) - 1).cast("double")
    else:
        label = number(clean, target)

    def ready(rows: DataFrame) -> DataFrame:
        return rows.select(_row_id(key).alias("row_id"), label.alias("label"), prep.features(rows).alias("cells")).withColumn(
            "features", array_to_vector("cells")
        )

    train, test = _dealt(ready(train_rows), rows), _dealt(ready(test_rows), rows)
    facts = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("label").alias("sd")).first()
    fitters = _fitters(task, len(classes or []), max(facts["n"], 1), facts["sd"] or 1.0, seed)
    chosen = {n: f for n, f in fitters.items() if models is None or n in models}
    fitted: dict[str, Candidate] = {}

    def enter(item) -> dict:
        name, fit = item
        start = time.time()
        try:
            fitted[name] = fit(train)
            return {"model": name, "seconds": round(time.time() - start, 3)}
        except Exception as err:  # a failing candidate is recorded, not fatal
            return {"model": name, "seconds": round(time.time() - start, 3), "error": str(err)[:500]}

    with ThreadPoolExecutor(max_workers=len(chosen)) as pool:
        results = list(pool.map(inheritable_thread_target(df.sparkSession)(enter), chosen.items()))
    # a candidate that failed beside the others gets one more try on its own
    results = [enter((r["model"], chosen[r["model"]])) if "error" in r else r for r in results]
    measured: dict[str, dict] = {}
    matrices: list[tuple] = []
    try:
        measured, matrices = _evaluate(list(fitted.values()), test, task)
    except Exception:  # one of them can't score: each by itself, so that it alone is recorded
        for name, candidate in list(fitted.items()):
            try:
                own, matrix = _evaluate([candidate], test, task)
                measured.update(own)
                matrices += matrix
            except Exception as err:
                del fitted[name]
                next(r for r in results if r["model"] == name)["error"] = str(err)[:500]
    results = [{**r, **measured.get(r["model"], {})} for r in results]
    if classes:
        named_class = lambda i: classes[int(i)]
        matrices = [(m, named_class(label), named_class(prediction), n) for m, label, prediction, n in matrices]
    test.unpersist()
    main = "f1" if task == CLASSIFICATION else "r2"
    ok = [r for r in results if r.get(main) is not None]
    best = max(ok, key=lambda r: r[main])["model"] if ok else None
    return Tournament(target, task, list(key), classes, prep, results, fitted.get(best), fitted, train, matrices)
