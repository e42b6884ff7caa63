"""Choice of classifiers: boosted trees one against the rest, sampled configurations beside each other, embeddings by the AUC of a classifier, a final fit with its report.

Rows are (key, label from 0, features array). Fits are Spark's; the driver only starts them, several at a time, and
keeps a row for each: a fit that fails is a row with its error and no measure, and the others go on.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored
from . import metrics, sampling

#: The search space of boosted trees. Fixed values.
SPACE = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 7, 10],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "min_child_weight": [1, 3, 5],
    "gamma": [0, 0.1, 0.2],
}
#: The classifier that judges embeddings. Fixed values.
JUDGE = {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1}
#: Classes that get a booster each.
MOST_CLASSES = 200


def draws(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n different configurations of the space's product, or all of them in order if there are no more. The product is counted, not made."""
    names, sizes = list(space), [len(v) for v in space.values()]
    total = math.prod(sizes)
    out = []
    for number in range(total) if n >= total else random.Random(seed).sample(range(total), n):
        own = {}
        for name, size in zip(reversed(names), reversed(sizes), strict=True):
            number, at = divmod(number, size)
            own[name] = space[name][at]
        out.append({k: own[k] for k in names})
    return out


def grid(space: dict[str, list]) -> list[dict]:
    """All configurations."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def booster(params: dict, seed: int = 42) -> GBTClassifier:
    """Boosted trees for two classes, by the names of the search space."""
    share = params.get("colsample_bytree", 1.0)
    return GBTClassifier(
        maxIter=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 5), stepSize=params.get("learning_rate", 0.1), subsamplingRate=params.get("subsample", 1.0),
        featureSubsetStrategy="all" if share >= 1 else str(share), minInstancesPerNode=params.get("min_child_weight", 1), minInfoGain=float(params.get("gamma", 0)), seed=seed,
    )


def boosted(train: DataFrame, test: DataFrame, params: dict, seed: int = 42) -> DataFrame:
    """test with probabilities (an array by class) and pred, the first most probable. One booster against the rest for each class; with two classes one in all."""
    vector = lambda df: df.withColumn("_x", array_to_vector(F.col("features").cast("array<double>")))
    classes = sorted(int(r.label) for r in train.select("label").distinct().limit(MOST_CLASSES + 1).collect())
    if len(classes) > MOST_CLASSES or len(classes) < 2:
        raise ValueError(f"{len(classes)} classes: 2 to {MOST_CLASSES} can be told apart")
    own = cut(vector(train))
    out, names = vector(test), []
    for c in classes[1:] if len(classes) == 2 else classes:
        model = booster(params, seed).setFeaturesCol("_x").setLabelCol("_y").setPredictionCol("_p").setProbabilityCol("_q").setRawPredictionCol("_r").fit(own.withColumn("_y", (F.col("label") == c).cast("double")))
        names.append(f"_p{c}")
        out = model.transform(out).withColumn(names[-1], F.get(vector_to_array("_q"), F.lit(1))).drop("_p", "_q", "_r")
    if len(classes) == 2:
        found = {classes[0]: 1 - F.col(names[0]), classes[1]: F.col(names[0])}
    else:
        total = sum((F.col(n) for n in names), F.lit(0.0))
        found = {c: F.when(total > 0, F.col(n) / total).otherwise(1 / len(names)) for c, n in zip(classes, names, strict=True)}
    every = F.array(*[found.get(c, F.lit(0.0)) for c in range(classes[-1] + 1)])
    return out.withColumn("probabilities", every).withColumn("pred", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")).drop("_x", *names)


def macro_auc(predicted: DataFrame, *group: str) -> DataFrame:
    """auc: of the second class for two, else the mean of each class against the rest; classes without both sides are left out."""
    scores = predicted.select(*group, "label", F.posexplode("probabilities").alias("class", "score"))
    each = metrics.auc(scores.withColumn("is", F.col("label") == F.col("class")), F.col("is"), "score", *group, "class")
    return each.groupBy(*group).agg(F.avg("auc").alias("auc")) if group else each.agg(F.avg("auc").alias("auc"))


def measured(predicted: DataFrame) -> dict[str, float]:
    """accuracy, auc, log_loss and mpce of rows (label, pred, probabilities)."""
    own = predicted.withColumn("p_true", F.coalesce(F.get("probabilities", F.col("label")), F.lit(0.0)))
    first = metrics.accuracy_log_loss(own, "label", "pred", "p_true").first()
    error = metrics.averages(metrics.class_report(metrics.confusion(own))).first()["mpce"]
    return {"accuracy": first["accuracy"], "auc": macro_auc(own).first()["auc"], "log_loss": first["log_loss"], "mpce": error}


def each(work: Iterable[tuple[int, Callable[[], dict]]], parallel: int = 4) -> list[dict]:
    """The results of the pieces of work by number, several at a time: a row each, with ``error`` where one failed."""

    def run(piece: tuple[int, Callable[[], dict]]) -> dict:
        try:
            return {"number": piece[0], **piece[1](), "error": None}
        except Exception as e:  # noqa: BLE001  whatever a fit raises is its row's error
            return {"number": piece[0], "error": f"{type(e).__name__}: {e}"[:500]}

    with ThreadPoolExecutor(parallel) as pool:
        return sorted(pool.map(run, work), key=lambda r: r["number"])


def cross_validated(rows: DataFrame, key: str, params: dict, k: int = 10, seed: int = 42, fit=boosted) -> DataFrame:
    """key, label, fold, probabilities, pred: each row judged by the folds that it isn't in."""
    folded = stored(sampling.folds(rows, "label", key, k, seed))
    parts = [fit(folded.where(F.col("fold") != i), folded.where(F.col("fold") == i), params) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out.select(key, "label", "fold", "probabilities", "pred"))


SEARCHED = "draw int, params string, log_loss double, accuracy double, auc double, mpce double, error string, best boolean"


def search(rows: DataFrame, key: str, configs: list[dict], k: int = 3, seed: int = 42, parallel: int = 4, fit=boosted) -> DataFrame:
    """A row for each configuration, with its measures over k folds or its error; best marks the least log loss, the first of equals."""
    rows = stored(rows.select(key, "label", "features"))
    folded = stored(sampling.folds(rows, "label", key, k, seed))

    def of(params: dict) -> dict:
        parts = [measured(cut(fit(folded.where(F.col("fold") != i), folded.where(F.col("fold") == i), params).select("label", "probabilities", "pred"))) for i in range(k)]
        return {m: sum(p[m] if p[m] is not None else math.nan for p in parts) / k for m in parts[0]}

    found = each(((i, lambda c=c: of(c)) for i, c in enumerate(configs)), parallel)
    ok = [r for r in found if r["error"] is None and not math.isnan(r["log_loss"])]
    best = min(ok, key=lambda r: (r["log_loss"], r["number"]))["number"] if ok else None
    out = [(r["number"], json.dumps(configs[r["number"]]), r.get("log_loss"), r.get("accuracy"), r.get("auc"), r.get("mpce"), r["error"], r["number"] == best) for r in found]
    return rows.sparkSession.createDataFrame(out, SEARCHED)


def winner(searched: DataFrame) -> dict:
    """The configuration of the best row."""
    row = searched.where("best").first()
    if row is None:
        raise ValueError("no configuration could be fitted")
    return json.loads(row.params)


def by_auc(features: dict[int, DataFrame], key: str, params: dict = JUDGE, seed: int = 42, parallel: int = 2, fit=boosted) -> DataFrame:
    """Of embeddings (their number: rows with the features that they give) the one whose classifier has the largest AUC on a fifth of the rows held out, the first of equals.

    config, downstream_auc, error, best; an embedding that fails, or that gives no AUC, has none.
    """

    def of(rows: DataFrame) -> dict:
        own = stored(sampling.split(rows.select(key, "label", "features"), "label", key, 0.2, seed))
        return {"auc": macro_auc(fit(own.where("split = 'train'"), own.where("split = 'test'"), params)).first()["auc"]}

    found = each(((n, lambda r=rows: of(r)) for n, rows in sorted(features.items())), parallel)
    ok = [r for r in found if r.get("auc") is not None]
    best = max(ok, key=lambda r: (r["auc"], -r["number"]))["number"] if ok else None
    spark = next(iter(features.values())).sparkSession
    return spark.createDataFrame([(r["number"], r.get("auc"), r["error"], r["number"] == best) for r in found], "config int, downstream_auc double, error string, best boolean")


def final(rows: DataFrame, key: str, params: dict, k: int = 10, seed: int = 42, fit=boosted) -> dict[str, DataFrame]:
    """The fit on four fifths of the rows, measured on the rest, and the folds over all rows.

    predictions (of the test rows), test (accuracy, auc, log_loss, mpce), report by class, confusion, folds (a row each), summary (mean, deviation and
    interval of accuracy and AUC) and signed_rank (the first half of the folds' accuracies against the second; null if they are equal).
    """
    spark = rows.sparkSession
    own = stored(sampling.split(rows.select(key, "label", "features"), "label", key, 0.2, seed))
    predicted = stored(fit(own.where("split = 'train'"), own.where("split = 'test'"), params).select(key, "label", "probabilities", "pred"))
    matrix = stored(metrics.confusion(predicted))
    over = cross_validated(rows, key, params, k, seed, fit)
    names = ("accuracy", "auc", "log_loss", "mpce")
    measures = [measured(over.where(F.col("fold") == i)) for i in range(k)]
    folds = spark.createDataFrame([(i, *(m[n] for n in names)) for i, m in enumerate(measures)], "fold int, " + ", ".join(f"{n} double" for n in names))
    summary = metrics.fold_summary(folds, "accuracy", k).withColumn("measure", F.lit("accuracy")).unionByName(metrics.fold_summary(folds.where("auc is not null"), "auc", k).withColumn("measure", F.lit("auc")))
    half = k // 2
    ranks = metrics.wilcoxon([m["accuracy"] for m in measures[:half]], [m["accuracy"] for m in measures[half : 2 * half]])
    test = measured(predicted)
    return {
        "predictions": predicted, "test": spark.createDataFrame([tuple(test[n] for n in names)], ", ".join(f"{n} double" for n in names)), "report": metrics.class_report(matrix), "confusion": matrix,
        "folds": folds, "summary": summary, "signed_rank": spark.createDataFrame([ranks or (None, None)], "statistic double, p double"),
    }
