"""Classifiers on feature arrays, with cross-validation by stratified folds."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import metrics, sampling


def forest(trees: int = 20, depth: int = 5, seed: int = 42) -> RandomForestClassifier:
    """The default; it gives class probabilities, which the one-against-rest classifiers don't."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def linear(rounds: int = 20) -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(maxIter=rounds))


def predict(train: DataFrame, test: DataFrame, make=forest) -> DataFrame:
    """test (label, features array, ...) with pred and p_true."""
    vectors = lambda df: df.withColumn("label", F.col("label").cast("double")).withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    out = make().fit(vectors(train)).transform(vectors(test))
    p = F.get(vector_to_array("probability"), F.col("label").cast("int")) if "probability" in out.columns else (F.col("label") == F.col("prediction")).cast("double")
    return out.withColumns({"pred": F.col("prediction"), "p_true": F.coalesce(p, F.lit(0.0))})


def cross_validate(rows: DataFrame, key: str, k: int = 10, seed: int = 42, make=forest) -> DataFrame:
    """fold, accuracy, log_loss, mpce for each fold of rows (key, label from 0, features array)."""
    folded = cut(sampling.folds(rows, "label", key, k, seed))
    parts = []
    for fold in range(k):
        got = cut(predict(folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold), make).select("label", "pred", "p_true"))
        own = metrics.averages(metrics.class_report(metrics.confusion(got))).select("mpce")
        parts.append(metrics.accuracy_log_loss(got, "label", "pred", "p_true").crossJoin(F.broadcast(own)).withColumn("fold", F.lit(fold)))  # one row each
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
