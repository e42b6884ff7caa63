"""Classification, ranking, clustering and significance measures."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pair_blocks

CLIP = 1e-15


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support for each label or prediction of a confusion table."""
    rows = matrix.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    columns = matrix.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    both = rows.join(columns, "class", "full_outer").na.fill(0, ["support", "hit", "predicted"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return both.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages, and the mean error of classes with support."""
    out = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    out += [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.agg(*out, F.avg(F.when(F.col("support") > 0, 1 - F.col("recall"))).alias("mpce"))


def accuracy_log_loss(df: DataFrame, label: str, pred: str, p_true: str) -> DataFrame:
    clipped = F.least(F.greatest(F.col(p_true), F.lit(CLIP)), F.lit(1 - CLIP))
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"), F.avg(-F.log(clipped)).alias("log_loss"))


def auc(df: DataFrame, positive: Column, score: str, *group: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, equal scores at their mean rank; null if one side is empty.

    Rows are counted by score first, so the window runs over distinct scores.
    """
    counted = df.groupBy(*group, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(positive.cast("long")).alias("pos"))
    w = Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    sums = ranked.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.col("pos") * F.col("rank")).alias("r"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(*group, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), value).alias("auc"))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function (Simpson's rule)."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float) -> float:
        n = 2000
        h = t / n
        f = [scale * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
        return 0.5 + h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def fold_summary(df: DataFrame, value: str, folds: int, level: float = 0.95) -> DataFrame:
    """Mean, population deviation and t interval (sample deviation) of fold values."""
    t = t_quantile((1 + level) / 2, folds - 1)
    half = F.lit(t) * F.stddev_samp(value) / F.sqrt(F.count("*"))
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.avg(value) - half).alias("ci_low"), (F.avg(value) + half).alias("ci_high"))


def wilcoxon(a: list[float], b: list[float]) -> tuple[float, float] | None:
    """Signed-rank statistic of pairs and its exact two-sided p over all signs; null for unequal or empty sides. Few folds only."""
    if len(a) != len(b):
        return None
    d = [x - y for x, y in zip(a, b, strict=True) if x != y]
    if not d:
        return None
    order = sorted(abs(x) for x in d)
    rank = {v: sum(i + 1 for i, x in enumerate(order) if x == v) / order.count(v) for v in order}
    ranks = [rank[abs(x)] for x in d]
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    t = min(plus, sum(ranks) - plus)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return t, min(1.0, 2 * sum(s <= t for s in sums) / len(sums))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def silhouette(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """key, cluster, Euclidean silhouette; 0 for a cluster's only member and for rows without vector or cluster. key and cluster are whole numbers; all pairs, by blocks."""
    means = pair_blocks.mean_distances(df, key, vector, cluster).withColumnRenamed("key", key)
    both = df.select(key, cluster, F.col(vector).isNotNull().alias("has")).distinct().join(means, key, "left")
    here = F.when(F.col("has"), F.col("d"))
    sides = both.groupBy(key, cluster).agg(F.min(F.when(F.col("c2") == F.col(cluster), here)).alias("a"), F.min(F.when(F.col("c2") != F.col(cluster), here)).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return sides.select(key, cluster, value.alias("silhouette"))


def filtered_ranks(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Rank of each query's true candidate: the mean of best and worst place among candidates that aren't known otherwise.

    scored: query, candidate, score, is_truth; known: query, candidate.
    """
    left = scored.join(known.withColumn("is_known", F.lit(True)), ["query", "candidate"], "left").where(F.col("is_truth") | F.col("is_known").isNull())
    truth = left.where("is_truth").select("query", F.col("score").alias("truth_score"))
    both = left.join(truth, "query")
    better, equal = F.count_if(F.col("score") > F.col("truth_score")), F.count_if((F.col("score") == F.col("truth_score")) & ~F.col("is_truth"))
    return both.groupBy("query").agg((1 + better + 0.5 * equal).alias("rank"))


def rank_metrics(ranks: DataFrame) -> DataFrame:
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.agg(F.avg(1 / F.col("rank")).alias("mrr"), hit(1).alias("hits1"), hit(10).alias("hits10"))
