"""Samples, splits and their checks. Every draw orders rows by md5 of seed and key, so any engine repeats it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def draw_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))


def shares(df: DataFrame, key: str) -> DataFrame:
    """key, n, share and cumulative share in key order. The window runs over one row a key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(every))
    return out.withColumn("cum_share", F.sum("n").over(every.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(every))


def stratified(df: DataFrame, stratum: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """max(1, int(n * target / total)) rows of each stratum."""
    total = df.count()
    quota = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(min(1.0, target / max(1, total)))))
    drawn = ranked(df, stratum, [draw_key(seed, key), F.col(key)], "draw")
    return drawn.where(F.col("draw") <= F.least(quota, F.col("group_size"))).drop("draw", "group_size")


def proportional(df: DataFrame, stratum: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """Rounded quotas (half to even) that add up to target: the largest stratum, first by name, takes the rest."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    quotas = counts.withColumn("quota", F.rint(F.col("n") * target / F.sum("n").over(every)).cast("long"))
    largest = F.row_number().over(every.orderBy(F.desc("n"), stratum)) == 1
    rest = F.lit(target) - F.sum("quota").over(every)
    quotas = quotas.select(F.col(stratum), (F.col("quota") + F.when(largest, rest).otherwise(0)).alias("quota"))
    drawn = ranked(df, stratum, [draw_key(seed, key), F.col(key)], "draw")
    return drawn.join(quotas, stratum).where("draw <= quota").drop("draw", "quota", "group_size")


def top_classes(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values and their numbers from 0; equals by value."""
    top = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
    return top.withColumn("class_id", F.row_number().over(Window.orderBy(F.desc("n"), column)) - 1)


def split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """train or test, the share held in each label."""
    drawn = ranked(df, label, [draw_key(seed, key), F.col(key)], "draw")
    return drawn.withColumn("split", F.when(F.col("draw") <= F.floor(F.col("group_size") * test_share), "test").otherwise("train")).drop("draw", "group_size")


def folds(df: DataFrame, label: str, key: str, k: int = 10, seed: int = 42) -> DataFrame:
    """A fold number for each row, even within each label."""
    drawn = ranked(df, label, [draw_key(seed, key), F.col(key)], "draw")
    return drawn.withColumn("fold", ((F.col("draw") - 1) % k).cast("int")).drop("draw", "group_size")


def split_graph(triples: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """train or test for triples; a test triple with an entity or relation that no training triple has goes to train."""
    limit = f"{int(test_share * 16**8):08x}"
    drawn = triples.withColumn("is_test", F.substring(draw_key(seed, key), 1, 8) < F.lit(limit))
    train = drawn.where("not is_test")
    entities = train.select(F.explode(F.array("subject", "object")).alias("e")).distinct()
    known = lambda side: entities.select(F.col("e").alias(side), F.lit(True).alias(f"{side}_known"))
    relations = train.select("relation").distinct().withColumn("relation_known", F.lit(True))
    out = drawn.join(known("subject"), "subject", "left").join(known("object"), "object", "left").join(relations, "relation", "left")
    ok = F.col("is_test") & F.col("subject_known") & F.col("object_known") & F.col("relation_known")
    return out.withColumn("split", F.when(F.coalesce(ok, F.lit(False)), "test").otherwise("train")).drop("is_test", "subject_known", "object_known", "relation_known")


def fill_quota(df: DataFrame, category: str, order: str, quota: int) -> DataFrame:
    """The first rows of each category in order, up to the quota."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(order))  # a constant bound: each task keeps its first rows before the shuffle
    return df.withColumn("place", place).where(F.col("place") <= quota)


def align_shares(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, counts in a and b, 0 where one has none."""
    x = a.groupBy(key).agg(F.count("*").alias("n_a"))
    y = b.groupBy(key).agg(F.count("*").alias("n_b"))
    return x.join(y, key, "full_outer").select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def validate(population: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """One row: chi-square against proportional counts, largest distance of cumulative shares, deviations in percent, a verdict."""
    every = Window.partitionBy()
    both = align_shares(population, sample, key)
    both = both.withColumn("p", F.col("n_a") / F.sum("n_a").over(every)).withColumn("q", F.col("n_b") / F.sum("n_b").over(every))
    both = both.withColumn("e", F.col("p") * F.sum("n_b").over(every))
    run = every.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("d", F.abs(F.sum("p").over(run) - F.sum("q").over(run)))
    gap = F.abs(F.col("p") - F.col("q")) * 100
    out = both.agg(
        F.sum(F.when(F.col("e") > 0, F.pow(F.col("n_b") - F.col("e"), F.lit(2)) / F.col("e"))).alias("chi2"), (F.count("*") - 1).alias("df"), F.max("d").alias("ks"),
        F.max(gap).alias("max_dev"), F.avg(gap).alias("mean_dev"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )
    return out.withColumn("quality", F.when(F.col("max_dev") < 2, "excellent").when(F.col("max_dev") < 5, "good").otherwise("poor"))


def chi_square_p(statistic: float, df: int) -> float:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function by series or continued fraction."""
    if df <= 0:
        return 1.0
    a, x = df / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 10_000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * scale


def ks_p(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    t = statistic * math.sqrt(n * m / (n + m))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101))))
