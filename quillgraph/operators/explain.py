"""Explanations of clusters and their scores. Generation and judging are functions that a caller may replace; the defaults are templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .vocabulary import top_per

FALLBACK = 3


def explain(topic: Column, terms: Column, domain: str = "general") -> Column:
    """A model's answer as text: here JSON from a template, with the scores used where there is none."""
    return F.to_json(F.struct(F.format_string("In the " + domain + " domain, topic %s groups %s.", topic.cast("string"), F.array_join(terms, ", ")).alias("explanation"), F.lit(FALLBACK).alias("coherence"), F.lit(FALLBACK).alias("relevance"), F.lit(FALLBACK).alias("coverage")))


def explanations(clusters: DataFrame, generate=explain, top: int = 10) -> DataFrame:
    """topic, cluster, terms, explanation, coherence, relevance, coverage; scores that can't be read are the fallback."""
    ranked = top_per(clusters.withColumn("key", F.concat_ws("/", "topic", "cluster")), "key", F.desc("silhouette"), "term", n=top)
    rows = ranked.groupBy("topic", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    answered = rows.withColumn("a", text.json_answer(generate(F.col("topic"), F.col("terms"))))
    scores = [F.coalesce(f"a.{c}", F.lit(FALLBACK)).alias(c) for c in ("coherence", "relevance", "coverage")]
    return answered.select("topic", "cluster", "terms", "a.explanation", *scores)


def summary(explained: DataFrame) -> DataFrame:
    """topic, mean scores and number of clusters."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in ("coherence", "relevance", "coverage")]
    return explained.groupBy("topic").agg(*means, F.count("*").alias("num_clusters"))
