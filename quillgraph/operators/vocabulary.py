"""Vocabularies, dictionaries and entity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tagging
from . import triples as tr
from .graph import types_of

SKIPPED_TAGS = ["RB", "PRP", "CC", "DT", "IN", "TO", "MD"]


def content_tokens(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the kept columns, token: words of each phrase that carry content, in lower case."""
    word = F.col("word")
    return tr.phrase_words(docs).where(~F.col("tag").isin(SKIPPED_TAGS) & word.rlike(r"^\p{L}+$") & (F.length(word) > 1)).select("doc_id", *kept, F.lower(word).alias("token"))


def dictionary(tokens: DataFrame, documents: int, least: int = 5, most: float = 0.7) -> DataFrame:
    """token, df, tf of tokens in at least so many documents and at most so great a share. Counted by document first, so the distinct count needs no second pass."""
    by_doc = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    counted = by_doc.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    return counted.where((F.col("df") >= least) & (F.col("df") <= most * documents))


def words_of(df: DataFrame, column: str) -> DataFrame:
    """term: distinct words in lower case."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(tagging.TOKEN), F.lit(0))).alias("term")).distinct()


def with_term(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Triples whose subject or object is a term."""
    side = lambda c: vocabulary.select(F.col("term").alias(f"{c}_term"))
    out = triples
    for c in ("subject", "object"):
        out = out.join(side(c), F.lower(c) == F.col(f"{c}_term"), "left")
    return out.where(F.col("subject_term").isNotNull() | F.col("object_term").isNotNull()).drop("subject_term", "object_term")


def linked(docs: DataFrame, gazetteer: DataFrame, fallback: DataFrame) -> DataFrame:
    """doc_id, n_links, links: words found in the gazetteer (term, uri, type), missing types filled from the fallback."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(tagging.TOKEN), F.lit(0)))).alias("surface")).distinct()
    found = words.join(gazetteer.select("term", "uri"), F.lower("surface") == F.col("term"))
    typed = types_of(gazetteer.select("uri").distinct(), gazetteer.where("type is not null").select("uri", "type"), fallback)
    both = found.join(typed, "uri").select("doc_id", "surface", "uri", F.element_at("types", 1).alias("type"))
    links = F.array_sort(F.collect_list(F.struct("type", "uri", "surface")))
    return both.groupBy("doc_id").agg(F.count("*").alias("n_links"), F.array_join(F.transform(links, lambda x: F.concat(x["type"], F.lit("="), x["uri"])), ";").alias("links"))


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def top_per(df: DataFrame, key: str, *order: Column | str, n: int = 10) -> DataFrame:
    """The first n rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
