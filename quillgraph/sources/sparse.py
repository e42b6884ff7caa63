"""Corpora without texts: rows of weighted terms, and category codes apart from them. Lines of text, so a large file is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..operators.sampling import draw_key

#: Fixed value: terms told of a row.
TOP_TERMS = 50

TERMS = "array<struct<term:bigint,weight:double>>"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, terms from lines "id term:weight term:weight"; a line without an id is left out, an entry that isn't a pair of numbers too."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.try_element_at("x", F.lit(1)).rlike("^[0-9]+$"))
    pairs = F.filter(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), lambda e: e.rlike(r"^[0-9]+:-?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"))
    struct = F.transform(pairs, lambda e: F.struct(F.split_part(e, F.lit(":"), F.lit(1)).cast("long").alias("term"), F.split_part(e, F.lit(":"), F.lit(2)).cast("double").alias("weight")))
    return parts.select(F.col("x")[0].cast("long").alias("doc_id"), struct.cast(TERMS).alias("terms"))


def write_rows(rows: DataFrame, path: str) -> None:
    entries = F.transform("terms", lambda t: F.concat_ws(":", t["term"].cast("string"), t["weight"].cast("string")))
    rows.select(F.concat_ws(" ", F.col("doc_id").cast("string"), entries)).write.mode("overwrite").text(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """code, doc_id from lines "code id" (what follows is passed over)."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where((F.size("x") > 1) & F.try_element_at("x", F.lit(2)).rlike("^[0-9]+$"))
    return parts.select(F.col("x")[0].alias("code"), F.col("x")[1].cast("long").alias("doc_id"))


def by_prefix(codes: DataFrame, names: dict[str, str]) -> DataFrame:
    """doc_id, category: once for each name whose prefix one of the document's codes begins with."""
    found = F.array_compact(F.array(*[F.when(F.startswith("code", F.lit(prefix)), F.lit(name)) for prefix, name in names.items()]))
    return codes.select("doc_id", F.explode(found).alias("category")).distinct()


def top_terms(terms: str, n: int = TOP_TERMS):
    """The terms of the n largest weights, equal ones by term."""
    order = F.array_sort(F.transform(terms, lambda t: F.struct((-t["weight"]).alias("w"), t["term"].alias("term"))))
    return F.transform(F.slice(order, 1, n), lambda t: t["term"])


def corpus(rows: DataFrame, codes: DataFrame, names: dict[str, str], per_category: int, seed: int = 42, label: str = "doc") -> DataFrame:
    """doc_id, category, text, original_index, feature_count, top_terms: a draw of per_category documents of each category (all if fewer).

    The text is a placeholder, as such corpora have none. A document may be drawn for several categories; one without a row isn't drawn;
    feature_count counts weights that aren't zero; repeated doc_ids of rows are the caller's to remove.
    """
    held = by_prefix(codes, names).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = ranked(held, "category", [draw_key(seed, "doc_id"), F.col("doc_id")], "draw").where(F.col("draw") <= per_category).select("doc_id", "category")
    count = F.size(F.filter(F.coalesce("terms", F.array().cast(TERMS)), lambda t: t["weight"] != 0)).cast("long")
    key = F.col("doc_id").cast("string")
    return drawn.join(rows, "doc_id").select(
        F.concat(F.lit(label.lower() + "_"), key).alias("doc_id"), "category", F.concat(F.lit(label + "_document_"), key).alias("text"), F.col("doc_id").alias("original_index"), count.alias("feature_count"), top_terms("terms").alias("top_terms")
    )
