"""Names of several words found in texts: longest match by first word, with confidence and support filters.

The names are cut by their first word, as a trie is at its root: the first word tells at each place of a text which lengths can
match there, and only runs of those lengths meet the names. Both tables go to the texts as broadcasts if they are few (their rows are
counted), else they meet by the word and by the run. Overlaps are then settled within a text, leftmost first, the longest at a place.
Words are runs of letters and digits, compared in lower case.

Defined cases: null text and null names have no words; of several entries of a name the one with the largest confidence, then support, then
the smallest uri counts; a null confidence or support counts as 0; repeated rows of a key are one text each only if their keys differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tagging import TOKEN
from ..session import stored

#: Names (by first word) that are broadcast.
BROADCAST_ROWS = 200_000


def words(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(TOKEN), F.lit(0))


def named(names: DataFrame, least_confidence: float = 0.0, least_support: int = 0) -> DataFrame:
    """name (words with single blanks), first, size and uri of names (name, uri, confidence, support) that pass both filters."""
    confidence, support = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.coalesce(F.col("support").cast("long"), F.lit(0))
    kept = names.where("uri is not null").select(words(F.col("name")).alias("own"), "uri", confidence.alias("c"), support.alias("s")).where((F.size("own") > 0) & (F.col("c") >= least_confidence) & (F.col("s") >= least_support))
    best = kept.groupBy("own").agg(F.min(F.struct((-F.col("c")).alias("c"), (-F.col("s")).alias("s"), "uri"))["uri"].alias("uri"))
    return best.select(F.array_join("own", " ").alias("name"), F.get("own", F.lit(0)).alias("first"), F.size("own").alias("size"), "uri")


def link(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", least_confidence: float = 0.0, least_support: int = 0) -> DataFrame:
    """key, place (of the first word, from 0), size (words), name, uri: matches that don't overlap, leftmost first, each the longest at its place."""
    own = stored(named(names, least_confidence, least_support))
    firsts = stored(own.groupBy("first").agg(F.collect_set("size").alias("sizes")))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    longest = own.agg(F.max("size")).first()[0] or 1
    ahead = F.transform("w", lambda _, i: F.slice("w", i + 1, F.lit(longest)))
    places = docs.select(F.col(key), words(F.col(text)).alias("w")).select(key, F.posexplode(ahead).alias("place", "ahead"))
    met = places.withColumn("first", F.get("ahead", F.lit(0))).join(few(firsts), "first").select(key, "place", "ahead", F.explode("sizes").alias("size")).where(F.size("ahead") >= F.col("size"))
    runs = met.select(key, "place", "size", F.array_join(F.slice("ahead", F.lit(1), F.col("size")), " ").alias("name"))
    return _apart(runs.join(few(own.select("name", "uri")), "name"), key)


def _apart(found: DataFrame, key: str) -> DataFrame:
    """Matches of a text, in order, without those that begin within one that is kept. A text's matches are one array."""
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("size")).alias("less"), "size", "name", "uri"))).alias("rows"))
    start = F.struct(F.lit(0).alias("end"), F.slice("rows", 1, 0).alias("kept"))
    step = lambda acc, m: F.when(m["place"] >= acc["end"], F.struct((m["place"] + m["size"]).alias("end"), F.array_append(acc["kept"], m).alias("kept"))).otherwise(acc)
    return rows.select(key, F.explode(F.aggregate("rows", start, step)["kept"]).alias("m")).select(key, "m.place", "m.size", "m.name", "m.uri")
