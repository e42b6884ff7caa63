"""The triple table as a graph: frequencies, capacity scaling, ids, features, ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranking import ranked


def entity_frequency(triples: DataFrame) -> DataFrame:
    """entity, freq: places as subject and as object."""
    return triples.select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count("*").alias("freq"))


def frequency_summary(freq: DataFrame) -> DataFrame:
    """One row over all entities; rare ones have under a tenth of the largest frequency."""
    largest = freq.agg(F.max("freq").alias("m"))
    both = freq.crossJoin(F.broadcast(largest))  # one row
    rare = F.count_if(F.col("freq") < 0.1 * F.col("m"))
    return both.agg(F.count("*").alias("n"), F.max("freq").alias("max"), F.avg("freq").alias("mean"), F.median("freq").alias("median"), F.min("freq").alias("min"), rare.alias("rare_n"), (100.0 * rare / F.count("*")).alias("rare_pct"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """column and its place in sorted order from 0."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return ranked(values, None, [F.col(column)], "id").select(column, (F.col("id") - 1).alias("id"))


def scaled(vectors: DataFrame, freq: DataFrame, alpha: float = 0.5) -> DataFrame:
    """entity, scale, vec times scale: (freq / max) ** alpha, frequency 1 for entities that no triple has."""
    largest = F.broadcast(freq.agg(F.max("freq").alias("m")))  # one row
    scale = F.pow(F.coalesce("freq", F.lit(1)) / F.col("m"), F.lit(alpha))
    out = vectors.join(freq, "entity", "left").crossJoin(largest).withColumn("scale", scale)
    return out.select("entity", "scale", F.transform("vec", lambda x: x.cast("double") * F.col("scale")).alias("vec"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def pair_features(triples: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """triples with features: the subject's vector and the object's, zeros where there is none."""
    zeros = F.array_repeat(F.lit(0.0), width)
    side = lambda name: vectors.select(F.col("entity").alias(name), F.col("vec").cast("array<double>").alias(f"{name}_vec"))
    out = triples.join(side("subject"), "subject", "left").join(side("object"), "object", "left")
    return out.withColumn("features", F.concat(F.coalesce("subject_vec", zeros), F.coalesce("object_vec", zeros))).drop("subject_vec", "object_vec")


def ancestors(edges: DataFrame) -> DataFrame:
    """class, ancestor, depth over subclass edges (child, parent): joined step by step until nothing is new, however deep. Cycles end at the first repeat."""
    own = edges.select("child", "parent").distinct()
    found = cut(own.select(F.col("child").alias("class"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    last, depth = found, 1
    while not last.isEmpty():
        depth += 1
        step = last.join(own, last["ancestor"] == own["child"]).select("class", F.col("parent").alias("ancestor")).distinct()
        last = cut(step.join(found, ["class", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        found = cut(found.unionByName(last))
    return found


def describe_term(ontology: DataFrame, concept: str) -> DataFrame:
    """property, value and, where known, comment, label, range and domain of the property, for one concept (s, p, o table)."""
    own = ontology.where(F.lower("s") == concept.lower()).select(F.col("p").alias("property"), F.col("o").alias("value"))
    for name in ("comment", "label", "range", "domain"):
        extra = ontology.where(F.col("p") == f"rdfs:{name}").select(F.col("s").alias("property"), F.col("o").alias(name))
        own = own.join(extra, "property", "left")
    return own


def types_of(uris: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """uri, types: from the local table, else from the remote one, else empty."""
    gather = lambda t, n: t.groupBy("uri").agg(F.array_sort(F.collect_set("type")).alias(n))
    out = uris.join(gather(local, "a"), "uri", "left").join(gather(remote, "b"), "uri", "left")
    return out.select("uri", F.coalesce("a", "b", F.array().cast("array<string>")).alias("types"))
