"""Spectral clusters of a topic of any size: what clusters.spectral() gives, without its matrix.

The affinity (cosine + 1) / 2 is W W' for rows w = (u, 1) / sqrt(2), so degrees and the leading eigenvectors of the normalised affinity come
from sums of w w', which have as many rows as a vector has places and one more. k-means runs for every number of clusters at once: a pass is
one job over blocks, which hand on sums for each centre; the centres of a topic are at most MOST_CLUSTERS² numbers for each k. Silhouettes are
those of cluster_rounds, summed by the clusters of every k in one pass over pairs of blocks.

Cases are those of cluster_rounds. Directions beyond the rank of W are zero, so more clusters than that are decided by the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored, stored_twice
from . import clusters
from .cluster_rounds import _lists, _matrix, _pairs, chosen, dealt, distance_sums, grams, in_arrow, points, units
from .clusters import MOST_CLUSTERS, MOST_TERMS
from .ranking import ranked

#: Passes of k-means at most; rows of one sum of silhouettes are split into so many groups a block.
PASSES, SPLIT = 100, 32
#: Terms of a topic that one task clusters.
FINISH = MOST_TERMS
_BY = ["topic", "part"]


def _spread(own: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, one a topic, for each block of own."""
    parts = own.groupBy("topic").agg(F.max("parts").alias("parts"))
    return rows.join(parts, "topic").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _scaled(w: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over the roots of their degrees, and those roots; gram: the sum of w w'."""
    root = 1 / np.sqrt(np.maximum(w @ (gram[:, -1] * np.sqrt(2)), 1e-12))
    return w * root[:, None], root


def embedded(terms: DataFrame) -> DataFrame:
    """topic, term, part, parts, n, rows: the entries of the leading eigenvectors over the root of the degree, the largest eigenvalue first."""
    wide = units(terms).select("topic", "term", F.transform(F.concat("u", F.array(F.lit(1.0))), lambda x: x / F.sqrt(F.lit(2.0))).alias("w"))
    own = stored(dealt(wide, "term"))
    first = grams(own, "w")

    def normal(left: pa.Table, right: pa.Table) -> pa.Table:
        w = _matrix(left["w"])
        n, root = _scaled(w, _matrix(right["gram"]).reshape(w.shape[1], -1))
        return left.drop(["w"]).append_column("v", _lists(n)).append_column("root", pa.array(root.tolist(), pa.float64()))

    scaled = in_arrow(own.groupBy(*_BY).cogroup(_spread(own, first).groupBy(*_BY)), normal, "topic string, term string, parts int, part int, v array<double>, root double")
    scaled = stored(scaled)

    def turn(left: pa.Table, right: pa.Table) -> pa.Table:
        v = _matrix(left["v"])
        values, vectors = np.linalg.eigh(_matrix(right["gram"]).reshape(v.shape[1], -1))
        lead = np.argsort(-values)[: MOST_CLUSTERS - 1]
        lead = lead[values[lead] > 1e-10]
        rows = v @ (vectors[:, lead] / np.sqrt(values[lead])) * left["root"].to_numpy()[:, None]
        rows = np.pad(rows, ((0, 0), (0, MOST_CLUSTERS - 1 - rows.shape[1])))
        return left.drop(["v", "root"]).append_column("rows", _lists(rows))

    out = in_arrow(scaled.groupBy(*_BY).cogroup(_spread(own, grams(scaled, "v")).groupBy(*_BY)), turn, "topic string, term string, parts int, part int, rows array<double>")
    return out.join(own.groupBy("topic").agg(F.count("*").alias("n")), "topic")


def _first_places(sizes: pd.Series) -> pd.Series:
    return pd.Series([int(np.random.default_rng(0).choice(n, 1)[0]) + 1 for n in sizes])


def _starts(own: DataFrame) -> DataFrame:
    """topic, k, centres (k numbers each, one after the other): the row that the first centre is, for every k."""
    first = F.pandas_udf(_first_places, "long")
    places = ranked(own.select("topic", "term", "n", "rows"), "topic", [F.col("term")], "place")
    chosen_rows = places.join(own.groupBy("topic").agg(F.max("n").alias("m")).select("topic", first("m").alias("place")), ["topic", "place"])
    ks = F.explode(F.sequence(F.lit(2), F.least("n", F.lit(MOST_CLUSTERS)).cast("int") - 1))
    return chosen_rows.where("n >= 3").select("topic", "rows", ks.alias("k")).select("topic", "k", F.slice("rows", F.lit(1), F.col("k")).alias("centres"))


def _by_topic(centres: DataFrame) -> DataFrame:
    """topic, all: the centres of every k, at most MOST_CLUSTERS of them."""
    return centres.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("k", "centres"))).alias("all"))


def _squares_to(rows: np.ndarray, k: int, flat: list) -> np.ndarray:
    centres = np.array(flat, float).reshape(-1, k)
    return np.stack([((rows[:, :k] - c) ** 2).sum(1) for c in centres], 1)


def _farthest(left: pa.Table, right: pa.Table) -> pa.Table:
    out: dict[str, list] = {"topic": [], "k": [], "d": [], "term": [], "at": []}
    if len(right):
        terms = left["term"].to_pylist()
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rows = _matrix(left["rows"])[order]
        for one in right["all"][0].as_py():
            k = one["k"]
            if len(one["centres"]) < k * k:
                far = _squares_to(rows, k, one["centres"]).min(1)
                i = int(far.argmax())
                for name, value in zip(out, (left["topic"][0].as_py(), k, float(far[i]), terms[order[i]], rows[i, :k].tolist()), strict=True):
                    out[name].append(value)
    return pa.table({"topic": pa.array(out["topic"], pa.string()), "k": pa.array(out["k"], pa.int32()), "d": pa.array(out["d"], pa.float64()), "term": pa.array(out["term"], pa.string()), "at": pa.array(out["at"], pa.list_(pa.float64()))})


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each k and centre: the sum of the rows that it is nearest to, and their number as the last cell."""
    topics, ks, sums = [], [], []
    if len(right):
        rows = _matrix(left["rows"])
        for one in right["all"][0].as_py():
            k = one["k"]
            member = (_squares_to(rows, k, one["centres"]).argmin(1)[:, None] == np.arange(k)).astype(float)
            topics.append(left["topic"][0].as_py())
            ks.append(k)
            sums.append(np.concatenate([member.T @ rows[:, :k], member.sum(0)[:, None]], 1).ravel().tolist())
    return pa.table({"topic": pa.array(topics, pa.string()), "k": pa.array(ks, pa.int32()), "sums": pa.array(sums, pa.list_(pa.float64()))})


def _moved(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a topic and k: centres after a pass; one without rows stays where it is."""
    out = []
    for r in pdf.itertuples():
        was, s = np.array(r.centres, float).reshape(-1, r.k), np.array(r.sums, float).reshape(-1, r.k + 1)
        now = np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), was)
        still = bool(np.allclose(now, was))
        out.append((r.topic, r.k, (was if still else now).ravel().tolist(), still))
    return pd.DataFrame(out, columns=["topic", "k", "centres", "still"])


def k_means(own: DataFrame) -> DataFrame:
    """topic, k, centres for every k; own: as embedded() gives it, stored. Starts are the farthest rows one after the other."""
    blocks = own.select("topic", "part", "term", "rows").groupBy(*_BY)
    centres = stored(_starts(own))
    for _ in range(MOST_CLUSTERS - 2):
        found = in_arrow(blocks.cogroup(_spread(own, _by_topic(centres)).groupBy(*_BY)), _farthest, "topic string, k int, d double, term string, at array<double>")
        far = found.groupBy("topic", "k").agg(F.min(F.struct((-F.col("d")).alias("d"), "term", "at")).alias("far"))
        centres = stored(centres.join(far, ["topic", "k"], "left").select("topic", "k", F.concat("centres", F.coalesce("far.at", F.array().cast("array<double>"))).alias("centres")))
    moving, done = centres, []
    for _ in range(PASSES):
        if moving.isEmpty():
            break
        found = in_arrow(blocks.cogroup(_spread(own, _by_topic(moving)).groupBy(*_BY)), _sums, "topic string, k int, sums array<double>")
        cells = found.select("topic", "k", F.posexplode("sums").alias("at", "x")).groupBy("topic", "k", "at").agg(F.sum("x").alias("x"))
        sums = cells.groupBy("topic", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))
        after = stored(moving.join(sums, ["topic", "k"]).mapInPandas(lambda batches: map(_moved, batches), "topic string, k int, centres array<double>, still boolean"))
        done.append(after.where("still").drop("still"))
        moving = after.where("not still").drop("still")
    return _union([*done, moving])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _assigned(left: pa.Table, right: pa.Table) -> pa.Table:
    """The nearest centre of each row for every k, numbered over all k."""
    rows = _matrix(left["rows"])
    labels = np.zeros((len(rows), 0), np.int32)
    if len(right):
        labels = np.stack([_squares_to(rows, one["k"], one["centres"]).argmin(1) for one in right["all"][0].as_py()], 1)
    return pa.table({"topic": left["topic"], "term": left["term"], "labels": pa.array(labels.tolist(), pa.list_(pa.int32()))})


def _distances_by_level(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of distances to the clusters of every k, one k after the other, and how many rows these clusters have in the right blocks."""
    levels = len(left["labels"][0])
    sums = np.zeros((len(left), levels * (levels + 3)))
    if len(right):
        labels = np.array(right["labels"].to_pylist(), int).reshape(len(right), -1)
        member = np.concatenate([(labels[:, i, None] == np.arange(i + 2)).astype(float) for i in range(labels.shape[1])] or [np.zeros((len(right), 0))], 1)
        sums = np.concatenate([distance_sums(left, right, member), np.repeat(member.sum(0)[None], len(left), 0)], 1)
    return pa.table({"topic": left["topic"], "term": left["term"], "labels": left["labels"], "sums": _lists(sums)})


def _scored(own: pa.Table) -> pa.Table:
    """Silhouettes of the rows of one group for every k, from the sums of all blocks. Clusters without rows are left out."""
    order = sorted(range(len(own)), key=own["term"].to_pylist().__getitem__)
    own = own.take(pa.array(order))
    terms = own["term"].to_pylist()
    starts = [i for i, t in enumerate(terms) if not i or terms[i - 1] != t]
    rows = own.take(pa.array(starts))
    labels = np.array(rows["labels"].to_pylist(), int).reshape(len(rows), -1)
    values = np.zeros(labels.shape)
    if labels.shape[1]:
        both = np.add.reduceat(_matrix(own["sums"]), starts, axis=0)
        sums, counts = np.split(both, 2, axis=1)
        at, every = 0, np.arange(len(rows))
        for i in range(labels.shape[1]):
            s, c, mine = sums[:, at : at + i + 2], counts[:, at : at + i + 2], labels[:, i]
            at += i + 2
            a = s[every, mine] / np.maximum(c[every, mine] - 1, 1)
            means = np.where(c > 0, s / np.maximum(c, 1), np.inf)
            means[every, mine] = np.inf
            b = means.min(1)
            good = (c[every, mine] > 1) & np.isfinite(b)
            values[:, i] = np.where(good, (np.where(good, b, 0) - a) / np.maximum(np.maximum(a, np.where(good, b, 0)), 1e-300), 0)
    return pa.table({"topic": rows["topic"], "term": rows["term"], "labels": rows["labels"], "values": _lists(values)})


def cluster_terms(terms: DataFrame) -> DataFrame:
    """topic, term, cluster, silhouette, best_k: as cluster_rounds.cluster_terms(), by k-means on eigenvectors; best_k counts clusters that have terms.

    A topic with at most FINISH terms is one task, which gives the same; larger ones are blocks.
    """
    rows = stored(terms.where("topic is not null and term is not null and vec is not null").groupBy("topic", "term").agg(F.min(F.col("vec").cast("array<double>")).alias("vec")))
    sizes = rows.groupBy("topic").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > FINISH)
    few = rows.join(sizes.where(F.col("n") <= FINISH).select("topic"), "topic", "left_semi")
    small = clusters.cluster_terms(few, "spectral").select("topic", "term", "cluster", "silhouette", F.col("best_k"))
    return small if large.isEmpty() else small.unionByName(by_blocks(rows.join(large.select("topic"), "topic", "left_semi")))


def by_blocks(terms: DataFrame) -> DataFrame:
    """cluster_terms() for topics of any size."""
    own = stored(embedded(terms))
    centres = stored(k_means(own))
    by_topic = _spread(own, _by_topic(centres))
    labels = in_arrow(own.select("topic", "part", "term", "rows").groupBy(*_BY).cogroup(by_topic.groupBy(*_BY)), _assigned, "topic string, term string, labels array<int>")
    rows, again = stored_twice(dealt(points(terms).join(labels, ["topic", "term"]), "term"))
    sums = in_arrow(_pairs(rows, again), _distances_by_level, "topic string, term string, labels array<int>, sums array<double>")
    pieces = sums.withColumn("piece", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SPLIT))).join(rows.select("topic", "term", "part"), ["topic", "term"])
    scored = stored(pieces.groupBy("topic", "part", "piece").applyInArrow(lambda t: _scored(t), "topic string, term string, labels array<int>, values array<double>"))
    found = chosen(scored, rows.select("topic").distinct().withColumn("heights", F.array().cast("array<double>"))).drop("cut_height", "best_k")
    names = found.groupBy("topic", "cluster").agg(F.min("term").alias("first"))
    levels = names.groupBy("topic").agg(F.array_sort(F.collect_list("first")).alias("firsts"), F.count("*").cast("int").alias("best_k"))
    numbered = names.join(levels, "topic").select("topic", F.col("cluster").alias("was"), (F.array_position("firsts", F.col("first")) - 1).cast("int").alias("cluster"), "best_k")
    out = found.withColumnRenamed("cluster", "was").join(numbered, ["topic", "was"])
    return out.select("topic", "term", "cluster", "silhouette", "best_k")
