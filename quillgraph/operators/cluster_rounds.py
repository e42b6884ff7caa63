"""Ward clusters of a topic of any size, with the number of clusters by silhouette and the height to cut the tree at.

Rows of a topic's cosine matrix are never made: their distances are those of points with as many coordinates as a vector has,
u times a root of the topic's sum of u u', which is one aggregate. Pairs that are each other's nearest merge, all of a round at once
(Ward's distance never falls by a merge, so they are pairs of the tree that one merge after the other gives); nearest
ones come from products of blocks, so a large topic is more tasks and not a larger one. After a round only clusters that merged, or whose
nearest one did, are compared with all; the others keep theirs and are compared with the new ones. A topic with at most FINISH clusters left
ends in one task. Silhouettes of every number of clusters come from one pass over pairs of blocks: distances are
summed by the finest clusters, and coarser ones are sums of these.

Rounds grow with the logarithm of a topic's terms unless its points lie in a chain of growing gaps, where one pair merges a round.
Rows without topic, term or vector take no part; a term that stands twice in a topic counts with the smaller vector; vectors
of a topic have one length; one of zeros is like no other. Equal distances go by term. A topic of one or two terms is one cluster.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stored, stored_twice
from .clusters import MOST_CLUSTERS, MOST_TERMS, ward

#: Rows of a block, blocks that meet one beside each other, clusters of a topic that one task merges to the end.
BLOCK, WIDE, FINISH = 4096, 8, MOST_TERMS
CHUNK, SLICE, CLOSE, PLACES = 256, 2048, 1 << 14, 9
#: Share of the height of the last merge that is undone.
CUT_SHARE = 0.9


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray) and len(column) and not column.null_count:
        flat = pa.compute.list_flatten(column)
        if not flat.null_count:
            return flat.to_numpy().astype(float).reshape(len(column), -1)
    return np.array([*column.to_pylist()] if hasattr(column, "to_pylist") else [*column], float).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ (-2 * b.T)
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None]
    return np.maximum(out, 0, out=out)


def _lists(values: np.ndarray) -> pa.Array:
    """A list of numbers for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values, float).ravel()))


def in_arrow(both, f, fields: str) -> DataFrame:
    """f(left, right) for each pair of groups; a group without left rows, which has no columns either, gives none."""
    none = to_arrow_schema(StructType.fromDDL(fields)).empty_table()
    return both.applyInArrow(lambda left, right: f(left, right) if len(left) else none, fields)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows with part and parts: blocks of about BLOCK rows within a topic."""
    parts = rows.groupBy("topic").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    return rows.join(parts, "topic").withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int"))


def _pairs(left: DataFrame, right: DataFrame):
    """Every block of left with all of the same topic's right, WIDE blocks of it at a time; both dealt alike."""
    asks = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / WIDE).cast("int")))).withColumnRenamed("part", "a").drop("parts")
    answers = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("b", F.floor(F.col("part") / WIDE).cast("int")).drop("part", "parts")
    return asks.groupBy("topic", "a", "b").cogroup(answers.groupBy("topic", "a", "b"))


def units(terms: DataFrame) -> DataFrame:
    """topic, term, u: vectors of length one (or zero), a row a term."""
    own = terms.where("topic is not null and term is not null and vec is not null").select("topic", "term", F.col("vec").cast("array<double>").alias("vec"))
    own = own.groupBy("topic", "term").agg(F.min("vec").alias("vec"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return own.withColumn("size", size).select("topic", "term", F.transform("vec", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(0.0)).alias("u"))


def grams(blocks: DataFrame, vec: str) -> DataFrame:
    """topic, gram: the sum of v v' over a topic, its rows one after the other."""

    def partial(own: pa.Table) -> pa.Table:
        v = _matrix(own[vec])
        return pa.table({"topic": own["topic"][:1], "gram": pa.array([(v.T @ v).ravel().tolist()], pa.list_(pa.float64()))})

    sums = blocks.select("topic", "part", vec).groupBy("topic", "part").applyInArrow(partial, "topic string, gram array<double>")
    cells = sums.select("topic", F.posexplode("gram").alias("at", "x")).groupBy("topic", "at").agg(F.sum("x").alias("x"))
    return cells.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("gram"))


def points(terms: DataFrame) -> DataFrame:
    """topic, term, at: points whose distances are those of the rows of the topic's cosine matrix."""
    own = stored(dealt(units(terms), "term"))
    spread = grams(own, "u").join(own.groupBy("topic").agg(F.max("parts").alias("parts")), "topic")
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def turn(left: pa.Table, right: pa.Table) -> pa.Table:
        u = _matrix(left["u"])
        values, vectors = np.linalg.eigh(_matrix(right["gram"]).reshape(u.shape[1], u.shape[1]))
        u = u @ (vectors * np.sqrt(np.maximum(values, 0)))
        return pa.table({"topic": left["topic"], "term": left["term"], "at": pa.array(u.tolist(), pa.list_(pa.float64()))})

    by = ["topic", "part"]
    return in_arrow(own.groupBy(*by).cogroup(spread.groupBy(*by)), turn, "topic string, term string, at array<double>")


def _least(a: np.ndarray, s: np.ndarray, b: np.ndarray, t: np.ndarray, own: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the least distance to rows of b and the first that has it; own: the row itself in b, or -1. s, t: sizes."""
    found = _squares(a, b)
    found /= 1 / s[:, None] + 1 / t[None]  # half of Ward's distance
    itself = np.flatnonzero(own >= 0)
    found[itself, own[itself]] = np.inf
    least = found.min(1)
    rows, close = np.divmod(np.flatnonzero((found <= (least + scale * s)[:, None]).ravel()), len(b))  # products are off in their last places: close ones are judged by differences
    real = np.isfinite(found[rows, close])
    rows, close = rows[real], close[real]
    exact = np.concatenate([np.zeros(0), *[((a[i] - b[j]) ** 2).sum(1) * (2 * (s[i] * t[j]) / (s[i] + t[j])) for i, j in ((rows[at : at + CLOSE], close[at : at + CLOSE]) for at in range(0, len(rows), CLOSE))]])
    order = np.lexsort((close, exact, rows))
    first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
    best, where = np.full(len(a), np.inf), np.full(len(a), -1)
    best[rows[first]], where[rows[first]] = exact[first], close[first]
    return best, where


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows that have their nearest one (other, d) are compared with fresh rows only."""
    ids = left["id"].to_pylist()
    best, other = left["d"].fill_null(np.inf).to_numpy().copy(), np.array(left["other"].to_pylist(), object)
    if len(right):
        others = right["id"].to_pylist()
        a, s = _matrix(left["at"]), left["size"].to_numpy().astype(float)
        every, sizes, fresh = _matrix(right["at"]), right["size"].to_numpy().astype(float), right["fresh"].to_numpy()
        order = np.array(sorted(range(len(others)), key=others.__getitem__))  # equal distances go by term
        has = left["other"].is_valid().to_numpy()
        scale = 1e-10 * max(float((a * a).sum(1).max()), float((every * every).sum(1).max()))
        for rows, among in ((np.flatnonzero(~has), order), (np.flatnonzero(has), order[fresh[order]])):
            b, t = every[among], sizes[among]
            place = {others[j]: i for i, j in enumerate(among)}
            for low in range(0, len(rows), CHUNK):
                mine = rows[low : low + CHUNK]
                own = np.array([place.get(ids[i], -1) for i in mine])
                for at in range(0, len(b), SLICE):
                    inside = np.where((own >= at) & (own < at + SLICE), own - at, -1)
                    d, i = _least(a[mine], s[mine], b[at : at + SLICE], t[at : at + SLICE], inside, scale)
                    for k in np.flatnonzero((i >= 0) & (d <= best[mine])):
                        name = others[among[at + i[k]]]
                        if d[k] < best[mine[k]] or other[mine[k]] is None or name < other[mine[k]]:
                            best[mine[k]], other[mine[k]] = d[k], name
    known = np.flatnonzero(other != None)  # noqa: E711
    topic = left["topic"].slice(0, 1).to_pylist() * len(known)
    return pa.table({"topic": pa.array(topic, pa.string()), "id": pa.array([ids[i] for i in known], pa.string()), "other": pa.array(other[known].tolist(), pa.string()), "d": pa.array(best[known], pa.float64())})


def nearest(clusters: DataFrame) -> DataFrame:
    """topic, id, m (d, other): each cluster's nearest one. clusters: as _joined() gives them."""
    found = in_arrow(_pairs(*stored_twice(dealt(clusters, "id"))), _nearest, "topic string, id string, other string, d double")
    return found.groupBy("topic", "id").agg(F.min(F.struct("d", "other")).alias("m"))


def merges(best: DataFrame) -> DataFrame:
    """topic, lo, hi, d: the pairs that are each other's nearest; where rounding leaves a topic none, its least pair. best: as nearest() gives it."""
    pairs = best.groupBy("topic", F.least("id", "m.other").alias("lo"), F.greatest("id", "m.other").alias("hi")).agg(F.count("*").alias("n"), F.min("m.d").alias("d"))
    tops = pairs.groupBy("topic").agg(F.max("n").alias("most"), F.min(F.struct("d", "lo", "hi")).alias("least"))
    return pairs.join(tops, "topic").where((F.col("n") == 2) | ((F.col("most") == 1) & (F.struct("d", "lo", "hi") == F.col("least")))).select("topic", "lo", "hi", "d")


def _joined(clusters: DataFrame, links: DataFrame, best: DataFrame) -> DataFrame:
    """Clusters after these merges: topic, id (the smallest term), size, at (the mean), fresh (merged), and the nearest one (other, d) of those that still have it."""
    goes = clusters.select("topic", "id", "size", "at").join(links.select("topic", F.col("hi").alias("id"), F.col("lo").alias("to")), ["topic", "id"], "left")
    rows = goes.groupBy("topic", F.coalesce("to", "id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("was"), "size", "at"))).alias("m"))
    m = F.col("m")
    mean = F.zip_with(m[0]["at"], m[1]["at"], lambda x, y: (x * m[0]["size"] + y * m[1]["size"]) / (m[0]["size"] + m[1]["size"]))
    two = F.size(m) == 2
    rows = rows.select("topic", "id", F.when(two, m[0]["size"] + F.get(m, F.lit(1))["size"]).otherwise(m[0]["size"]).alias("size"), F.when(two, mean).otherwise(m[0]["at"]).alias("at"), two.alias("fresh"))
    ends = links.select("topic", F.explode(F.array("lo", "hi")).alias("other"))
    kept = best.select("topic", "id", "m.other", "m.d").join(ends, ["topic", "other"], "left_anti").select("topic", "id", "other", "d")
    still = lambda c: F.when(~F.col("fresh"), F.col(c)).alias(c)
    return rows.join(kept, ["topic", "id"], "left").select("topic", "id", "size", "at", "fresh", still("other"), still("d"))


_LINKS = "topic string, lo string, hi string, height double, size long, round int, step int"


def _finished(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id").reset_index(drop=True)
    n, names = len(pdf), pdf["id"].tolist()
    first, out = {i: i for i in range(n)}, []
    for step, (x, y, height, size) in enumerate(ward(np.stack(pdf["at"].tolist()), pdf["size"].to_numpy(float))):
        lo, hi = sorted((first.pop(int(x)), first.pop(int(y))))
        first[n + step] = lo
        out.append((pdf["topic"][0], names[lo], names[hi], height, int(size), pdf["round"][0], step))
    return pd.DataFrame(out, columns=["topic", "lo", "hi", "height", "size", "round", "step"])


def tree(at: DataFrame) -> DataFrame:
    """The merges of each topic: topic, lo, hi (clusters by their smallest terms; the result is lo), height, size, round, step.

    at: as points() gives them. A topic's merges in order of height (then round and step) are its linkage.
    """
    own = stored(at.select("topic", F.col("term").alias("id"), F.lit(1.0).alias("size"), "at", F.lit(True).alias("fresh"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("d")))
    done: list[DataFrame] = []
    while True:
        large = own.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") > FINISH).select("topic")
        if large.isEmpty():
            break
        best = stored(nearest(own.join(large, "topic", "left_semi")))
        links = stored(merges(best))
        own = stored(_joined(own, links, best))
        made = links.join(own.select("topic", F.col("id").alias("lo"), F.col("size").cast("long").alias("size")), ["topic", "lo"])
        done.append(made.select("topic", "lo", "hi", F.sqrt("d").alias("height"), "size", F.lit(len(done)).alias("round"), F.lit(0).alias("step")))
    last = own.select("topic", "id", "size", "at").withColumn("round", F.lit(len(done))).groupBy("topic").applyInPandas(_finished, _LINKS)
    return stored(reduce(DataFrame.unionByName, [*done, last]))


def _topmost(links: DataFrame, most: int) -> DataFrame:
    """The highest merges of each topic, place from 1."""
    w = Window.partitionBy("topic").orderBy(F.round("height", PLACES).desc(), F.desc("round"), F.desc("step"), "lo", "hi")
    return links.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def _followed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """topic, term, root: where links lead from a term, each step twice as far as the one before."""
    own = stored(rows.select("topic", "term").join(links.select("topic", F.col("hi").alias("term"), F.col("lo").alias("up")), ["topic", "term"], "left").select("topic", "term", F.coalesce("up", "term").alias("root")))
    while True:
        ahead = own.select("topic", F.col("term").alias("root"), F.col("root").alias("up"))
        further = stored(own.join(ahead, ["topic", "root"]).select("topic", "term", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        if further.where("moved").isEmpty():
            return further.drop("moved")
        own = further.drop("moved")


def _levels(fine: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
    """One topic's finest clusters by first term, and their numbers for every k from 2 on."""
    fine = fine.sort_values("root")
    roots, cuts = fine["root"].tolist(), cuts.sort_values("place")
    maps = []
    for k in range(2, len(roots) + 1):
        up = dict(zip(cuts["hi"][k - 1 :], cuts["lo"][k - 1 :], strict=True))
        ends = []
        for r in roots:
            while r in up:
                r = up[r]
            ends.append(r)
        number = {r: i for i, r in enumerate(sorted(set(ends)))}
        maps.append([number[r] for r in ends])
    return pd.DataFrame({"topic": fine["topic"].iloc[:1].tolist(), "roots": [roots], "counts": [fine["n"].tolist()], "maps": [maps], "heights": [cuts["height"].tolist()], "parts": [int(fine["parts"].max())]})


def _distances(left: pa.Table, right: pa.Table) -> pa.Table:
    """The sum of distances of each left row to the right rows of each of the finest clusters."""
    sums = np.zeros((len(left), 0))
    if len(right):
        number = right["number"].to_numpy()
        sums = distance_sums(left, right, (number[:, None] == np.arange(right["kinds"][0].as_py())).astype(float))
    return pa.table({"topic": left["topic"], "term": left["term"], "number": left["number"], "part": left["a"], "sums": _lists(sums)})


def distance_sums(left: pa.Table, right: pa.Table, member: np.ndarray) -> np.ndarray:
    """The sums of distances of each left row to the right rows of each column of member; a row is at no distance from itself."""
    a, b = _matrix(left["at"]), _matrix(right["at"])
    place = {t: i for i, t in enumerate(right["term"].to_pylist())}
    own = np.array([place.get(t, -1) for t in left["term"].to_pylist()])
    sums = np.zeros((len(a), member.shape[1]))
    for low in range(0, len(a), CHUNK):
        for at in range(0, len(b), SLICE):
            d = _squares(a[low : low + CHUNK], b[at : at + SLICE])
            np.sqrt(d, out=d)
            mine = own[low : low + CHUNK] - at
            itself = np.flatnonzero((mine >= 0) & (mine < d.shape[1]))
            d[itself, mine[itself]] = 0
            sums[low : low + CHUNK] += d @ member[at : at + SLICE]
    return sums


def _scores(sums: np.ndarray, number: np.ndarray, counts: np.ndarray, maps: list) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and silhouette of each row for every k."""
    labels, out = np.zeros((len(sums), len(maps)), np.int32), np.zeros((len(sums), len(maps)))
    rows = np.arange(len(sums))
    for at, levels in enumerate(maps):
        levels = np.asarray(levels)
        member = (levels[:, None] == np.arange(levels.max() + 1)).astype(float)
        count, own = counts @ member, levels[number]
        total = sums @ member
        a = total[rows, own] / np.maximum(count[own] - 1, 1)
        means = total / count
        means[rows, own] = np.inf
        b = means.min(1)
        labels[:, at], out[:, at] = own, np.where(count[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
    return labels, out


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    level = right.to_pylist()[0]
    labels, values = _scores(_matrix(left["sums"])[:, : len(level["roots"])], left["number"].to_numpy(), np.array(level["counts"], float), level["maps"])
    return pa.table({"topic": left["topic"], "term": left["term"], "labels": pa.array(labels.tolist(), pa.list_(pa.int32())), "values": pa.array(values.tolist(), pa.list_(pa.float64()))})


def cluster_terms(terms: DataFrame) -> DataFrame:
    """topic, term, cluster (by first term), silhouette, best_k, cut_height.

    best_k is the number of clusters from 2 up (below the terms and MOST_CLUSTERS) with the largest mean silhouette, the first of equals;
    cut_height the share CUT_SHARE of the height of the last merge that it undoes (null for one cluster). terms: topic (string), term, vec.
    """
    at = stored(points(terms))
    links = tree(at)
    sizes = at.groupBy("topic").agg(F.count("*").alias("terms"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    most = F.greatest(F.lit(1), F.least("terms", F.lit(MOST_CLUSTERS)) - 1)
    cuts = stored(_topmost(links, MOST_CLUSTERS - 2).join(sizes, "topic").where(F.col("place") < most).select("topic", "lo", "hi", "height", "place"))
    roots = _followed(at, links.join(cuts, ["topic", "lo", "hi"], "left_anti"))
    fine = roots.groupBy("topic", "root").agg(F.count("*").alias("n")).join(sizes.select("topic", "parts"), "topic")
    levels = fine.groupBy("topic").cogroup(cuts.groupBy("topic")).applyInPandas(lambda f, c: _levels(f, c), "topic string, roots array<string>, counts array<long>, maps array<array<int>>, heights array<double>, parts int")
    levels = stored(levels)
    numbered = levels.select("topic", F.size("roots").alias("kinds"), F.posexplode("roots").alias("number", "root"))
    rows = stored_twice(dealt(at.join(roots, ["topic", "term"]).join(numbered, ["topic", "root"]).drop("root"), "term"))
    sums = in_arrow(_pairs(*rows), _distances, "topic string, term string, number int, part int, sums array<double>")
    total = sums.groupBy("topic", "term", "number", "part").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(MOST_CLUSTERS - 1)]).alias("sums"))
    total = total.withColumn("sums", F.transform("sums", lambda x: F.coalesce(x, F.lit(0.0))))
    spread = levels.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["topic", "part"]
    scored = stored(in_arrow(total.groupBy(*by).cogroup(spread.groupBy(*by)), _scored, "topic string, term string, labels array<int>, values array<double>"))
    return chosen(scored, levels)


def chosen(scored: DataFrame, levels: DataFrame) -> DataFrame:
    """The number of clusters with the largest mean silhouette, and each row's cluster and silhouette there."""
    means = scored.groupBy("topic").agg(F.array_compact(F.array(*[F.round(F.avg(F.get("values", F.lit(i))), 12) for i in range(MOST_CLUSTERS - 2)])).alias("means"))
    best = means.select("topic", F.when(F.size("means") > 0, F.array_position("means", F.array_max("means")) - 1).cast("int").alias("at"))
    best = best.join(levels.select("topic", "heights"), "topic").select("topic", "at", (F.get("heights", F.col("at")) * CUT_SHARE).alias("cut_height"))
    one = F.col("at").isNull()
    return scored.join(best, "topic").select(
        "topic", "term", F.when(one, 0).otherwise(F.get("labels", F.col("at"))).cast("int").alias("cluster"), F.when(one, 0.0).otherwise(F.get("values", F.col("at"))).alias("silhouette"),
        F.coalesce(F.col("at") + 2, F.lit(1)).cast("int").alias("best_k"), "cut_height",
    )
