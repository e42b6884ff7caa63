"""MinHash near-dedup with odd sketches.

1. Each text becomes a shingle set, MinHash samples, band keys and an odd sketch (samples folded into parities of a
   bitmap). Equal sets form one class, so thousands of copies count as one node from here on.
2. Nodes that share a band key are candidates. In each bucket every node is compared with one centre, the least
   node: first by the population count of the sketches' XOR, then, if that leaves a chance, on full sets.
3. Links give components. A bucket that still holds several is searched for links between them: a small one pair by
   pair (sketch, then full sets), a large one in blocks of bounded size that compare full sets as matrix products and
   return a spanning forest of the links. Nodes of one component aren't compared again, so a large group costs
   its size and not its square; only what stays outside the bucket's main component meets all others.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6. Sketches may only dismiss a pair whose
estimate is 0.25 (``MARGIN``) under the threshold; every link is confirmed on full sets.

Defined cases: null text, or one without words, has an empty set and is linked with nothing; with fewer words than a
shingle the whole sequence is the one shingle; rows that share a doc_id are one document (linked); rows without a
doc_id take part, and their component_id is null if no member of it has a doc_id; they are never ``kept``; an empty table
gives an empty one; of other columns the operator takes none, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget_stored, shuffles_dropped, stored, stored_few, stored_so_far
from . import minhash
from .common import short_batches, slices, table, texts_as_bytes
from .components import components

PERCENT = 75
#: What a sketch's estimate may lie under the threshold.
MARGIN = 0.25
#: Buckets up to this size are compared pair by pair, larger ones in blocks of about BLOCK nodes a side.
SMALL, BLOCK = 32, 512
#: Ids that may be broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_ROWS = 250_000
#: Node ids of classes without any doc_id start here.
NAMELESS = 1 << 62


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints, sizes, keys, sketches = [], [], [], []
        for raw in texts_as_bytes(batch):
            own = minhash.shingles(raw)
            sizes.append(len(own))
            if len(own):
                low = minhash.samples(own)
                prints.append(minhash.fingerprint(own))
                keys.append(minhash.bands(low))
                sketches.append(minhash.odd_sketch(low))
            else:
                prints.append(None)
                keys.append(None)
                sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), batch.column("row")],
            names=["doc_id", "n_shingles", "print", "bands", "sketch", "row"],
        )


def _by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches (sa, sb) leave a chance."""
    for batch in batches:
        if len(batch):
            a = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8).reshape(len(batch), -1)
            b = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8).reshape(len(batch), -1)
            keep = minhash.estimate(minhash.population(a, b)) >= PERCENT / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one bucket, of different components, whose sketches leave a chance."""
    for batch in batches:
        left, right = [], []
        for members in batch.column("members").to_pylist():
            nodes, labels = np.array([m["node"] for m in members]), np.array([m["label"] for m in members])
            bits = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), -1)
            i, j = np.triu_indices(len(members), 1)
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
            keep = minhash.estimate(minhash.population(bits[i], bits[j])) >= PERCENT / 100 - MARGIN
            left += np.maximum(nodes[i], nodes[j])[keep].tolist()
            right += np.minimum(nodes[i], nodes[j])[keep].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are links on full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def linked(shared, x, y):
    """100 * intersection >= 75 * union."""
    return 100 * shared >= PERCENT * (x + y - shared)


def intersections(sets: list[np.ndarray], n: int, slab: int = 2048) -> np.ndarray:
    """Shared elements of each of the first n sets with each other one of all (elements of one set alone are left out), by products of 0/1 matrices over slabs of elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, len(sets)), np.float32)
    for low in range(0, int((count > 1).sum()), slab):
        a, b = np.searchsorted(place, (low, low + slab))
        matrix = np.zeros((len(sets), slab), np.float32)
        matrix[owner[a:b], place[a:b] - low] = 1
        out += matrix[:n] @ matrix.T
    return out.astype(np.int64)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the block's first side and both sides, over the components known so far."""
    pdf = pdf.sort_values(["second", "node"]).drop_duplicates("node")  # a node of both sides counts for the first
    n = int((~pdf["second"]).sum())
    sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
    nodes, labels = pdf["node"].to_numpy(), pdf["label"].to_numpy()
    size = np.array([len(s) for s in sets])
    found = linked(intersections(sets, n), size[:n, None], size[None, :]) & (labels[:n, None] != labels[None, :]) if n else np.zeros((0, 0), bool)
    parent = {x: x for x in labels.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for i, j in zip(*np.nonzero(found), strict=True):
        a, b = root(int(labels[i])), root(int(labels[j]))
        if a != b:
            parent[a] = b
            edges.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [minhash.shingles(raw).tobytes() for raw in texts_as_bytes(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint where the table, written already, is of a checked size."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _full_sets(signed: DataFrame, signatures: DataFrame, classes: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, set) for the nodes, n at most: the text of one member of each class is shingled again."""
    wanted = _bounded(stored_few(classes.join(nodes, "node").select("node", "print"), n))
    chosen = _bounded(stored_few(signatures.join(wanted, "print").groupBy("node").agg(F.min("row").alias("row")), n))
    texts = signed.join(chosen, "row").groupBy("node").agg(F.first("text").alias("text"))  # one of repeated rows
    return stored(texts.mapInArrow(_sets, "node long, set binary"))


def _with_row(docs: DataFrame) -> DataFrame:
    """A row key: the doc_id and a hash of the text, the same in every scan."""
    return docs.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of_a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return stored(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text), written; what it was made from is deleted."""
    spark, mark = docs.sparkSession, stored_so_far()
    with shuffles_dropped(spark):
        found = stored(_found(spark, docs))
        forget_stored(spark, mark, but=1)
    return found


def _found(spark: SparkSession, docs: DataFrame) -> DataFrame:
    signed = _with_row(docs.select("doc_id", "text"))
    signatures = stored(signed.mapInArrow(_signatures, "doc_id long, n_shingles long, print binary, bands array<long>, sketch binary, row string"))
    full = signatures.where(F.col("print").isNotNull())
    held = full.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.xxhash64("print")).alias("p"), F.max(F.xxhash64("print")).alias("q"))
    torn = _bounded(stored(held.where("p != q").select("doc_id")))  # ids of several classes: they link these
    classes = full.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = classes.join(torn.withColumn("is_torn", F.lit(True)), "doc_id", "left")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("print"), F.lit(NAMELESS - 1))
    node = F.when(F.col("doc_id").isNull() | F.col("is_torn").isNotNull(), nameless).otherwise(F.col("doc_id"))
    classes = stored(classes.select("print", node.alias("node"), "bands", "sketch"))
    n = classes.count()
    id_links = full.select("doc_id", "print").join(torn, "doc_id").join(classes.select("print", "node"), "print").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    spread = classes.select("node", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1")
    members = stored(spread.join(buckets, "band"))
    sketches = classes.select("node", "sketch")
    star = members.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    star = star.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(sketches.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    star = stored(star.select("a", "b", "sa", "sb").mapInArrow(_by_sketch, "a long, b long"))
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    mark = stored_so_far()
    labels = components(_confirmed(star, _full_sets(signed, signatures, classes, ends(star), n)))
    forget_stored(spark, mark, but=1)

    placed = members.join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
    parts = placed.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed = stored(placed.join(parts, "band"))
    small = mixed.where(F.col("size") <= SMALL).join(sketches, "node").groupBy("band").agg(F.collect_list(F.struct("node", "label", "sketch")).alias("members"))
    pairs = stored(small.select("members").mapInArrow(_small_buckets, "a long, b long").distinct().join(star, ["a", "b"], "left_anti"))
    large = stored(_large_blocks(mixed.where(F.col("size") > SMALL)))
    wanted = ends(pairs).union(large.select("node")).distinct()
    sets = _full_sets(signed, signatures, classes, wanted, n)
    blocks = large.join(sets, "node").groupBy("block").applyInPandas(_block, "a long, b long")
    more = _confirmed(pairs, sets).union(blocks).union(id_links)
    every = labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)
    final = components(every)
    named = classes.select("print", "node").join(final, "node", "left").select("print", F.coalesce("label", "node").alias("component"))
    own = F.when(F.col("component") < NAMELESS, F.col("component"))
    return signatures.select("doc_id", "n_shingles", "print").join(named, "print", "left").select("doc_id", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(own).alias("component_id"))


def _large_blocks(mixed: DataFrame) -> DataFrame:
    """(block, second, node, label): each block pairs a chunk outside the bucket's main component with any chunk of the bucket."""
    other = (F.col("label") != F.col("main")).alias("other")
    counted = _bounded(stored(mixed.groupBy("band", other).agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))))  # so that a bucket's nodes need not meet in one task
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")
    placed = mixed.select("band", "node", "label", other).join(counted, ["band", "other"]).select("band", "other", "node", "label", chunk)
    every = counted.select("band", "other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"))
    first = every.where("other").select("band", F.col("chunk").alias("c1"))
    second = every.select("band", F.col("other").alias("o2"), F.col("chunk").alias("c2"))
    pairs = first.join(second, "band").where("not o2 or c1 <= c2").select("band", "c1", "o2", "c2", F.xxhash64("band", "c1", "o2", "c2").alias("block"))
    left = pairs.select("block", "band", F.lit(True).alias("other"), F.col("c1").cast("long").alias("chunk"), F.lit(False).alias("second"))
    right = pairs.select("block", "band", F.col("o2").alias("other"), F.col("c2").cast("long").alias("chunk"), F.lit(True).alias("second"))
    return placed.join(left.union(right), ["band", "other", "chunk"]).select("block", "second", "node", "label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row per document."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays; repeated rows of one doc_id count once, rows without doc_id can't be named as a copy and stay.

    Null and empty texts are no copies of each other and stay; an empty table stays empty; all columns stay, whatever
    their names, for the result is joined by doc_id alone.
    """
    short_batches(spark)
    mark, found = stored_so_far(), near_duplicates(docs)
    with shuffles_dropped(spark):
        gone = stored(found.where("doc_id is not null and doc_id != component_id").select("doc_id").distinct())
        again = stored(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id"))
    forget_stored(spark, mark, but=2)
    left = docs.join(_bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    few = _bounded(again)
    return left.join(few, "doc_id", "left_anti").unionByName(left.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
