"""The most similar terms of each term: exactly, by products of blocks, or through an index of hashed planes.

No pair table is made: rows of a group are dealt into blocks, a task multiplies one block with another and hands on the
n best of each of its rows, and those are merged. A group with many rows, a label or a bucket of the index, is more blocks and
not a larger task. The index puts a row into a bucket a table, by the side of random planes that it lies on; rows that
share a bucket in any table are compared exactly.

Similarity is the cosine (0 for a vector without length); equal ones, to nine places, go by key. Rows without key, group or vector
take no part; repeated keys of a group count once; a group of one row has no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a block; rows that a bucket should have, and tables of the index.
BLOCK, BUCKET, TABLES = 2048, 512, 24
PLACES = 9


def _unit(own: pa.Table, column: str) -> np.ndarray:
    v = np.array(own[column].to_pylist(), float).reshape(len(own), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def within(rows: DataFrame, group: list[str], n: int, key: str = "key", vec: str = "vec") -> DataFrame:
    """The group columns, key, other, similarity, place (from 1) of the n most similar others of each row in its group."""
    own = stored(rows.where(" and ".join(f"{c} is not null" for c in (*group, key, vec))).select(*group, F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec")).dropDuplicates([*group, "key"]))
    parts = own.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = own.join(parts, group).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asks = dealt.withColumn("with", others).select(*group, F.col("part").alias("a"), F.col("with").alias("b"), "key", "vec")
    answers = stored(dealt).withColumn("with", others).select(*group, F.col("with").alias("a"), F.col("part").alias("b"), "key", "vec")
    schema = rows.sparkSession.createDataFrame([], own.select(*group, "key", F.col("key").alias("other")).schema).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", similarity double"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["key"].to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)  # equal similarities go by key
        keys = [keys[i] for i in order]
        place = {k: i for i, k in enumerate(keys)}
        mine, candidates = left["key"].to_pylist(), _unit(right, "vec")[order] if len(right) else None
        out: dict[str, list] = {"key": [], "other": [], "similarity": []}
        if len(left) and len(right):
            a = _unit(left, "vec")
            for low in range(0, len(mine), 256):
                found = np.round(a[low : low + 256] @ candidates.T, PLACES)
                for k, row in zip(mine[low : low + 256], found, strict=True):
                    if k in place:
                        row[place[k]] = -np.inf
                    top = np.argsort(-row, kind="stable")[:n]
                    top = [i for i in top if row[i] > -np.inf]
                    out["key"] += [k] * len(top)
                    out["other"] += [keys[i] for i in top]
                    out["similarity"] += [float(row[i]) for i in top]
        which = left if len(left) else right
        fixed = {c: pa.array([which[c][0].as_py()] * len(out["key"]), which[c].type) for c in group}
        kind = which["key"].type
        return pa.table({**fixed, "key": pa.array(out["key"], kind), "other": pa.array(out["other"], kind), "similarity": pa.array(out["similarity"], pa.float64())})

    by = [*group, "a", "b"]
    found = asks.groupBy(*by).cogroup(answers.groupBy(*by)).applyInArrow(best, fields)
    w = Window.partitionBy(*group, "key").orderBy(F.desc("similarity"), "other")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def buckets(rows: DataFrame, width: int, bits: int, tables: int = TABLES, seed: int = 11, vec: str = "vec") -> DataFrame:
    """rows with tab and bucket: a row for each table."""
    planes = np.random.default_rng(seed).normal(size=(width, tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(vec).to_pylist(), float).reshape(len(batch), -1)
            sides = (v @ planes > 0).reshape(len(v), tables, bits) @ weights if len(v) else np.zeros((0, tables), np.int64)
            at = pa.array(np.repeat(np.arange(len(v)), tables))
            out = batch.take(at)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))), pa.array(sides.ravel().astype(np.int64))], names=[*batch.schema.names, "tab", "bucket"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(put, f"{fields}, tab int, bucket long")


def indexed(rows: DataFrame, group: str, n: int, key: str = "key", vec: str = "vec", bits: int | None = None, tables: int = TABLES) -> DataFrame:
    """As within(), through the index; one group column. Some of the n may be missed: measure it with recall()."""
    own = stored(rows.where(f"{group} is not null and {key} is not null and {vec} is not null").select(group, F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec")))
    first = own.first()
    if first is None:
        return within(own, [group], n)
    if bits is None:
        widest = own.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        bits = max(0, math.floor(math.log2(max(1, widest / BUCKET))))
    if not bits:
        return within(own, [group], n)
    found = within(buckets(own, len(first.vec), bits, tables), [group, "tab", "bucket"], n)
    every = found.groupBy(group, "key", "other").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy(group, "key").orderBy(F.desc("similarity"), "other")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def recall(found: DataFrame, exact: DataFrame, group: str) -> float:
    """The share of the exact pairs that were found."""
    hit = exact.join(found.select(group, "key", "other"), [group, "key", "other"], "left_semi").count()
    return hit / max(1, exact.count())
