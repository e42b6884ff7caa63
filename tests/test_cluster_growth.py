import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.operators import cluster_rounds


def test_clusters_that_keep_their_nearest_meet_new_ones_only(monkeypatch):
    rng = np.random.default_rng(3)
    at, size, names = rng.normal(size=(90, 5)), rng.integers(1, 4, 90).astype(float), [f"c{i:02d}" for i in range(90)]
    at[70], at[80] = at[12], at[13]  # ties: the smaller name is nearest
    d = ((at[:, None] - at[None]) ** 2).sum(-1) * 2 * size[:, None] * size[None] / (size[:, None] + size[None])
    np.fill_diagonal(d, np.inf)
    fresh = np.arange(90) % 9 == 4
    old = np.where(fresh[None], np.inf, d)
    lost = fresh | (np.arange(90) % 7 == 2)
    table = pa.table({"topic": ["a"] * 90, "id": names, "size": size, "at": at.tolist(), "fresh": fresh, "other": pa.array([None if x else names[i] for x, i in zip(lost, old.argmin(1), strict=True)], pa.string()), "d": pa.array([None if x else v for x, v in zip(lost, old.min(1), strict=True)], pa.float64())})
    pairs, squares = [], cluster_rounds._squares
    monkeypatch.setattr(cluster_rounds, "_squares", lambda a, b: pairs.append(len(a) * len(b)) or squares(a, b))
    monkeypatch.setattr(cluster_rounds, "SLICE", 16)
    found = cluster_rounds._nearest(table, table.take(pa.array(rng.permutation(90)))).to_pylist()
    assert [x["id"] for x in found] == names and [x["other"] for x in found] == [names[i] for i in d.argmin(1)] and np.allclose([x["d"] for x in found], d.min(1))
    assert sum(pairs) == lost.sum() * 90 + (~lost).sum() * fresh.sum()


def test_blocks_meet_many_blocks_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(cluster_rounds, "BLOCK", 10)
    rows = cluster_rounds.dealt(spark.range(160).select(F.lit("a").alias("topic"), F.col("id")), "id")
    other = cluster_rounds.dealt(spark.range(160).select(F.lit("a").alias("topic"), F.col("id")), "id")
    sizes = cluster_rounds._pairs(rows, other).applyInArrow(lambda x, y: pa.table({"n": [len(x) * len(y)]}), "n long").collect()
    assert sum(r.n for r in sizes) == 160 * 160 and len(sizes) == 16 * 2
