import numpy as np
import pytest

from quillgraph.operators import cluster_rounds, clusters


def table(spark, counts, width=6, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for topic, n in counts.items():
        centres = rng.normal(size=(4, width)) * 2
        rows += [(topic, f"t{i:05d}", [float(x) for x in centres[i % 4] + rng.normal(size=width) * (0.3 if i % 9 else 1.5)]) for i in range(n)]
    return spark.createDataFrame(rows, "topic string, term string, vec array<double>")


def partition(rows):
    out = {}
    for topic, term, cluster in rows:
        out.setdefault((topic, cluster), set()).add(term)
    return {(t, frozenset(m)) for (t, _), m in out.items()}


@pytest.mark.parametrize("finish,block", [(500, 2048), (8, 40)])
def test_equals_one_merge_after_the_other(spark, monkeypatch, finish, block):
    terms = table(spark, {"a": 70, "b": 41, "three": 3, "two": 2, "one": 1}).cache()
    want = clusters.cluster_terms(terms).toPandas().sort_values(["topic", "term"])
    monkeypatch.setattr(cluster_rounds, "FINISH", finish)
    monkeypatch.setattr(cluster_rounds, "BLOCK", block)
    got = cluster_rounds.cluster_terms(terms).toPandas().sort_values(["topic", "term"])
    assert got[["topic", "term", "cluster", "best_k"]].values.tolist() == want[["topic", "term", "cluster", "best_k"]].values.tolist()
    assert np.allclose(got["silhouette"], want["silhouette"], atol=1e-6)


def test_tree_equals_linkage(spark, monkeypatch):
    terms = table(spark, {"a": 60})
    rows = sorted((r.term, r.vec) for r in terms.collect())
    want = clusters.ward(clusters.cosine_matrix(np.array([v for _, v in rows])))
    monkeypatch.setattr(cluster_rounds, "FINISH", 7)
    monkeypatch.setattr(cluster_rounds, "BLOCK", 16)
    got = cluster_rounds.tree(cluster_rounds.points(terms)).toPandas()
    assert got["round"].max() > 1 and len(got) == 59
    assert np.allclose(np.sort(got["height"]), want[:, 2], atol=1e-6) and sorted(got["size"]) == sorted(want[:, 3].astype(int))
    got = cluster_rounds.cluster_terms(terms).first()
    assert got.cut_height == pytest.approx(0.9 * want[-(got.best_k - 1), 2])


def test_copies_zeros_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(cluster_rounds, "FINISH", 3)
    same = [("a", f"x{i}", [1.0, 0.0]) for i in range(8)] + [("a", f"y{i}", [0.0, 2.0]) for i in range(7)]
    odd = [("a", "zero", [0.0, 0.0]), ("a", None, [1.0, 1.0]), (None, "x", [1.0, 1.0]), ("a", "none", None), ("a", "x0", [9.0, 0.0]), ("c", "alone", [1.0, 1.0])]
    terms = spark.createDataFrame(same + odd, "topic string, term string, vec array<double>")
    got = cluster_rounds.cluster_terms(terms).collect()
    assert len(got) == 17 and {r.best_k for r in got if r.topic == "a"} == {3}
    assert partition((r.topic, r.term, r.cluster) for r in got) == {("a", frozenset(f"x{i}" for i in range(8))), ("a", frozenset(f"y{i}" for i in range(7))), ("a", frozenset({"zero"})), ("c", frozenset({"alone"}))}
    assert [r.cut_height for r in got if r.topic == "c"] == [None]
    assert cluster_rounds.cluster_terms(terms.limit(0)).count() == 0
