import numpy as np
from test_cluster_rounds import partition, table

from quillgraph.operators import cluster_rounds, clusters, spectral_rounds


def test_equals_the_whole_matrix(spark, monkeypatch):
    terms = table(spark, {"a": 48, "b": 30, "two": 2, "one": 1}, width=40).cache()
    want = clusters.cluster_terms(terms, "spectral").toPandas().sort_values(["topic", "term"])
    monkeypatch.setattr(cluster_rounds, "BLOCK", 20)
    monkeypatch.setattr(spectral_rounds, "FINISH", 40)  # a by blocks, the others in one task
    got = spectral_rounds.cluster_terms(terms).toPandas().sort_values(["topic", "term"])
    same = lambda t: partition(t[["topic", "term", "cluster"]].values.tolist())
    assert same(got) == same(want) and np.allclose(got["silhouette"], want["silhouette"], atol=1e-6)
    assert got.groupby("topic")["cluster"].nunique().to_dict() == got.groupby("topic")["best_k"].first().to_dict()
    assert spectral_rounds.cluster_terms(terms.limit(0)).count() == 0
    few = terms.where("topic in ('two', 'one')")
    assert sorted((r.topic, r.cluster, r.best_k) for r in spectral_rounds.by_blocks(few).collect()) == [("one", 0, 1), ("two", 0, 1), ("two", 0, 1)]
    assert spectral_rounds.by_blocks(terms.limit(0)).count() == 0
