import numpy as np
import pytest

from quillgraph.operators import similar


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = [(f"g{i % 2}", f"t{i:03d}", [float(x) for x in centres[i % 40] + rng.normal(size=16) * 0.15]) for i in range(400)]
    vectors += [("g0", "same1", vectors[0][2]), ("g0", "same2", vectors[0][2]), ("g1", "zero", [0.0] * 16), ("alone", "x", [1.0] * 16), (None, "n", [1.0] * 16), ("g0", "none", None), ("g0", "t000", vectors[0][2])]
    return spark.createDataFrame(vectors, "grp string, key string, vec array<double>").cache()


def brute(rows, n):
    own = {(r.grp, r.key): np.array(r.vec) for r in rows.collect() if r.grp and r.vec}
    out = set()
    for (g, k), v in own.items():
        size = lambda x: np.linalg.norm(x) or 1.0
        near = sorted(((-round(float(v @ w / size(v) / size(w)), 9), o) for (h, o), w in own.items() if h == g and o != k))
        out |= {(g, k, o, i + 1) for i, (_, o) in enumerate(near[:n])}
    return out


def test_blocks_equal_brute_force(rows, monkeypatch):
    want = brute(rows, 4)
    for block in (7, 64, 5000):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = {(r.grp, r.key, r.other, r.place) for r in similar.within(rows, ["grp"], 4).collect()}
        assert got == want, block
    assert similar.within(rows.limit(0), ["grp"], 4).count() == 0


def test_index_finds_most(rows):
    exact = similar.within(rows, ["grp"], 4)
    found = similar.indexed(rows, "grp", 4, bits=3)
    assert similar.recall(found, exact, "grp") >= 0.9
    assert similar.recall(similar.indexed(rows, "grp", 4), exact, "grp") == 1 and similar.indexed(rows.limit(0), "grp", 4).count() == 0
