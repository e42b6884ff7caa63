import numpy as np
import pytest

from quillgraph.operators import kge, kge_counts


@pytest.mark.parametrize("kind", kge.MODELS)
@pytest.mark.parametrize("scores", [24, 1 << 18])
def test_counts_equal_brute_force_and_few_are_scored_twice(kind, scores):
    rng = np.random.default_rng(4)
    model = kge.Model(kind, 700, 3, 4, seed=2)
    e = model.p["e"]
    e[100:140], e[140] = e[7], 0  # ties
    h, r, t = rng.integers(0, 141, 200), rng.integers(0, 3, 200), rng.integers(0, 700, 200)
    h[:60], r[:60], t[:5] = 3, 1, 7  # many triples of one query
    hv, rv, tv = e[h], model.p["r"][r], e[t]
    truth = model.score(hv, rv, tv)
    for side, anchor in (("t", h), ("h", t)):
        distinct, first, place = np.unique(anchor * 3 + r, return_index=True, return_inverse=True)
        row, column = rng.integers(0, len(distinct), 900), rng.integers(0, 700, 900)
        again = []

        def exact(i, c):
            again.append(len(i))
            return model.score(hv[i], rv[i], e[c]) if side == "t" else model.score(e[c], rv[i], tv[i])  # noqa: B023

        asked = model.query(side, (hv if side == "t" else tv)[first], rv[first])
        above, equal = kge_counts.counts(model, side, asked, place, truth, exact, row, column, scores)
        every = np.stack([exact(np.full(700, i), np.arange(700)) for i in range(200)])
        for i in range(200):
            every[i, column[row == place[i]]] = -np.inf
        assert above.tolist() == (every > truth[:, None]).sum(1).tolist() and equal.tolist() == (every == truth[:, None]).sum(1).tolist()
        assert equal.max() > 5 and sum(again[:-200]) < 0.1 * every.size


def test_scores_without_bound_are_compared_exactly():
    model = kge.Model("distmult", 40, 1, 2, seed=1)
    e, rel = model.p["e"], model.p["r"]
    e[3], e[4], e[5] = np.nan, 1e200, -1e200
    hv, rv, tv = e[[0, 1]], rel[[0, 0]], e[[2, 6]]
    truth = model.score(hv, rv, tv)
    exact = lambda i, c: model.score(hv[i], rv[i], e[c])
    above, equal = kge_counts.counts(model, "t", model.query("t", hv, rv), np.arange(2), truth, exact, np.array([0, 0, 1]), np.array([4, 9, 5]), 1 << 18)
    every = np.stack([exact(np.full(40, i), np.arange(40)) for i in range(2)])
    every[[0, 0, 1], [4, 9, 5]] = -np.inf
    assert above.tolist() == (every > truth[:, None]).sum(1).tolist() and equal.tolist() == (every == truth[:, None]).sum(1).tolist()
