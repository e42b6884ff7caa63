"""Knowledge-graph embeddings: scores, gradients and updates of TransE, DistMult, ComplEx and ConvKB in numpy.

``kge_blocks`` trains and ranks graphs of any size with them. ``train`` and ``filtered_metrics`` do the same for a graph
that one process holds: the plain way that tests compare with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("transe", "distmult", "complex", "convkb")


#: The search spaces of the survey, by model: (dimension, rate, epochs, batch, weight of the squares). Fixed values.
SEARCH = {
    "transe": [(16, 0.001, 180, 128, 0.05), (24, 0.001, 180, 128, 0.05), (32, 0.001, 180, 128, 0.05)],
    "convkb": [(6, 0.002, 150, 128, 0.01), (8, 0.002, 150, 128, 0.01), (12, 0.002, 150, 128, 0.01)],
    "complex": [(16, 0.01, 180, 128, 0.025), (24, 0.015, 150, 128, 0.025), (24, 0.02, 180, 128, 0.45), (32, 0.015, 150, 128, 0.045)],
}


def configurations(models: tuple[str, ...] = MODELS, dims: tuple[int, ...] = (8, 16), rates: tuple[float, ...] = (0.1,), epochs: int = 20, **more) -> list[dict]:
    """The product of the values. more: keys that all get, such as decay, patience, every, inverse (see kge_blocks.train_all)."""
    return [{"config": i, "model": m, "dim": d, "rate": r, "epochs": epochs, **more} for i, (m, d, r) in enumerate((m, d, r) for m in models for d in dims for r in rates)]


def smart_search(model: str, **more) -> list[dict]:
    """The configurations of SEARCH for one model."""
    return [{"config": i, "model": model, "dim": d, "rate": rate, "epochs": epochs, "batch": batch, "decay": decay, **more} for i, (d, rate, epochs, batch, decay) in enumerate(SEARCH[model])]


def width_of(model: str, dim: int) -> int:
    """Numbers in an entity's vector: complex ones have a real and an imaginary half."""
    return 2 * dim if model == "complex" else dim


def start(rng: np.random.Generator, rows: int, dim: int, width: int) -> np.ndarray:
    bound = 6 / np.sqrt(dim)
    return rng.uniform(-bound, bound, (rows, width)) / 3


class Model:
    """Scores and gradients of one family; entity and relation rows hold real and imaginary halves for complex."""

    def __init__(self, kind: str, entities: int, relations: int, dim: int, seed: int = 0, filters: int = 3) -> None:
        rng = np.random.default_rng(seed)
        width = width_of(kind, dim)
        self.kind, self.dim = kind, dim
        self.p = {"e": start(rng, entities, dim, width), "r": start(rng, relations, dim, width)}
        if kind == "convkb":
            self.p["f"] = rng.normal(0, 0.3, (filters, 3))
            self.p["w"] = rng.normal(0, 0.3, (filters, dim))
        self.square = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}

    def score(self, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Vectors in, higher is truer."""
        if self.kind == "transe":
            return -np.abs(h + r - t).sum(-1)
        if self.kind == "distmult":
            return (h * r * t).sum(-1)
        if self.kind == "complex":
            d = self.dim
            a, b, c, e, f, g = h[..., :d], h[..., d:], r[..., :d], r[..., d:], t[..., :d], t[..., d:]
            return (a * c * f + b * c * g + a * e * g - b * e * f).sum(-1)
        z = self._conv(h, r, t)
        return (np.maximum(z, 0) * self.p["w"]).sum((-1, -2))

    def _conv(self, h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        f = self.p["f"]
        return f[:, 0, None] * h[..., None, :] + f[:, 1, None] * r[..., None, :] + f[:, 2, None] * t[..., None, :]

    def step(self, h: np.ndarray, r: np.ndarray, t: np.ndarray, slope: np.ndarray, rate: float, decay: float = 0.0) -> None:
        """One adaptive step down: slope is the loss by the score of each triple (ids). decay pulls touched rows to zero."""
        eh, er, et = self.p["e"][h], self.p["r"][r], self.p["e"][t]
        s = slope[:, None]
        if self.kind == "transe":
            sign = np.sign(eh + er - et)
            gh, gr, gt = -s * sign, -s * sign, s * sign
        elif self.kind == "distmult":
            gh, gr, gt = s * er * et, s * eh * et, s * eh * er
        elif self.kind == "complex":
            d = self.dim
            a, b, c, e, f, g = eh[:, :d], eh[:, d:], er[:, :d], er[:, d:], et[:, :d], et[:, d:]
            gh = s * np.hstack([c * f + e * g, c * g - e * f])
            gr = s * np.hstack([a * f + b * g, a * g - b * f])
            gt = s * np.hstack([a * c - b * e, b * c + a * e])
        else:
            z = self._conv(eh, er, et)
            on = (z > 0) * self.p["w"] * slope[:, None, None]
            filters = self.p["f"]
            gh, gr, gt = ((on * filters[:, i, None]).sum(1) for i in range(3))
            self._apply("f", np.stack([(on * x[:, None, :]).sum((0, 2)) for x in (eh, er, et)], 1), rate)
            self._apply("w", (np.maximum(z, 0) * slope[:, None, None]).sum(0), rate)
        for name, ids, grad in (("e", np.concatenate([h, t]), np.vstack([gh, gt])), ("r", r, gr)):
            rows, place = np.unique(ids, return_inverse=True)  # only rows that occur are touched, whatever the table's size
            total = np.zeros((len(rows), grad.shape[1]))
            np.add.at(total, place, grad)
            self._apply(name, total + decay * self.p[name][rows] if decay else total, rate, rows)

    def _apply(self, name: str, grad: np.ndarray, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
        self.square[name][rows] += grad**2
        self.p[name][rows] -= rate * grad / np.sqrt(self.square[name][rows])

    def query(self, side: str, anchor: np.ndarray, r: np.ndarray) -> np.ndarray:
        """What the anchors (heads for side t, tails for side h) and relations come to before a candidate is known: one row each."""
        d = self.dim
        if self.kind == "transe":
            return anchor + r if side == "t" else anchor - r
        if self.kind == "distmult":
            return anchor * r
        if self.kind == "complex":
            a, b, c, e = anchor[:, :d], anchor[:, d:], r[:, :d], r[:, d:]
            return np.hstack([a * c - b * e, b * c + a * e]) if side == "t" else np.hstack([a * c + b * e, b * c - a * e])
        f = self.p["f"]
        return np.hstack([f[i, 0 if side == "t" else 2] * anchor + f[i, 1] * r for i in range(len(f))])

    def against(self, side: str, q: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Scores of all candidates for each query, a block at a time."""
        if self.kind in ("distmult", "complex"):
            return q @ candidates.T
        out = np.zeros((len(q), len(candidates)))
        part = np.empty_like(out)
        if self.kind == "transe":
            for i in range(self.dim):
                np.subtract(q[:, i, None], candidates[None, :, i], out=part)
                out -= np.abs(part, out=part)
            return out
        for i in range(len(self.p["f"])):
            last = candidates * self.p["f"][i, 2 if side == "t" else 0]
            for j in range(self.dim):
                np.add(q[:, i * self.dim + j, None], last[None, :, j], out=part)
                np.maximum(part, 0, out=part)
                part *= self.p["w"][i, j]
                out += part
        return out

    def epoch(self, triples: np.ndarray, share: np.ndarray, low: np.ndarray, size: np.ndarray, rate: float, rng: np.random.Generator, batch: int = 512, decay: float = 0.0) -> float:
        """Logistic loss on each triple and one with a replaced end; which end goes by the relation's fan-out (Bernoulli). low, size: for each entity the range that its stand-in is drawn from. Gives the summed loss."""
        order, total = rng.permutation(len(triples)), 0.0
        for at in range(0, len(order), batch):
            h, r, t = triples[order[at : at + batch]].T
            swap = rng.random(len(h)) < share[r]
            end = np.where(swap, h, t)
            other = low[end] + rng.integers(0, size[end], len(h))
            h2, t2 = np.where(swap, other, h), np.where(swap, t, other)
            e, rel = self.p["e"], self.p["r"]
            good, bad = self.score(e[h], rel[r], e[t]), self.score(e[h2], rel[r], e[t2])
            total += float(np.logaddexp(0, -good).sum() + np.logaddexp(0, bad).sum())
            slope = np.concatenate([-1 / (1 + np.exp(np.clip(good, -50, 50))), 1 / (1 + np.exp(-np.clip(bad, -50, 50)))])
            self.step(np.concatenate([h, h2]), np.concatenate([r, r]), np.concatenate([t, t2]), slope, rate, decay)
        return total


def train(triples: np.ndarray, entities: int, relations: int, config: dict, seed: int = 0, batch: int = 512) -> tuple[Model, list[float]]:
    """The whole graph in one process."""
    rng = np.random.default_rng(seed)
    model = Model(config["model"], entities, relations, config["dim"], seed)
    low, size = np.zeros(entities, np.int64), np.full(entities, entities)
    losses = [model.epoch(triples, fan_out(triples, relations), low, size, config["rate"], rng, batch) / max(1, 2 * len(triples)) for _ in range(config["epochs"])]
    return model, losses


def fan_out(triples: np.ndarray, relations: int) -> np.ndarray:
    """For each relation the chance that the head is replaced."""
    heads = np.array([len(np.unique(triples[triples[:, 1] == r, 0])) for r in range(relations)])
    tails = np.array([len(np.unique(triples[triples[:, 1] == r, 2])) for r in range(relations)])
    return tails / np.maximum(heads + tails, 1)


def filtered_metrics(model: Model, test: np.ndarray, known: np.ndarray) -> dict[str, float]:
    """MRR and hits of both ends; known true candidates other than the asked one don't count, equals share their places."""
    truth: dict[tuple, set[int]] = {}
    for h, r, t in known:
        truth.setdefault(("t", h, r), set()).add(t)
        truth.setdefault(("h", r, t), set()).add(h)
    e, rel, ranks = model.p["e"], model.p["r"], []
    for h, r, t in test:
        for side, own, scores in (("t", t, model.score(e[h][None], rel[r][None], e)), ("h", h, model.score(e, rel[r][None], e[t][None]))):
            skip = truth.get((side, h, r) if side == "t" else (side, r, t), set()) - {own}
            scores = scores.copy()
            scores[list(skip)] = -np.inf
            ranks.append(1 + (scores > scores[own]).sum() + ((scores == scores[own]).sum() - 1) / 2)
    ranks = np.array(ranks, float)
    if not len(ranks):
        return {"mrr": 0.0, "hits1": 0.0, "hits10": 0.0}
    return {"mrr": float((1 / ranks).mean()), "hits1": float((ranks <= 1).mean()), "hits10": float((ranks <= 10).mean())}


def best_by(results: DataFrame, measure: str) -> DataFrame:
    """The first configuration with the largest measure."""
    return results.orderBy(F.desc(measure), "config").limit(1)
