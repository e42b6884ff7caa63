"""Clusters of a topic's terms. A group is one topic's vocabulary, of at most MOST_TERMS terms (a top-k list)."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST_TERMS, MOST_CLUSTERS = 500, 30


def cosine_matrix(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    return unit @ unit.T


def ward(points: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Linkage rows (left, right, height, size) by the Lance-Williams recurrence; the first least distance merges. size: points that a point stands for (one each)."""
    n = len(points)
    size, name, alive = np.ones(n) if size is None else np.array(size, float), np.arange(n), np.ones(n, bool)
    d = np.stack([((points - p) ** 2).sum(-1) for p in points]) * (2 * size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    out = np.zeros((max(n - 1, 0), 4))
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out[step] = (*sorted((name[i], name[j])), np.sqrt(d[i, j]), size[i] + size[j])
        others = alive.copy()
        others[[i, j]] = False
        s = size[others]
        d[i, others] = ((s + size[i]) * d[i, others] + (s + size[j]) * d[j, others] - s * d[i, j]) / (s + size[i] + size[j])
        d[others, i] = d[i, others]
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        name[i], alive[j] = n + step, False
    return out


def cut_tree(linkage: np.ndarray, n: int, k: int) -> np.ndarray:
    """Cluster numbers, by first member."""
    groups = {i: [i] for i in range(n)}
    for step, (a, b, _, _) in enumerate(linkage[: n - k]):
        groups[n + step] = groups.pop(int(a)) + groups.pop(int(b))
    labels = np.zeros(n, int)
    for number, members in enumerate(sorted(groups.values(), key=min)):
        labels[members] = number
    return labels


def spectral(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means on the rows of the leading eigenvectors of the normalised affinity."""
    root = 1 / np.sqrt(np.maximum(affinity.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(root[:, None] * affinity * root[None])
    rows = vectors[:, -k:] * root[:, None]
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), 1)]
    while len(centres) < k:
        far = ((rows[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, rows[far.argmax()]])
    for _ in range(100):
        labels = ((rows[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        fresh = np.array([rows[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
        if np.allclose(fresh, centres):
            break
        centres = fresh
    return np.unique(labels, return_inverse=True)[1]


def silhouettes(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(-1), 0))
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return np.zeros(len(points))
    sums = np.stack([d[:, labels == c].sum(1) for c in kinds], 1)
    count = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    rows = np.arange(len(points))
    a = sums[rows, own] / np.maximum(count[own] - 1, 1)
    means = sums / count
    means[rows, own] = np.inf
    b = means.min(1)
    out = (b - a) / np.maximum(np.maximum(a, b), 1e-300)
    return np.where(count[own] == 1, 0.0, out)


def _cluster(pdf: pd.DataFrame, method: str) -> pd.DataFrame:
    pdf = pdf.sort_values("term").reset_index(drop=True)
    if len(pdf) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in a topic")
    matrix = cosine_matrix(np.stack([np.asarray(v, float) for v in pdf["vec"]]))
    n = len(pdf)
    tree = ward(matrix)
    make = (lambda k: cut_tree(tree, n, k)) if method == "hierarchical" else (lambda k: spectral((matrix + 1) / 2, k))
    scored = [(k, make(k)) for k in range(2, min(n, MOST_CLUSTERS))] if n >= 3 else []
    means = [silhouettes(matrix, labels).mean() for _, labels in scored]
    best_k, labels = scored[int(np.argmax(means))] if scored else (1, np.zeros(n, int))
    own = silhouettes(matrix, labels)
    return pd.DataFrame({"topic": pdf["topic"], "term": pdf["term"], "cluster": labels.astype("int32"), "silhouette": own, "best_k": np.int32(best_k), "linkage": json.dumps(tree.round(6).tolist())})


def cluster_terms(terms: DataFrame, method: str = "hierarchical") -> DataFrame:
    """topic, term, cluster, silhouette, best_k, linkage: k from 2 up with the largest mean silhouette, the first of equals. terms: topic (string), term, vec."""
    return terms.groupBy("topic").applyInPandas(lambda pdf: _cluster(pdf, method), "topic string, term string, cluster int, silhouette double, best_k int, linkage string")
