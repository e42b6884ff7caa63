"""Counts of the candidates that score above a triple, and level with it.

Candidates are scored in single precision, a stretch of them at a time in a buffer that stays in the cache. A score that is off the
triple's own by more than single precision can be wrong is settled by that; the few others are scored again as the model scores a triple,
in double precision, so counts are those of comparing every candidate exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .kge import Model

#: Queries of a buffer and of one step over it, triples of a query from which on sorting is cheaper, pairs that are scored again at a time.
ROWS, AT_ONCE, MANY, AGAIN = 8, 2, 32, 1 << 14
#: The largest relative error of one rounding, and sums beyond which single precision isn't used.
UNIT, LARGEST = 2.0**-24, 1e30


def _parts(model: Model, side: str, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """a (a row a query), b (a row a candidate) and signs: a score is a b', or with signs the sum of sign |a + b|, to which ConvKB adds all of a and b."""
    e = model.p["e"]
    if model.kind in ("distmult", "complex"):
        return asked, e, None
    if model.kind == "transe":
        return -asked, e, -np.ones(model.dim)
    f, half = model.p["f"], model.p["w"].ravel() / 2  # w max(x, 0) is x w / 2 and |x w / 2| with the sign of w
    return asked * half, np.hstack([e * x for x in f[:, 2 if side == "t" else 0]]) * half, np.where(half < 0, -1.0, 1.0)


def _score(a: np.ndarray, b: np.ndarray, base: np.ndarray, signs: np.ndarray | None, out: np.ndarray, part: np.ndarray) -> None:
    if signs is None:
        np.matmul(a, b, out=out)
        return
    for low in range(0, len(a), len(part)):
        own, rows = a[low : low + len(part)], out[low : low + len(part)]
        parts = part[: len(own)]
        rows[:] = base
        for j, sign in enumerate(signs):
            np.add(b[j], own[:, j, None], out=parts)
            np.abs(parts, out=parts)
            (np.add if sign > 0 else np.subtract)(rows, parts, out=rows)


def counts(model: Model, side: str, asked: np.ndarray, place: np.ndarray, truth: np.ndarray, exact: Callable, row: np.ndarray, column: np.ndarray, scores: int) -> tuple[np.ndarray, np.ndarray]:
    """above and equal of each triple. asked: queries, as the model makes them; place: each triple's query; truth: its own score; exact(i, c): scores of the triples i
    with the candidates c in their place; row, column: queries and the candidates that are left out of them; scores: numbers in the buffer."""
    above, equal = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    n = len(model.p["e"])
    if not n or not len(place):
        return above, equal
    again: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if again:
            i, c = (np.concatenate(x) for x in zip(*again, strict=True))
            for at in range(0, len(i), AGAIN):
                own, found = i[at : at + AGAIN], exact(i[at : at + AGAIN], c[at : at + AGAIN])
                np.add.at(above, own[found > truth[own]], 1)
                np.add.at(equal, own[found == truth[own]], 1)
            again.clear()

    with np.errstate(over="ignore", invalid="ignore"):
        a, b, signs = _parts(model, side, asked)
        whole = model.kind == "convkb"
        size = np.abs(a) @ np.abs(b).max(0) if signs is None else 2 * (np.abs(a).sum(1) + np.abs(b).max(0).sum())
        shift = a.sum(1)[place] if whole else 0.0
        size = size[place] + np.abs(truth) + np.abs(shift)
        margin = np.where(size < LARGEST, 4 * (a.shape[1] + 8) * UNIT * size + 1e-36, np.inf)
        low, high = ((truth - shift + x).astype(np.float32) for x in (-margin, margin))
        base = b.sum(1).astype(np.float32) if whole else np.zeros(n, np.float32)
        a, b = a.astype(np.float32), np.ascontiguousarray(b.T.astype(np.float32))
        by_place = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[by_place], np.arange(len(asked) + 1))
        by_row = np.lexsort((column, row))
        out_of, outs = row[by_row] * n + column[by_row], column[by_row]
        held = 0
        step = max(1, scores // ROWS)
        for left in range(0, n, step):
            tile = np.ascontiguousarray(b[:, left : left + step])
            width = tile.shape[1]
            buffer, part = np.empty((ROWS, width), np.float32), np.empty((AT_ONCE, width), np.float32)
            starts, stops = (np.searchsorted(out_of, np.arange(len(asked)) * n + x) for x in (left, left + width))
            for at in range(0, len(asked), ROWS):
                rough = buffer[: len(a[at : at + ROWS])]
                _score(a[at : at + ROWS], tile, base[left : left + width], signs, rough, part)
                for i, s in enumerate(rough, at):
                    hidden = outs[starts[i] : stops[i]] - left
                    s[hidden] = -np.inf
                    mine = by_place[ends[i] : ends[i + 1]]
                    if len(mine) >= MANY and np.isfinite(low[mine]).all():
                        ordered = np.sort(s)
                        up, under = width - np.searchsorted(ordered, high[mine], "right"), np.searchsorted(ordered, low[mine], "left")
                    else:
                        up = np.array([np.count_nonzero(s > high[k]) for k in mine])
                        under = np.array([np.count_nonzero(s < low[k]) for k in mine])
                    above[mine] += up
                    for k in mine[up + under < width]:
                        near = np.flatnonzero(~((s > high[k]) | (s < low[k])))
                        if not np.isfinite(low[k]):
                            near = np.setdiff1d(near, hidden)
                        again.append((np.full(len(near), k), near + left))
                        held += len(near)
                if held > AGAIN:
                    settle()
                    held = 0
    settle()
    return above, equal
