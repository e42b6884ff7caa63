"""Logistic context mixing over bytes, in numpy.

A text is coded byte by byte, eight binary decisions each, and ends with a byte that UTF-8 never uses. For each
decision, one predictor for every context length from 0 to ORDERS - 1 bytes looks up hashed counts of zeros and ones.
Their log-odds are mixed with weights that a gate selects (the longest context seen before, and how often), learned
online, and the result is refined by an adaptive probability map of observed frequencies.

All of it depends on the last bytes only, so distinct grams (context and next byte) are evaluated once with a count.

Counts are exact and lie in parts (``Exact``, ``PartMixer``), which grow with the corpus. ``Mixer`` and ``Scorer`` by
themselves hold hashed counts of a fixed size: they serve a few texts in memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

ORDERS = 6
#: Bytes of a gram: the longest context and the byte that follows.
GRAM = ORDERS
SLOT_BITS = 18
SLOTS = ORDERS << SLOT_BITS
END, PAD = b"\xff", b"\0" * (GRAM - 1)
CHUNK = 2 << 20
#: Grams whose cost a scorer keeps, and texts of a piece (their number shares a word with the gram).
KNOWN, MOST_TEXTS = 1_500_000, 1 << 16
LEVELS = (1, 4, 32)
GATES = ORDERS * len(LEVELS)
BUCKETS, REACH = 33, 8.0
CELLS = GATES * 8 * BUCKETS
#: The gate before the first one of each order.
_BEFORE = np.arange(ORDERS, dtype=np.int8)[:, None] * np.int8(len(LEVELS)) - np.int8(1)
_PRIOR = 0.4
_LEAST = 2.0**-20


def windows(docs: Iterable[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, number of the text each belongs to), in pieces of about ``chunk`` bytes; long texts are cut with their context."""
    parts: list[bytes] = []
    owners: list[int] = []
    total = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) - GRAM + 1 for p in parts])
        keys = np.zeros(len(raw) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            keys <<= np.uint64(8)
            keys |= raw[i : len(raw) - GRAM + 1 + i]
        valid = np.ones(len(keys), bool)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        for i in range(1, GRAM):
            valid[ends - i] = False
        return keys[valid], np.repeat(np.array(owners), sizes)

    for number, text in enumerate(docs):
        padded = PAD + text + END
        for start in range(0, len(text) + 1, chunk):
            parts.append(padded[start : start + chunk + GRAM - 1])
            owners.append(number)
            total += len(parts[-1])
            if total >= chunk:
                yield flush()
                parts, owners, total = [], [], 0
    if parts:
        yield flush()


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their counts."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def slots(keys: np.ndarray, turn: int) -> np.ndarray:
    """(ORDERS, n): each predictor's slot for the decision after ``turn`` bits of the byte."""
    node = (np.uint64(1) << np.uint64(turn)) | ((keys & np.uint64(255)) >> np.uint64(8 - turn))
    out = np.empty((ORDERS, len(keys)), np.int64)
    for order in range(ORDERS):
        context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
        h = (context << np.uint64(8)) | node
        if order > 1:
            h = h * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)
        out[order] = h.astype(np.int64) + (order << SLOT_BITS)
    return out


def bit_of(keys: np.ndarray, turn: int) -> np.ndarray:
    return ((keys >> np.uint64(7 - turn)) & np.uint64(1)).astype(np.int64)


def add_counts(table: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
    """Adds grams to table (2, SLOTS): zeros and ones of each slot."""
    flat = table.reshape(-1)
    for turn in range(8):
        at = slots(keys, turn) + bit_of(keys, turn) * SLOTS
        for row in at:
            np.add.at(flat, row, n)


class Mixer:
    """Counts, gate weights and the adaptive map."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.zeros, self.ones = zeros.astype(np.float32), ones.astype(np.float32)
        self.weights = np.full((GATES, ORDERS + 1), 0.3)
        self.weights[:, -1] = 0.0
        self.hits, self.seen = np.zeros(CELLS), np.zeros(CELLS)

    def counts(self, keys: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones that each predictor has counted, (ORDERS, n) both."""
        at = slots(keys, turn)
        return self.zeros[at], self.ones[at]

    def inputs(self, keys: np.ndarray, turn: int, without_own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each predictor (and a constant), and the gate. without_own: as if one occurrence had not been counted."""
        zero, one = self.counts(keys, turn)
        if without_own:
            bit = bit_of(keys, turn)
            zero, one = np.maximum(zero - (1 - bit), 0), np.maximum(one - bit, 0)
        x = np.ones((ORDERS + 1, len(keys)), np.float32)
        np.clip(np.log((one + _PRIOR) / (zero + _PRIOR)), -REACH, REACH, out=x[:-1])
        total = zero + one
        level = sum((total >= least).view(np.int8) for least in LEVELS)
        gate = ((level + _BEFORE) * (level > 0)).max(axis=0).astype(np.int64)  # of the longest context seen
        return x, gate

    def logit(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ji->i", self.weights[gate], x)

    def cells(self, z: np.ndarray, gate: np.ndarray, turn: int) -> np.ndarray:
        bucket = np.rint((np.clip(z, -REACH, REACH) + REACH) * ((BUCKETS - 1) / (2 * REACH))).astype(np.int64)
        return (gate * 8 + turn) * BUCKETS + bucket

    def learn(self, keys: np.ndarray, n: np.ndarray, rate: float = 0.05) -> None:
        """One online step for each of the eight decisions."""
        for turn in range(8):
            x, gate = self.inputs(keys, turn, True)
            error = n * (bit_of(keys, turn) - 1 / (1 + np.exp(-self.logit(x, gate))))
            slope = np.stack([np.bincount(gate, row, GATES) for row in error * x], axis=1)
            mass = np.bincount(gate, n, GATES)[:, None]
            self.weights += rate * slope / np.maximum(mass, 1)

    def observe(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Adds what followed to the adaptive map."""
        for turn in range(8):
            x, gate = self.inputs(keys, turn, True)
            cell = self.cells(self.logit(x, gate), gate, turn)
            self.seen += np.bincount(cell, n, CELLS)
            self.hits += np.bincount(cell, n * bit_of(keys, turn), CELLS)

    def compact(self) -> Scorer:
        return Scorer(self)


def refined(hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The adaptive map: observed frequencies, drawn to the middle of their bucket."""
    centre = np.tile(np.linspace(-REACH, REACH, BUCKETS), GATES * 8)
    return (hits + 20 / (1 + np.exp(-centre))) / (seen + 20)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a gram: all grams with the same last two bytes of context share one."""
    near = (keys >> np.uint64(8)).astype(np.int64) & 0xFFFF
    return ((near * 40503 & 0xFFFF) * parts) >> 16


class Exact:
    """Counts without hashing, from all grams of a part with their counts (0: only asked for).

    Contexts of two bytes and more lie within a part; ``low`` counts grams of one byte of context in the whole corpus.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, low: np.ndarray) -> None:
        self.orders = []
        for order in range(ORDERS):
            own = keys & np.uint64((1 << 8 * (order + 1)) - 1)
            if order < 2:
                self.orders.append((np.arange(256 ** (order + 1)), low if order else low.reshape(256, 256).sum(axis=0), own.astype(np.int64)))
            else:
                grams, at = np.unique(own, return_inverse=True)
                self.orders.append((grams.astype(np.int64), np.bincount(at, n, len(grams)), at))

    def counts(self, turn: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones of the decision after ``turn`` bits for the grams in these rows, (ORDERS, n) both."""
        zero, one = np.empty((ORDERS, len(rows)), np.float32), np.empty((ORDERS, len(rows)), np.float32)
        for order, (grams, n, at) in enumerate(self.orders):
            node = grams >> (8 - turn)
            group = np.cumsum(np.concatenate(([0], node[1:] != node[:-1])))
            bit = (grams >> (7 - turn)) & 1
            mine = group[at[rows]]
            zero[order], one[order] = np.bincount(group, n * (1 - bit))[mine], np.bincount(group, n * bit)[mine]
        return zero, one


class PartMixer(Mixer):
    """A mixer over one part's exact counts; rows are taken in blocks, so that few counts are spread out at a time."""

    BLOCK, STEP = 1 << 17, 1 << 12

    def __init__(self, weights: np.ndarray, exact: Exact) -> None:
        self.weights, self.exact = weights.copy(), exact
        self.hits, self.seen = np.zeros(CELLS), np.zeros(CELLS)

    def steps(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """The rows in pieces of STEP, each ready for inputs()."""
        for low in range(0, len(rows), self.BLOCK):
            block = rows[low : low + self.BLOCK]
            turns = [self.exact.counts(turn, block) for turn in range(8)]
            for start in range(0, len(block), self.STEP):
                self.turns = [(z[:, start : start + self.STEP], o[:, start : start + self.STEP]) for z, o in turns]
                yield block[start : start + self.STEP]

    def counts(self, keys: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        return self.turns[turn]

    def cost(self, keys: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte, by the adaptive map ``curve``."""
        out = np.zeros(len(keys))
        for rows in self.steps(np.arange(len(keys))):
            own = keys[rows]
            for turn in range(8):
                x, gate = self.inputs(own, turn)
                z = self.logit(x, gate)
                p = np.clip((1 / (1 + np.exp(-z)) + curve[self.cells(z, gate, turn)]) / 2, _LEAST, 1 - _LEAST)
                out[rows] -= np.log2(np.where(bit_of(own, turn) == 1, p, 1 - p))
        return out


class Scorer(Mixer):
    """What scoring needs, smaller: log-odds and gate level of each slot."""

    def __init__(self, mixer: Mixer) -> None:
        self.odds = np.clip(np.log((mixer.ones + _PRIOR) / (mixer.zeros + _PRIOR)), -REACH, REACH).astype(np.float32)
        self.level = np.searchsorted(LEVELS, mixer.zeros + mixer.ones, side="right").astype(np.int8)
        self.weights = mixer.weights
        self.known, self.cost = np.empty(0, np.uint64), np.empty(0)
        self.refined = refined(mixer.hits, mixer.seen)

    def inputs(self, keys: np.ndarray, turn: int, without_own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        at = slots(keys, turn)
        x = np.ones((ORDERS + 1, len(keys)), np.float32)
        x[:-1] = self.odds[at]
        level = self.level[at]
        gate = np.zeros(len(keys), np.int64)
        for order in range(ORDERS):
            gate = np.where(level[order] > 0, order * len(LEVELS) + level[order] - 1, gate)
        return x, gate

    def one(self, keys: np.ndarray, turn: int) -> np.ndarray:
        """Probability that the next bit is 1."""
        x, gate = self.inputs(keys, turn)
        z = self.logit(x, gate)
        p = (1 / (1 + np.exp(-z)) + self.refined[self.cells(z, gate, turn)]) / 2
        return np.clip(p, _LEAST, 1 - _LEAST)

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Cost of each gram's last byte after the others."""
        out = np.zeros(len(keys))
        for low in range(0, len(keys), 1 << 16):
            part = keys[low : low + (1 << 16)]
            for turn in range(8):
                p = self.one(part, turn)
                out[low : low + len(part)] -= np.log2(np.where(bit_of(part, turn) == 1, p, 1 - p))
        return out

    def known_bits(self, keys: np.ndarray) -> np.ndarray:
        """As bits() for sorted distinct grams, most of which have been seen before."""
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        out = np.empty(len(keys))
        fresh = self.known[at] != keys if len(self.known) else np.ones(len(keys), bool)
        if not fresh.all():
            out[~fresh] = self.cost[at[~fresh]]
        if fresh.any():
            out[fresh] = self.bits(keys[fresh])
            if len(self.known) + fresh.sum() > KNOWN:
                self.known, self.cost = keys, out.copy()
            else:
                merged = np.concatenate([self.known, keys[fresh]])
                order = np.argsort(merged, kind="stable")
                self.known, self.cost = merged[order], np.concatenate([self.cost, out[fresh]])[order]
        return out

    def text_bits(self, docs: list[bytes]) -> np.ndarray:
        """Bits of each text with its end."""
        out = np.zeros(len(docs))
        for low in range(0, len(docs), MOST_TEXTS):
            part = docs[low : low + MOST_TEXTS]
            for keys, owner in windows(part):
                both = (keys << np.uint64(16)) | owner.astype(np.uint64)  # a gram has 48 bits
                both.sort()
                keys = both >> np.uint64(16)
                first = np.concatenate(([True], keys[1:] != keys[:-1]))
                cost = self.known_bits(keys[first])[np.cumsum(first) - 1]
                out[low : low + len(part)] += np.bincount((both & np.uint64(MOST_TEXTS - 1)).astype(np.int64), cost, len(part))
        return out
