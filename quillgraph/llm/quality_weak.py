"""Quality rules with weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. Expectation-maximisation estimates, from
the counts of vote patterns over all documents and without labels, how often each rule is right on good and on bad
documents; the posterior probability of quality is then a sum of each vote's log-odds. Patterns number at most
3 ^ rules (a fixed bound), so only those counts come to the driver, and no document does.

Defined cases: null and empty text have no words and fail the base rule, as any text of fewer words than 50 does;
a tie of the odds keeps the document; without any document the accuracies stay at their start; repeated rows count as
often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .common import table, texts_as_bytes

LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_shouts", "n_ends")


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more, and distinct words."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    n, size = len(ids), len(index)
    if n < 4:
        return 0, size
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three ids no longer fit one number
        pairs = np.unique(pairs, return_inverse=True)[1]
    key = pairs[:-1] * size + ids[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, size
    at = np.searchsorted(twice, key)
    again = twice[np.minimum(at, len(twice) - 1)] == key
    mark = np.zeros(n, bool)
    for i in range(3):
        mark[i : n - 2 + i] |= again
    return int(mark.sum()), size


def statistics(raw: bytes) -> tuple[int, ...]:
    """The values named in STATISTICS."""
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats, distinct = repeat_words(words)
    upper, lower = (len(joined) - len(joined.translate(None, c)) for c in (_UPPER, _LOWER))
    return (
        len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), distinct,
        upper, upper + lower, len(joined) - len(joined.translate(None, _DIGITS)), raw.count(b"!"), raw.count(b".") + raw.count(b"?") + raw.count(b"!"),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(raw) for raw in texts_as_bytes(batch)], np.int64).reshape(len(batch), len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in rows.T]], names=["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """Statistics of each row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 no opinion. Thresholds are shares of words, lines or letters."""
    c = F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    w, chars, never = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1)), F.lit(False)
    return {
        "length": vote(c("n_words") < 20, never),
        "symbols_by_word": vote(c("n_symbols") * 10 > w, c("n_symbols") * 100 <= w),
        "symbols_by_size": vote(c("n_symbols") * 30 > chars, c("n_symbols") * 400 <= chars),
        "capitals": vote(c("n_upper") * 10 > c("n_letters") * 4, never),
        "repeats": vote(c("n_repeat_words") * 10 > w * 4, c("n_repeat_words") * 20 <= w),
        "lines": vote(c("n_dup_lines") * 2 > c("n_lines"), never),
        "word_size": vote((c("word_chars") < 2 * w) | (c("word_chars") > 14 * w), never),
        "variety": vote(c("n_distinct") * 10 < w, never),
        "digits": vote(c("n_digits") * 5 > chars, never),
        "shouting": vote(c("n_shouts") * 5 > w, never),
        "sentences": vote(c("n_ends") * 100 < w, (c("n_ends") * 50 >= w) & (c("n_ends") * 4 <= w)),
    }


class LabelModel:
    """Prior of quality, and for each rule how often it votes bad or good on bad and on good documents.

    ``rates[class, vote, rule]``: class 0 bad, 1 good; vote 0 for -1, 1 for 1. A rule's accuracy on a class is its
    right votes as a share of its votes. What it doesn't vote on it says nothing about.
    """

    #: Rates before there are data: a vote for bad is rare on good documents, a vote for good common on either.
    START = np.array([[[0.2], [0.3]], [[0.01], [0.6]]])

    def __init__(self, n: int, prior: float = 0.8) -> None:
        self.prior, self.rates = prior, np.repeat(self.START, n, axis=2)

    @property
    def accuracy(self) -> np.ndarray:
        """(class, rule): right votes among votes."""
        return self.rates[[0, 1], [0, 1]] / self.rates.sum(axis=1)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of a vote for bad (never above 0) and for good (never below)."""
        ratio = np.log(self.rates[1] / self.rates[0])
        return np.minimum(ratio[0], 0), np.maximum(ratio[1], 0)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        down, up = self.weights()
        return np.log(self.prior / (1 - self.prior)) + (votes == -1) @ down + (votes == 1) @ up

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 200, pseudo: float = 5.0) -> LabelModel:
        """EM over vote patterns and their counts. A vote never counts against its own side, which fixes which class is which."""
        votes, counts = votes.reshape(-1, self.rates.shape[2]), counts.astype(float)
        if not counts.sum():
            return self
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -500, 500)))
            before = self.rates.copy()
            self.prior = float(np.clip((counts @ q) / counts.sum(), 0.05, 0.95))
            for i, mass in enumerate((counts * (1 - q), counts * q)):
                for k, vote in enumerate((-1, 1)):
                    self.rates[i, k] = (mass @ (votes == vote) + pseudo * self.START[i, k]) / (mass.sum() + pseudo)
            if np.abs(self.rates - before).max() < 1e-9:
                break
        return self


def judge(measured: DataFrame) -> tuple[DataFrame, LabelModel]:
    """measured with base_failed, posterior and kept, and the fitted model."""
    votes = rules()
    voted = measured.select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    patterns = voted.groupBy(*names).count().collect()  # at most 3 ^ rules rows
    patterns = sorted(tuple(r) for r in patterns)
    seen = np.array([p[:-1] for p in patterns], np.int64).reshape(-1, len(names))
    model = LabelModel(len(names)).fit(seen, np.array([p[-1] for p in patterns]))
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for name, down, up in zip(names, *model.weights(), strict=True):
        odds = odds + F.when(F.col(name) == 1, float(up)).when(F.col(name) == -1, float(down)).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("log_odds", odds)
    out = out.withColumn("posterior", F.round(1 / (1 + F.exp(-F.col("log_odds"))), 6))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("log_odds") >= 0)), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row per document."""
    judged, _ = judge(stored(measure(table(spark, sf_dir, "documents", "doc_id", "text"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


ORACLE_SQL = None
