"""Language ID by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (one to three letters, words padded by a blank) of a language in
order. A document's own list is compared with each profile by the out-of-place distance: how far each n-gram lies
from its place there, or the length of the profile if it isn't there. The nearest language wins; at equal distance
the one whose name comes first.

Profiles are counted on the executors over all rows that may be learned from, and only the top ranks of each language
come to the driver. Texts are worked on in pieces of a thousand rows or a few megabytes, long ones whole.

Defined cases: text that is null or without letters is ``und`` with score 0, and so is every text if there is nothing
to learn from; rows with null lang are not learned from; repeated rows count as often as they occur; an empty table
gives an empty one. ``identify`` keeps all columns, and those named as its results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, fields_with, fresh, held, short_batches, slices, table, texts, with_columns

#: Ranks of a profile and of a document's list; letters of the longest n-gram.
RANKS, LONGEST = 400, 3
#: Distinct n-grams that a task holds.
HELD = 1_000_000
UNKNOWN = "und"
SPACE = 32
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """Letters in lower case, and one blank at either end and for each run of others; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    codes = np.where(is_letter, codes, SPACE).astype(np.uint64)
    codes = np.concatenate(([SPACE], codes, [SPACE])).astype(np.uint64)
    blank = codes == SPACE
    return codes[~(blank & np.concatenate(([False], blank[:-1])))]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Keys of the n-grams, 21 bits a letter; no blank within one, nor a blank alone."""
    blank = codes == SPACE
    out = [codes[~blank]]
    two = (codes[:-1] << np.uint64(21)) | codes[1:]
    out.append(two)
    if len(codes) > 2:
        out.append(((two[:-1] << np.uint64(21)) | codes[2:])[~blank[1:-1]])
    return np.concatenate(out)


def ranked(keys: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent keys, equal counts by key."""
    found, count = np.unique(keys, return_counts=True)
    if len(found) > ranks:
        least = np.partition(count, len(count) - ranks)[len(count) - ranks]
        chosen = count >= least
        found, count = found[chosen], count[chosen]
    return found[np.lexsort((found, -count))][:ranks]


class Profiles:
    """Places of the n-grams in each language's list."""

    def __init__(self, lists: dict[str, list[int]]) -> None:
        self.languages = sorted(lists)
        self.keys = np.unique(np.array([k for own in lists.values() for k in own], np.uint64))
        self.places = np.full((len(self.languages), len(self.keys)), -1, np.int64)
        for i, language in enumerate(self.languages):
            self.places[i, np.searchsorted(self.keys, np.array(lists[language], np.uint64))] = np.arange(len(lists[language]))

    def predict(self, text: str, ranks: int = RANKS) -> tuple[str, float]:
        """Language, and one minus its distance as a share of the largest possible."""
        codes = code_points(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(ngrams(codes), ranks)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[at] == own
        places = self.places[:, at]
        far = np.where(known & (places >= 0), np.minimum(np.abs(places - np.arange(len(own))), ranks), ranks).sum(axis=1)
        best = int(far.argmin())
        return self.languages[best], 1.0 - float(far[best]) / (ranks * len(own))


def weighted_ngrams(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of words without white space, and their counts. n-grams never cross a blank, so words may be taken once, with weights."""
    joined = ("\n".join(words) + "\n").lower()
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[raw]
    weight = np.array(list(words.values()))[np.cumsum(raw == 10) - (raw == 10)]
    blank = ~is_letter
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    codes, weight, blank = np.where(is_letter, raw, SPACE)[keep].astype(np.uint64), weight[keep], blank[keep]
    codes, weight, blank = np.append(np.uint64(SPACE), codes), np.append(0, weight), np.append(True, blank)
    if len(codes) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = ngrams(codes)
    weights = np.concatenate((weight[~blank], np.where(blank[:-1], weight[1:], weight[:-1]), weight[1:-1][~blank[1:-1]]))
    found, inverse = np.unique(grams, return_inverse=True)
    return found.astype(np.int64), np.bincount(inverse, weights).astype(np.int64)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    found, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task by language, from the distinct words of its pieces; more than HELD distinct ones are handed on and begun anew."""
    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = held("lang_rank", dict)
    counts.clear()
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for language, parts in counts.items():
            grams, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.repeat(language, len(grams)), pa.array(grams, pa.int64()), pa.array(n)], names=["lang", "gram", "n"])
        counts.clear()

    for batch in slices(batches):
        words: dict[str, Counter] = {}
        for language, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            words.setdefault(language, Counter()).update(text.split())
        for language, own in words.items():
            counts.setdefault(language, []).append(weighted_ngrams(own))
            size += len(counts[language][-1][0])
        if size > HELD:
            for language, parts in counts.items():
                counts[language] = [_added(parts)]
            size = sum(len(parts[0][0]) for parts in counts.values())
            if size > HELD // 2:
                yield from out()
                size = 0
    yield from out()


def learn(rows: DataFrame, ranks: int = RANKS) -> Profiles:
    """Profiles from rows of text and lang. Ranks are cut in each task before languages meet, so a hot one is no large group."""
    counted = rows.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_count, "lang string, gram long, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("place", place).where(F.col("place") <= ranks)
    lists: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):  # at most RANKS rows a language
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles(lists)


def identify(docs: DataFrame, profiles: Profiles, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every row of docs with the predicted language and its score under these names."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lang_rank", dict).clear()
        for batch in slices(batches):
            got = [shared.value.predict(t) for t in texts(batch)]
            yield with_columns(batch, (), {names[0]: pa.array([g[0] for g in got], pa.string()), names[1]: pa.array([g[1] for g in got], pa.float64())})

    added = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return docs.mapInArrow(step, fields_with(docs.schema, (), added))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row per document; rows with remainder 1 are held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    profiles = learn(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language are rejected; lang is replaced by the prediction.

    Null, empty and letterless texts go, and with nothing to learn from all do; an empty table stays empty; repeated rows
    and all columns stay, whatever their names.
    """
    short_batches(spark)
    profiles = learn(docs.where(crc_mod("doc_id", 3) != 1))
    names = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    named = identify(docs, profiles, names).where(F.col(names[0]) != UNKNOWN)
    return named.withColumn("lang", F.col(names[0])).select(*docs.columns)


ORACLE_SQL = None
