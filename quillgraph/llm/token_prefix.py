"""Token counts by prefix dynamic programming.

For every prefix of a word the table holds the exact number of tokens, taken from the tables of its shorter prefixes
and the one last token that fits (see ``bpe``). A text's counts are those of its words added up, so truncation to a
budget and questions about any prefix are answered by look-up, without encoding again.

Text is put in composed normal form (NFC) and lower case, character by character; pieces between white space are
counted once and kept in a table of bounded size in each worker.

Defined cases: null and empty text have no tokens and no bytes; special strings in a text count as one token each and
part the words at their sides; repeated rows each give a row; an empty table gives an empty one. ``count`` hands the other
columns on, without ``text``; a column named ``n_tokens`` is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import fields_with, held, slices, table, texts, with_columns

FILE = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of each half of a worker's tables, and characters of a piece that goes there.
TABLE_SIZE, PIECE_SIZE = 400_000, 48

PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{bpe.WS}\p{{L}}\p{{N}}]+")
SPACE = re.compile(f"[{bpe.WS}]+")
#: Where Python's white space differs from Unicode's, and where its lower case looks at neighbours.
ODD = re.compile("[\x1c-\x1f]")


def word_counts(word: str, merges: bpe.Merges) -> list[int]:
    """Tokens of each prefix of the word, by bytes, as a word of its own."""
    symbols = merges.symbols(word.encode("utf-8", "surrogatepass"))
    last, count = merges.last_tokens(symbols)
    return [merges.closed(symbols, last, count, end) for end in range(len(symbols) + 1)]


class Words(bpe.Bounded):
    """word -> its tokens: the last entry of its table."""

    def __init__(self, path: str) -> None:
        super().__init__(TABLE_SIZE, PIECE_SIZE)
        self.merges = bpe.load(path)

    def make(self, word: str) -> int:
        m = self.merges
        symbols = m.symbols(word.encode("utf-8", "surrogatepass"))
        return m.closed(symbols, *m.last_tokens(symbols), len(symbols))


class Pieces(bpe.Bounded):
    """piece without white space -> its tokens."""

    def __init__(self, path: str) -> None:
        super().__init__(TABLE_SIZE, PIECE_SIZE)
        self.words = Words(path)

    def make(self, piece: str) -> int:
        return sum(map(self.words.__getitem__, PRETOKEN.findall(piece)))


def plain(text: str) -> str:
    """NFC and lower case, each character by itself."""
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def parted(text: str, path: str) -> list[str]:
    """The text between special strings, and those strings."""
    pattern = bpe.special_pattern(path)
    return pattern.split(text) if pattern and any(s in text for s in bpe.load(path).special) else [text]


def count_text(text: str, path: str) -> int:
    """Tokens of the whole text."""
    of, special, total = held(f"prefix {path}", lambda: Pieces(path)).__getitem__, bpe.load(path).special, 0
    for part in parted(text, path):
        if part in special:
            total += 1
        elif part:
            part = plain(part)
            total += sum(map(of, filter(None, SPACE.split(part)) if ODD.search(part) else part.split()))
    return total


class PrefixTable:
    """Counts at every prefix of one text: ``counts[i]`` is for its first i characters in normal form (``text``)."""

    def __init__(self, text: str, path: str) -> None:
        merges = bpe.load(path)
        self.text, self.counts = "", [0]
        for part in parted(text, path):
            if part in merges.special:
                self.text += part
                self.counts += [self.counts[-1]] * (len(part) - 1) + [self.counts[-1] + 1]
                continue
            part = plain(part)
            base, at = self.counts[-1], 0
            for m in PRETOKEN.finditer(part):
                self.counts += [base] * (m.start() - at)
                tokens, size = word_counts(m[0], merges), 0
                for c in m[0]:
                    size += len(c.encode("utf-8", "surrogatepass"))
                    self.counts.append(base + tokens[size])
                base, at = base + tokens[-1], m.end()
            self.counts += [base] * (len(part) - at)
            self.text += part

    def truncate(self, budget: int) -> str:
        """The longest prefix such that it and all shorter ones keep to the budget."""
        highest, best = [], 0
        for c in self.counts:
            best = max(best, c)
            highest.append(best)
        return self.text[: bisect_right(highest, budget) - 1]


def count(docs: DataFrame, path: str) -> DataFrame:
    """Every row of docs with n_tokens."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield with_columns(batch, ("text",), {"n_tokens": pa.array([count_text(t, path) for t in texts(batch)], pa.int64())})

    return docs.mapInArrow(step, fields_with(docs.schema, ("text",), [T.StructField("n_tokens", T.LongType())]))


def query(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """op8: one row per document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return count(docs, path or public_tokenizers.path(FILE)).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


ORACLE_SQL = None
