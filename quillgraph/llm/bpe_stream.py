"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A text is cut into pieces that no pretoken spans, so each is encoded by itself. Every pretoken goes through
``bpe.Transducer``, which emits a token once the text behind it is as long as the lookahead that the merge list needs
(``bpe.Merges.lookahead``), and what it emits through an incremental byte-to-text state machine (``bpe.Decoder``).
Results of short pieces are kept in a table of bounded size in each worker. Long texts are taken in segments whose ids
and decoded text are hashed as they leave, so memory grows with neither the text nor the corpus.

Defined cases: null and empty text have no ids and decode to the empty text; special strings in a text become their
own ids; repeated rows each give a row. ``encode`` hands all columns on; where one has the name of a result, the result
replaces it, and ``query`` returns none but its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import fields_with, held, short_batches, slices, table, texts, uncollected, with_columns

FILE = "byte_bpe_50k.json"
#: Entries of each half of a worker's table, and characters of a piece that goes there.
TABLE_SIZE, PIECE_SIZE = 400_000, 48
#: Characters of a text that are taken at a time, up to the next cut.
SEGMENT = 1 << 16

PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{bpe.WS}\p{{L}}\p{{N}}]+|[{bpe.WS}]+(?![^{bpe.WS}])|[{bpe.WS}]+")
#: A blank between other characters begins a pretoken: texts may be cut before it.
CUT = re.compile(rf"(?<=[^{bpe.WS}]) (?=[^{bpe.WS}])")
#: Pieces of any text: of white space before others, only the last character goes with them.
PIECE = re.compile(rf"[{bpe.WS}]?[^{bpe.WS}]+|[{bpe.WS}]+(?![^{bpe.WS}])")
#: Below this, letters are the same in all versions of Unicode, so words of them need no pattern.
LATIN = "\u0250"
#: Without these, every blank and line end begins a piece.
LONG_SPACE = re.compile(rf"[{bpe.WS}]{{3}}|[{bpe.WS}]{{2}}\Z")


class Pieces(bpe.Bounded):
    """piece -> its comma-joined ids. ``odd`` holds the decoded text of pieces that don't decode to themselves: those with
    lone surrogates, which no UTF-8 has."""

    def __init__(self, path: str, size: int = TABLE_SIZE) -> None:
        super().__init__(size, PIECE_SIZE)
        merges = bpe.load(path)
        self.stream, self.decoder = bpe.Transducer(merges), bpe.Decoder(merges)
        self.special, self.pattern = merges.special, bpe.special_pattern(path)
        self.odd: dict[str, str] = {}

    def make(self, piece: str) -> str:
        found = PRETOKEN.findall(piece)
        return self.joined(piece, found) if len(found) > 1 else self.encoded(piece, self.stream.encode(piece))

    def joined(self, piece: str, pretokens: list[str]) -> str:
        ids = ",".join([self[p] for p in pretokens])
        if self.odd and (decoded := "".join([self.odd.get(p, p) for p in pretokens])) != piece:
            self.odd[piece] = decoded
        return ids

    def encoded(self, pretoken: str, own: list[int]) -> str:
        decoded = self.decoder.feed(own) + self.decoder.finish()
        if decoded != pretoken:
            self.odd[pretoken] = decoded
        return ",".join(map(str, own))

    def fill(self, pieces: set[str]) -> None:
        """Puts pieces into the table; the transducer reads new pretokens together."""
        older, fresh, several = self.older, set(), []
        for piece in [p for p in pieces if p not in self and len(p) <= PIECE_SIZE]:
            if piece in older:
                self[piece]
            elif (piece[1:] if piece[0] == " " else piece).isalpha() and max(piece) < LATIN:
                fresh.add(piece)
            else:
                found = PRETOKEN.findall(piece)
                if len(found) > 1:
                    several.append((piece, found))
                fresh.update([p for p in found if p not in self and p not in older])
        new = list(fresh)
        for piece, own in zip(new, self.stream.encode_all(new), strict=True):
            self.keep(piece, self.encoded(piece, own))
        for piece, found in several:
            self.keep(piece, self.joined(piece, found))

    def split(self, text: str) -> Iterator[list[str] | str]:
        """Pieces of a text, segment by segment, and the special strings between them."""
        for part in self.pattern.split(text) if self.pattern and any(s in text for s in self.special) else [text]:
            if part in self.special:
                yield part
                continue
            for segment in segments(part):
                yield PIECE.findall(segment) if LONG_SPACE.search(segment) else pieces(segment)

    def parts(self, split: Iterator[list[str] | str]) -> Iterator[tuple[list[str], str]]:
        """(comma-joined ids of each piece, decoded text), segment by segment."""
        for part in split:
            if isinstance(part, str):
                yield [str(self.special[part])], part
            else:
                ids = list(map(self.__getitem__, part))
                yield ids, "".join([self.odd.get(p, p) for p in part] if self.odd else part)

    def of(self, texts: list[str]) -> Iterator[Iterator[tuple[list[str], str]]]:
        """parts() of each text. Texts of one segment are split first and their pieces put into the table together; longer ones as they come."""
        splits = [list(self.split(t)) if len(t) <= SEGMENT else self.split(t) for t in texts]
        self.fill({p for s in splits if isinstance(s, list) for part in s if not isinstance(part, str) for p in part})
        return map(self.parts, splits)


def segments(text: str) -> Iterator[str]:
    """The text in parts of about SEGMENT characters."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + SEGMENT) if len(text) > at + SEGMENT else None
        end = cut.start() if cut else len(text)
        yield text[at:end] if at or cut else text
        at = end


def pieces(segment: str) -> list[str]:
    """Pieces of a segment without long white space."""
    first, *lines = segment.split("\n")
    head, *rest = first.split(" ")
    out = [head] if head else []
    out += [" " + x for x in rest]
    for line in lines:
        head, *rest = line.split(" ")
        out.append("\n" + head)
        out += [" " + x for x in rest]
    return out


def encode_text(text: str, path: str, size: int = TABLE_SIZE) -> tuple[str, str]:
    """Comma-joined ids and the decoded text."""
    own = held(f"bpe {path} {size}", lambda: Pieces(path, size))
    got = list(own.parts(own.split(text)))
    return ",".join([i for ids, _ in got for i in ids]), "".join([d for _, d in got])


def _digests(parts: Iterator[tuple[list[str], str]]) -> tuple[int, str, str]:
    """Number of ids, and sha256 of them and of the decoded text, hashed as they leave."""
    n, hashed, back = 0, hashlib.sha256(), hashlib.sha256()
    for ids, decoded in parts:
        joined = ",".join(ids)
        hashed.update(("," + joined if n else joined).encode())
        n += joined.count(",") + 1
        back.update(decoded.encode("utf-8", "surrogatepass"))
    return n, hashed.hexdigest(), back.hexdigest()


def _ids(parts: Iterator[tuple[list[str], str]]) -> np.ndarray:
    got = [np.fromstring(",".join(ids), np.int32, sep=",") for ids, _ in parts]
    return np.concatenate(got) if len(got) > 1 else got[0] if got else np.empty(0, np.int32)


def encode(docs: DataFrame, path: str, digests: bool = False, size: int = TABLE_SIZE) -> DataFrame:
    """Every row of docs with n_tokens and ids (array); with digests the sha256 of ids and of the decoded text in place of the ids."""
    added = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.ArrayType(T.IntegerType()))]
    fields = [T.StructField("n_tokens", T.LongType()), *[T.StructField(*x) for x in added]]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held(f"bpe {path} {size}", lambda: Pieces(path, size))
        for batch in uncollected(slices(batches, size=2 << 20)):
            if digests:
                n, hashed, back = zip(*map(_digests, of.of(texts(batch))), strict=True)
                own = {"ids_sha256": pa.array(hashed, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            else:
                every = list(map(_ids, of.of(texts(batch))))
                n = [len(x) for x in every]
                own = {"ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(every), pa.int32()))}
            yield with_columns(batch, (), {"n_tokens": pa.array(n, pa.int64()), **own})

    return docs.mapInArrow(step, fields_with(docs.schema, (), fields))


def decode(ids: list[int], path: str) -> str:
    """The text of the ids, special tokens included."""
    decoder = bpe.Decoder(bpe.load(path))
    return decoder.feed(ids) + decoder.finish()


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op9: one row per document."""
    path = path or public_tokenizers.path(FILE)
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: all documents, with n_tokens, their token ids (array) and n_ids. An empty table gives an
    empty one; null text has no ids; columns of these names are replaced, others stay."""
    short_batches(spark)
    return encode(docs, public_tokenizers.path(FILE), size=TABLE_SIZE // 4).withColumn("n_ids", F.size("ids"))


ORACLE_SQL = None
