"""Personal data: patterns for the base spans, and a linear-chain CRF over word shapes that adds spans.

The CRF is trained here, on a small labelled table that is built from templates (``labelled_table``), in seconds on
the driver; its weights, of fixed size, are broadcast. Whole texts are decoded, in numpy batches; stretches of prose for
which the field's weights prove that nothing in them is personal (``crf.CRF.reach``) part a text into pieces.

A span the CRF adds is kept if it doesn't overlap a base span. Kinds are those of the base, ``secret`` for keys, tokens
and passwords, and ``id`` for numbers of persons. Names and street addresses are not found: their shapes are those of prose.

Defined cases: null and empty text have no spans; counts are of base spans, ``n_spans`` of all; spans are in code points,
end exclusive; equal starts go by kind; repeated rows each give a row; an empty table gives an empty one. ``find`` takes
doc_id and text alone, ``mask`` keeps all columns, whatever their names. Time and memory are in proportion to a text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import held, short_batches, slices, table, texts

BASE = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(crf.KINDS)}
_MAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_MAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A start within a run of digits or behind one finds no more than the run's own start, so it is skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Matches of the email pattern, each found from its @."""
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _MAIL_CHARS:
            start -= 1
        if start < at and (m := _MAIL_RIGHT.match(text, at)):
            yield start, m.end(), "email"
            last = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed patterns, in order."""
    out = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def labelled_table(rows: int = 600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Lines of invented words with and without personal data, and the spans in them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "re", "ti", "on", "ü", "é", "st", "la", "Mo", "K"]) for _ in range(rng.randrange(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a7"

    alnum = lambda n: "".join(rng.choice("ABCDEFGHabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("ABCDEFGHIJKLabcdefghijkmnopqrstuvwxyz") for _ in range(n - 2)) + "aZ"

    def personal() -> tuple[str, str, str]:
        """Kind, what stands before it, and the value."""
        kind = rng.choice((*crf.KINDS, "secret"))
        if kind == "email":
            return kind, "", f"{word()}{rng.choice(['.', '_', ''])}{digits(2)}@{word()}.{rng.choice(['com', 'org', 'example.net'])}"
        if kind == "ip":
            return kind, "", ".".join(str(rng.randrange(1, 256)) for _ in range(4))
        if kind == "card":
            n = digits(16)
            return kind, "", rng.choice([n, n, "-".join(n[i : i + 4] for i in range(0, 16, 4)), " ".join(n[i : i + 4] for i in range(0, 16, 4))])
        if kind == "phone":
            return kind, "", rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        if kind == "id":
            return kind, rng.choice(["", "", "SSN ", "ssn: "]), f"{digits(3)}-{digits(2)}-{digits(4)}"
        cue = rng.choice(crf.CUES)
        cue = rng.choice([cue, cue.upper(), cue.title()])
        if rng.random() < 0.3:
            return kind, rng.choice([f"{cue}: ", f"{cue} = ", f"{cue}="]), rng.choice([word() + digits(3), word() + digits(2) + word(), word() + digits(rng.randrange(1, 5)), alnum(9) + "7", alnum(12) + "x1", word() + "_" + digits(2)])
        before = rng.choice(["", "", f"{cue} = ", f"{cue}: ", f"{cue}=", f"{cue} "])
        return kind, before, rng.choice([hexa(40), hexa(40).upper(), hexa(32), f"sk-{word()}{digits(4)}{hexa(24)}", f"AK{digits(3)}{hexa(24).upper()}", f"ghp_{letters(36)}", alnum(40) + "aB12", letters(32)])

    def harmless() -> str:
        n = digits(rng.randrange(1, 5))
        return rng.choice([n, f"{n}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"${n}", f"{n}%", "Version 2.0.", f"@{word()}", f"({n})", f"{digits(5)}", f"{word()}{digits(2)}", f"https://{word()}.com/{digits(4)}", f"{word()}:", f"{word()}_{word()}", "= ", f"the {rng.choice(crf.CUES)} {word()}", word() + "".join(rng.choice("aeioubdgstrn") for _ in range(24))])

    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randrange(2, 12)):
            pick = rng.random()
            if pick < 0.25:
                kind, before, value = personal()
                text += before
                mark = rng.choice(["", "", "", '"', "("]) if kind in ("secret", "email") else ""
                spans.append((len(text) + len(mark), len(text) + len(mark) + len(value), kind))
                text += mark + value + {'"': '"', "(": ")", "": rng.choice(["", "", ",", ".", "###", "!!"])}[mark] + " "
            else:
                text += (harmless() if pick < 0.45 else word() + rng.choice(["", "", "", ",", ".", "***"])) + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def model() -> crf.CRF:
    """The trained field; the same each time."""
    return crf.train(labelled_table())


def pieces_of(text: str, reach: int) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """(first token's number, token spans, tokens behind) of the parts of a text that need decoding: tokens that aren't prose,
    each with ``wide(reach)`` tokens on either side; parts that meet are one."""
    hits = [m.start() for m in crf.SPECIAL.finditer(text)]
    if not hits:
        return
    tokens = [m.span() for m in crf.TOKEN.finditer(text)]
    ends = [b for _, b in tokens]
    low = high = -1
    for i in sorted({bisect_right(ends, at) for at in hits}):
        if high >= 0 and i - wide(reach) > high:
            yield low, tokens[low:high], len(tokens) - high
            low = -1
        if low < 0:
            low = max(0, i - wide(reach))
        high = min(i + wide(reach) + 1, len(tokens))
    yield low, tokens[low:high], len(tokens) - high


def wide(reach: int) -> int:
    """Plain tokens beside another token that are decoded with it. Those next to it have it for a neighbour; ``reach`` further
    ones settle the one behind them as outside, and that needs ``reach`` ones on its other side, between the piece's end and it."""
    return 2 * reach + 3


_EDGE = "\"'`#*$%&!?,;:()[]{}<>|.="


def trimmed(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """A span without marks at its ends, and without the name of a field before a secret."""
    lead = _EDGE.replace("(", "") if kind == "phone" else _EDGE
    own = text[a:b]
    if kind == "secret" and "=" in own.rstrip("="):
        a += own.rstrip("=").rindex("=") + 1
    own = text[a:b].rstrip(_EDGE)
    b = a + len(own)
    return b - len(own.lstrip(lead)), b


def crf_spans(batch: list[str], field: crf.CRF) -> list[list[Span]]:
    """Spans that the field finds in each whole text."""
    scores, margin = field.scores, field.reach + 1
    where, numbers = [], []
    for i, text in enumerate(batch):
        for first, tokens, behind in pieces_of(text, field.reach):
            shapes = [scores.shape(text[a:b]) for a, b in tokens]
            where.append((i, tokens, margin if first else -1, len(tokens) - margin - 1 if behind else len(tokens)))
            numbers.append(scores.of([crf.PLAIN if first else "", *shapes, crf.PLAIN if behind else ""]))
    out: list[list[Span]] = [[] for _ in batch]
    for (i, tokens, low, high), path in zip(where, field.decode(numbers, np.array(scores.rows)), strict=True):
        text, at = batch[i], np.flatnonzero(path)
        open_at = None
        for t in at.tolist():
            name = crf.LABELS[path[t]]
            if name[0] == "B":
                open_at = t
            if open_at is None or not low < open_at < high or t + 1 < len(path) and crf.LABELS[path[t + 1]][0] == "I":
                continue
            a, b = trimmed(text, tokens[open_at][0], tokens[t][1], name[2:])
            if a < b:
                out[i].append((a, b, name[2:]))
    if len(scores.rows) > crf.Scores.SIZE:
        scores.clear()
    return out


def without(spans: list[Span], base: list[Span]) -> list[Span]:
    """Spans, in order, that overlap none of the base, in order of their starts."""
    out, reached, at = [], 0, 0  # the furthest end of the base spans that start before this one's end
    for a, b, kind in spans:
        while at < len(base) and base[at][0] < b:
            reached = max(reached, base[at][1])
            at += 1
        if reached <= a:
            out.append((a, b, kind))
    return out


def all_spans(batch: list[str], field: crf.CRF) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text."""
    out = []
    for text, more in zip(batch, crf_spans(batch, field), strict=True):
        base = base_spans(text)
        added = without(more, base)
        out.append((base, sorted(base + added, key=lambda s: (s[0], ORDER[s[2]], s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id with counts of base spans, their digest, all spans and their number; docs: doc_id, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("crf", dict)
        for batch in slices(batches):
            counts, digests, spans, n_spans = {k: [] for k in BASE}, [], [], []
            for base, every in all_spans(texts(batch), shared.value):
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                n_spans.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n_spans, pa.int64())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, is replaced by the kind of its first."""
    out, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("crf", dict)
        for batch in slices(batches):
            values = batch.column("text").to_pylist()
            found = all_spans([v or "" for v in values], shared.value)
            out = [masked(v, every) if every else v for v, (_, every) in zip(values, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(step, T.StructType(docs.schema.fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row per document."""
    return find(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its personal data replaced by the kind in brackets.

    Null and empty texts stay as they are; an empty table stays empty; repeated rows and all columns stay, whatever their
    names; n_chars, where there is one, follows the text.
    """
    short_batches(spark)
    out = mask(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


ORACLE_SQL = None
