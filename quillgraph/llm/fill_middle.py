"""Fill-in-middle: prefix, middle and suffix of each text, cut between tokens and put into another order.

One numpy kernel takes a whole Arrow batch: a table of byte classes marks white space in the UTF-8 buffer, a mask over
neighbouring bytes marks where tokens begin, and a running count that starts anew at each document gives every
document's number of tokens. The places of all cuts are then found by one search over the count, and the three parts of
all texts are slices of the same buffer.

A token is white space and the characters that follow it up to the next white space; white space at a text's end is one
by itself.

Defined cases: null and empty text is plain, with no tokens; texts that hold a marker stay plain, so that what is
transformed can be told from what isn't; a null key counts as the empty text; repeated rows have the same cuts; an empty
table gives an empty one. Very long texts are taken in batches of their own. Other columns are handed on; one named like a result
is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields_with, slices, table, with_columns

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Byte classes: white space, and bytes that begin a character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BEGINS = np.array([b & 0xC0 != 0x80 for b in range(256)])
#: Bytes of a batch that the kernel takes at a time, unless one text is longer; its arrays take about 30 bytes for each.
PIECE_BYTES = 4 << 20

ADDED = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def draws(keys: list, seed: int = SEED) -> np.ndarray:
    """Four 32-bit numbers for each key: the first 32 hex digits of sha256 of seed:key."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    wide = pc.cast(text, pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def running(mask: np.ndarray) -> np.ndarray:
    """How many are marked before each place, the end included."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def token_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A mask of the bytes that begin a token: white space behind other characters, and each document's first byte."""
    space = SPACE[data]
    starts = np.zeros(len(data), bool)
    starts[1:] = space[1:] & ~space[:-1]
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return starts


def marked(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which documents hold a marker."""
    hit = np.zeros(len(data), bool)
    if len(data) > 2:
        inner = np.zeros(256, bool)
        inner[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
        hit[:-2] = (data[:-2] == ord("<")) & inner[data[1:-1]] & (data[2:] == ord(">"))
    before = running(hit)
    return before[np.maximum(offsets[:-1], offsets[1:] - 2)] > before[offsets[:-1]]


def kernel(text: pa.Array, keys: list, seed: int, rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """All columns of ADDED for a batch."""
    offsets, data = buffers(text)
    low, high = offsets[:-1], offsets[1:]
    starts = token_starts(offsets, data)
    count = running(starts)
    n = count[high] - count[low]
    draw = draws(keys, seed)
    cuts = np.sort(draw[:, :2] % (n[:, None] + 1), axis=1)
    # The byte where the token with that number begins: the first place whose count is one more; the document's end for the last cut.
    at = np.searchsorted(count, count[low][:, None] + cuts + 1) - 1
    at = np.where(cuts == n[:, None], high[:, None], at)
    plain = (n == 0) | marked(offsets, data) | (draw[:, 2] % 100 >= rate)
    spm = draw[:, 3] % 100 < spm_rate
    chars = running(BEGINS[data])
    edges = np.concatenate([np.column_stack([low, at]).ravel(), offsets[-1:]])
    parts = pa.Array.from_buffers(pa.large_binary(), 3 * len(n), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(data)])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * len(n), 3))) for i in range(3))
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    empty = pa.scalar(b"", pa.large_binary())
    join = lambda *x: pc.binary_join_element_wise(*x, empty)
    is_plain, is_spm = pa.array(plain), pa.array(spm)
    moved = pc.if_else(is_spm, join(s, suffix, p, prefix, m, middle), join(p, prefix, s, suffix, m, middle))
    output = pc.if_else(is_plain, join(prefix, middle, suffix), moved)
    form = pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm"))
    number = lambda x: pc.if_else(is_plain, pa.scalar(None, pa.int64()), pa.array(x, pa.int64()))
    return {
        "n": pa.array(n, pa.int64()), "form": pc.cast(form, pa.string()), "prefix_chars": number(chars[at[:, 0]] - chars[low]),
        "middle_chars": number(chars[at[:, 1]] - chars[at[:, 0]]), "output": pc.cast(output, pa.string()),
    }


def transform(docs: DataFrame, key: str = "doc_id", column: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Every row of docs with n, form, prefix_chars, middle_chars and output. rate: percent of texts that are transformed; spm_rate: percent of those that begin with the suffix."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=10_000, size=PIECE_BYTES):
            text = pc.fill_null(batch.column(column), "")
            yield with_columns(batch, (), kernel(text, batch.column(key).to_pylist(), seed, rate, spm_rate))

    return docs.mapInArrow(step, fields_with(docs.schema, (), ADDED))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: one row per document."""
    made = transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as x, sha256('42:' || coalesce(doc_id::varchar, '')) as g from documents),
k as (select *, regexp_extract_all(x, '[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+') as k, ('0x' || g[1:8])::bigint as h1, ('0x' || g[9:16])::bigint as h2, ('0x' || g[17:24])::bigint as h3, ('0x' || g[25:32])::bigint as h4 from t),
c as (select *, len(k) as n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) as a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) as b,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from k),
p as (select *, array_to_string(k[1:a], '') as pre, array_to_string(k[a + 1:b], '') as mid, array_to_string(k[b + 1:], '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(x) as restored_sha256 from p
"""
