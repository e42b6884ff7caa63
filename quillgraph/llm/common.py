"""What several operators share: reading a table, text as bytes, token files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to lower case, every ASCII byte outside 0-9 a-z to a space, the bytes of other characters kept.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_held: dict[str, object] = {}
#: Called when tables are dropped: modules put in what else they keep in a worker.
ON_RELEASE: list[Callable[[], None]] = []


def held(owner: str, make: Callable):
    """A worker's tables of one operator. Workers are reused, so those of the operator before go when another one begins."""
    if owner not in _held:
        release()
        _held[owner] = make()
    return _held[owner]


def release() -> None:
    """Drops the tables held in this process and hands free memory back to the system."""
    _held.clear()
    for drop in ON_RELEASE:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it until no column has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return text.translate(ALNUM_TABLE).split()


def space_words(text: bytes, lower: bool = True) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; A-Z in lower case unless told otherwise."""
    return (text.lower() if lower else text).split()


def texts_as_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 of each text, without decoding; null as empty."""
    for value in pc.cast(batch.column(column), pa.binary()):
        yield value.as_py() or b""


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Each text as str; null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, and of so many bytes if those are more than a row, so that what a step makes of one stays small."""
    for batch in batches:
        each = max(1, min(rows, size * len(batch) // max(batch.nbytes, 1)))
        for low in range(0, len(batch), each):
            yield batch.slice(low, each)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows between executors and their workers, unless the session names a number: whole texts in
    the default of 10,000 rows are tens of megabytes on either side. Results don't depend on it."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, str(rows))


def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with garbage collection put off to the end of each: large tables without cycles would be gone through again and again."""
    for batch in batches:
        gc.disable()
        try:
            yield batch
        finally:
            gc.enable()
            gc.collect(1)  # what the batch has made, not the tables


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the fold of a row. A null key counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without the dropped columns and with the added ones at its end, which replace those of their names (case aside, as in Spark)."""
    gone = {n.lower() for n in (*drop, *added)}
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in gone]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(added.values()), names=[*(batch.schema.names[i] for i in kept), *added])


def fields_with(schema: T.StructType, drop: tuple[str, ...], added: list[T.StructField]) -> T.StructType:
    """The schema of with_columns()."""
    gone = {n.lower() for n in (*drop, *(f.name for f in added))}
    return T.StructType([*(f for f in schema if f.name.lower() not in gone), *added])
