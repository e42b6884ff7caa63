"""Benchmark decontamination: a prefix-filtered containment join of documents against item windows.

A window is ``window`` consecutive words of an item (an item with fewer words, but not none, is one window). Its
shingles are its pairs of neighbouring words (of a window of one word, the word). They are ordered by rarity: how often
each stands in all documents, counted first. A document contains a window only if it contains all its shingles, so the
necessary prefix is one shingle, the window's rarest. Document shingles are joined to those prefixes; the place of the
prefix in the window gives the only possible start (positional bound), a start before the text or an end behind it is
dismissed (length bound), and the item-sized window of document words there is compared exactly.

Items are cut on the executors into chunks of ``CHUNK`` words that overlap by a window less one, so no item is too large
for the index. The index takes at most about ``INDEX_BYTES`` in memory (``BYTES_A_WORD`` for each item word, measured): one
block of chunks is the usual case. More blocks are joined one after the other to the documents; each gives only the
hits, which are brought together by the text's digest, so documents aren't written again.

Defined cases: null or empty text has no words and no hits; an item without words has no window; equal items are
all reported; an item whose id is null hits words, but has no id to report or count; repeated document rows each give a
row; an empty table gives an empty one, and without items no document is hit. ``mark`` hands all columns on and puts its
results under the names it is given; a column of such a name is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import ALNUM_TABLE, LOWER, UPPER, alnum_words, fields_with, fresh, held, short_batches, slices, table, texts_as_bytes, with_columns

WINDOW = 10
#: Words of a chunk of an item.
CHUNK = 4000
#: Memory of one block's index, and what a word of an item takes of it.
INDEX_BYTES, BYTES_A_WORD = 96 << 20, 400
#: What mark() adds: words, hit runs as [start, end) pairs, items with an occurring window.
NAMES = ("n_words", "hit_runs", "item_ids")

Chunk = tuple[str | None, int, bytes]


def chunks_of(words: list[bytes], window: int, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """Parts of an item such that each window is in one."""
    for low in range(0, max(len(words) - window + 1, 1) if words else 0, chunk):
        yield words[low : low + chunk + window - 1]


def shingles(words: list[bytes]) -> list[bytes]:
    """Pairs of neighbouring words."""
    return [a + b" " + b for a, b in zip(words, words[1:])]


class Index:
    """Item words in one list, and for each prefix shingle the distinct windows that have it as their rarest."""

    def __init__(self, chunks: Iterable[Chunk], window: int) -> None:
        """chunks: (item_id, words of the whole item if fewer than a window else the window, text of the chunk)."""
        self.words: list[bytes] = []
        self.owners: list[set[str]] = []  # of each distinct window
        self.sizes: list[int] = []
        self.starts: list[int] = []
        known: dict[tuple[bytes, ...], int] = {}
        same: dict[bytes, bytes] = {}
        for item, size, text in chunks:
            own = [same.setdefault(w, w) for w in text.split()]
            base = len(self.words)
            self.words += own
            for i in range(len(own) - size + 1):
                number = known.setdefault(tuple(own[i : i + size]), len(known))
                if number == len(self.owners):
                    self.owners.append(set())
                    self.starts.append(base + i)
                    self.sizes.append(size)
                if item is not None:
                    self.owners[number].add(item)
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}  # shingle -> (window, place of the shingle in it)

    def vocabulary(self) -> set[bytes]:
        """Shingles of the windows."""
        out = set()
        for start, size in zip(self.starts, self.sizes, strict=True):
            own = self.words[start : start + size]
            out.update(shingles(own) if size > 1 else own)
        return out

    def order(self, frequency: dict[bytes, int]) -> Index:
        """Chooses each window's prefix by the frequency of shingles in the documents, equals by name."""
        self.prefixes = {}
        for number, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            own = self.words[start : start + size]
            every = shingles(own) if size > 1 else own
            at = min(range(len(every)), key=lambda i: (frequency.get(every[i], 0), every[i]))
            self.prefixes.setdefault(every[at], []).append((number, at))
        return self

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of every occurrence in a document's words, and the items."""
        found, items, n, prefixes = [], set(), len(words), self.prefixes
        for own in (shingles(words), words) if 1 in self.sizes else (shingles(words),):
            for i in [i for i, s in enumerate(own) if s in prefixes]:
                for number, at in prefixes[own[i]]:
                    start, size, there = i - at, self.sizes[number], self.starts[number]
                    if start >= 0 and start + size <= n and words[start : start + size] == self.words[there : there + size]:
                        found.append((start, start + size))
                        items |= self.owners[number]
        return found, items


def merge_runs(found: list[tuple[int, int]]) -> list[int]:
    """Disjoint runs, flat: start, end, start, end."""
    flat: list[int] = []
    for start, end in sorted(found):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def item_chunks(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, words, n): chunks of all items (item_id, text), written once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for item, raw in zip(batch.column("item_id").to_pylist(), texts_as_bytes(batch), strict=True):
                words = alnum_words(raw)
                for part in chunks_of(words, window):
                    for column, value in zip(out, (item, min(window, len(words)), b" ".join(part), len(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["item_id", "size", "words", "n"])

    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    return stored(own.mapInArrow(step, "item_id string, size long, words binary, n long").distinct())


def frequencies(docs: DataFrame, text: str, index: Index) -> dict[bytes, int]:
    """How often each shingle of the index stands in the documents; at most as many numbers as the index has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(index.vocabulary()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("decontaminate", dict)
        wanted, total = shared.value, Counter()
        single = any(b" " not in s for s in wanted)
        for batch in slices(batches):
            for raw in texts_as_bytes(batch, text):
                words = alnum_words(raw)
                total.update(filter(wanted.__contains__, shingles(words)))
                if single:
                    total.update(filter(wanted.__contains__, words))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["shingle", "n"])

    counted = docs.select(text).mapInArrow(step, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    out = {bytes(r.shingle): r.n for r in counted.collect()}
    shared.unpersist()
    return out


def _marks(docs: DataFrame, text: str, names: tuple[str, str, str], index: Index | None, hits_only: bool = False) -> DataFrame:
    """Every row, or each row that is hit, with its results by one index; without an index no row is hit."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    added = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())), strict=True)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("decontaminate", dict)
        own = shared.value
        for batch in slices(batches):
            n_words, runs, ids = [], [], []
            for raw in texts_as_bytes(batch, text):
                words = alnum_words(raw)
                found, hit = own.find(words) if own else ((), ())
                n_words.append(len(words))
                runs.append(merge_runs(found))
                ids.append(sorted(hit))
            out = with_columns(batch, (), dict(zip(names, (pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))), strict=True)))
            yield out.filter(pa.array([bool(r) for r in runs], pa.bool_())) if hits_only else out

    return docs.mapInArrow(step, fields_with(docs.schema, (), added))


def _joined_runs(runs: Column) -> Column:
    """Runs of several blocks, an array of flat arrays, as disjoint ones."""
    pairs = F.array_sort(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")), lambda i: F.struct(F.get(r, 2 * i).alias("a"), F.get(r, 2 * i + 1).alias("b"))))))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, p: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(last(acc), p["b"])))
    return F.aggregate(pairs, F.array().cast("array<bigint>"), lambda acc, p: F.when((F.size(acc) > 0) & (p["a"] <= F.try_element_at(acc, F.lit(-1))), longer(acc, p)).otherwise(F.concat(acc, F.array(p["a"], p["b"]))))


def _indexes(docs: DataFrame, items: DataFrame, text: str, window: int, index_bytes: int) -> tuple[int, Callable[[int], Index]]:
    """How many indexes the items take, and what makes each."""
    chunks = item_chunks(items, window)
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total * BYTES_A_WORD // index_bytes))

    def index_of(block: int) -> Index:
        part = chunks if blocks == 1 else chunks.where(F.pmod(F.xxhash64("words", "size"), F.lit(blocks)) == block)
        own = Index(((r.item_id, r.size, bytes(r.words)) for r in part.select("item_id", "size", "words").toLocalIterator()), window)
        return own.order(frequencies(docs, text, own) if own.sizes else {})

    return blocks, index_of


def mark(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, index_bytes: int = INDEX_BYTES, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Every row of docs with its number of words, hit runs and the ids of items that hit it; items has item_id and text."""
    blocks, index_of = _indexes(docs, items, text, window, index_bytes)
    if blocks == 1:
        own = index_of(0)
        return _marks(docs, text, names, own if own.sizes else None)
    key = fresh("digest", docs.columns)
    hits = None
    for block in range(blocks):
        found = stored(_marks(docs.select(F.col(text).alias("text")).distinct(), "text", NAMES, index_of(block), True).select(F.md5("text").alias(key), *NAMES[1:]))
        hits = found if hits is None else hits.union(found)
    runs, ids = fresh("runs", docs.columns), fresh("ids", docs.columns)
    hits = hits.groupBy(key).agg(_joined_runs(F.collect_list("hit_runs")).alias(runs), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias(ids))
    counted = _marks(docs, text, names, None).withColumn(key, F.md5(F.col(text))).join(hits, key, "left")
    return counted.withColumns({names[1]: F.coalesce(runs, F.col(names[1])), names[2]: F.coalesce(ids, F.col(names[2]))}).drop(key, runs, ids)


def hit_count(runs: str = "hit_runs") -> Column:
    """Document words inside any occurrence: ends minus starts."""
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: one row per document."""
    marked = mark(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select(
        "doc_id",
        "n_words",
        hit_count().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: hit words are cut out of the text, a document of which under half of the words is left goes.

    Null, empty and unhit texts stay as they are; an empty table stays empty; repeated rows are treated alike; all columns
    stay, whatever their names, and n_chars, where there is one, follows the text.
    """
    short_batches(spark)
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    blocks, index_of = _indexes(docs, items, "text", WINDOW, INDEX_BYTES)
    cleaned = _cleaned_by(docs, index_of(0)) if blocks == 1 else _cleaned(docs, items)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def _cleaned_by(docs: DataFrame, index: Index) -> DataFrame:
    """The stage with one index: found and cut out in one pass, so that a task needs one worker."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("decontaminate", dict)
        own = shared.value
        for batch in slices(batches):
            out, kept = [], []
            for value, raw in zip(batch.column("text").to_pylist(), texts_as_bytes(batch), strict=True):
                words = alnum_words(raw)
                runs = merge_runs(own.find(words)[0]) if own.sizes else []
                kept.append(2 * (sum(runs[1::2]) - sum(runs[::2])) <= len(words))
                out.append(excise(value, runs) if runs else value)
            made = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(made, names=batch.schema.names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(step, docs.schema)


def _cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The stage with several indexes: their hits are joined by text first."""
    names = tuple(fresh(n, docs.columns) for n in NAMES)
    marked = mark(docs, items, names=names)
    left = marked.where(hit_count(names[1]) * 2 <= F.col(names[0])).drop(names[0], names[2])
    runs = names[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [excise(v, r) if r else v for v, r in zip(batch.column("text").to_pylist(), batch.column(runs).to_pylist(), strict=True)]
            kept = [n for n in batch.schema.names if n != runs]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in kept], names=kept)

    return left.select(*docs.columns, runs).mapInArrow(step, docs.schema)


def excise(value: str, runs: list[int]) -> str:
    """The text without the characters from the first to the last word of each run."""
    raw = value.encode("utf-8", "surrogatepass")
    spots, at = [], 0
    spaced = raw.translate(ALNUM_TABLE)
    for word in spaced.split():
        at = spaced.index(word, at)
        spots.append((at, at + len(word)))
        at += len(word)
    kept, last = [], 0
    for start, end in zip(runs[::2], runs[1::2], strict=True):
        kept.append(raw[last : spots[start][0]])
        last = spots[end - 1][1]
    kept.append(raw[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
sized as (select item_id, w, least({WINDOW}, len(w)) as size from items where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(w[k : k + size - 1], ' ') as win from (select *, unnest(range(1, len(w) - size + 2)) as k from sized)),
spots as (select r, size, k, array_to_string(w[k : k + size - 1], ' ') as win from (select r, w, size, unnest(range(1, len(w) - size + 2)) as k from docs, (select distinct size from sized) where len(w) >= size)),
hits as (select r, size, k, item_id from spots join windows using (size, win)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + size)) as p from (select distinct r, k, size from hits)) group by r),
named as (select r, list_sort(list(distinct item_id::varchar) filter (item_id is not null)) as ids from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join named using (r)
"""
