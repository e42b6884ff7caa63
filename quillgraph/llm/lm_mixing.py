"""LM scoring: logistic context mixing over bytes (``mixing``), and a smoothed unigram score as the base.

Learning reads the training rows only and happens on the executors: grams with counts are summed over the corpus and
stored, none left out. They lie in parts by the last two bytes of context, so a part has all counts of its contexts of
two to five bytes, exactly, and the number of parts grows with the grams. Gate weights are learned online over the
grams of each part and averaged, twice; the adaptive map adds up what followed. Texts are scored in packs: a pack sends
its distinct grams to their parts and gets their costs back. Only tables of fixed size come to the driver: counts of
one byte after another (at most 65536 rows), weights and the map.

Base: word counts are summed over the training rows. Words with a share of at least 1 / HOT_WORDS of all tokens, so
at most HOT_WORDS of them, are broadcast; others are joined to their counts by word and added up by document.

Defined cases: null text is empty and has one token, its end; without training rows N and V are 0 and the base score
of each token is log10(0.1 / 0.1) = 0; repeated rows each give a row; base sums go by a 64-bit hash of doc_id and
text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import mixing
from .common import crc_mod, slices, space_words, table, texts_as_bytes

FOLDS = 10
HOT_WORDS = 500_000
#: The end of a text as a token: no word is empty.
END = b""
#: Distinct words and grams that a task holds before it hands their counts on.
HELD, HELD_GRAMS = 300_000, 3_000_000
#: Bytes of training text for a part of the grams, and bytes of a pack of texts, on average.
PART_BYTES, LEAST_PARTS = 16 << 20, 16
PACK_BYTES, LEAST_PACKS = 8 << 20, 8


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for raw in texts_as_bytes(batch):
            held.update(space_words(raw))
            held[END] += 1
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all rows, ends included."""
    return stored(train.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a task with counts; more than HELD_GRAMS distinct ones are handed on and begun anew."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + 100_000].astype(np.int64)), pa.array(n[low : low + 100_000].astype(np.int64))], names=["gram", "n"])

    merge = lambda: mixing.counted(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    for batch in batches:
        for keys, _ in mixing.windows(texts_as_bytes(batch)):
            parts.append(mixing.counted(keys))
            size += len(parts[-1][0])
            if size > HELD_GRAMS:
                parts = [merge()]
                size = len(parts[0][0])
                if size > HELD_GRAMS // 2:
                    yield from out(*parts[0])
                    parts, size = [], 0
    if parts:
        yield from out(*merge())


def _packed(keys: np.ndarray) -> bytes:
    """Ordered grams as differences, bytes of one place together, so that shuffles compress them well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _merged(table: pa.Table) -> pa.Table:
    """One row for a part: its distinct grams, in order, and their counts."""
    keys, n = mixing.counted(table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy())
    return pa.table({"part": table.column("part").slice(0, 1), "grams": pa.array([_packed(keys)], pa.binary()), "counts": pa.array([n.astype(np.int64).tobytes()], pa.binary())})


def _grams_of(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams in order and counts of each part."""
    for grams, counts in zip(rows.column("grams"), rows.column("counts"), strict=True):
        yield _unpacked(grams.as_py()), np.frombuffer(counts.as_py(), np.int64).astype(np.float64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the last two bytes of the grams."""
    total = np.zeros(1 << 16)
    for batch in batches:
        for keys, n in _grams_of(batch):
            total += np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), n, 1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])


def _cells(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(b)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(a[at]), pa.array(b[at])], names=["cell", "a", "b"])


@dataclass
class Model:
    """The training grams as a stored table (part, grams, counts), a row for each part, and what of the model has a fixed size."""

    grams: DataFrame
    parts: int
    low: np.ndarray
    weights: np.ndarray
    curve: np.ndarray


def learn(train: DataFrame, rounds: int = 2) -> Model:
    """The model of the training rows (text)."""
    context = train.sparkSession.sparkContext
    size = train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gram_counts(batches):
            part = mixing.part_of(batch.column("gram").to_numpy().astype(np.uint64), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "gram", "n"])

    found = train.select("text").mapInArrow(counts, "part int, gram long, n long")
    grams = stored(found.groupBy("part").applyInArrow(_merged, "part int, grams binary, counts binary"))
    pairs = columns(grams.mapInArrow(_pairs, "pair int, n double").groupBy("pair").agg(F.sum("n").alias("n")))  # at most 65536 rows
    low = np.zeros(1 << 16)
    low[pairs["pair"]] = pairs["n"]
    weights, hits, seen = mixing.Mixer(np.empty(0), np.empty(0)).weights, np.zeros(mixing.CELLS), np.zeros(mixing.CELLS)

    def over_parts(step) -> dict[str, np.ndarray]:
        shared = context.broadcast((low, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counted, now = shared.value
            for batch in batches:
                for keys, n in _grams_of(batch):
                    mixer = mixing.PartMixer(now, mixing.Exact(keys, n, counted))
                    yield step(mixer, keys, n, np.random.default_rng(len(keys)).permutation(len(keys)))

        sums = columns(grams.mapInArrow(run, "cell int, a double, b double").groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
        shared.destroy()
        return sums

    def weigh(mixer: mixing.PartMixer, keys: np.ndarray, n: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        for some in mixer.steps(rows):
            mixer.learn(keys[some], n[some])
        flat = mixer.weights.ravel()
        return _cells(flat * n.sum(), np.full(len(flat), n.sum()))

    def observe(mixer: mixing.PartMixer, keys: np.ndarray, n: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        for some in mixer.steps(rows):
            mixer.observe(keys[some], n[some])
        return _cells(mixer.hits, mixer.seen)

    for _ in range(rounds):
        sums = over_parts(weigh)
        weights.ravel()[sums["cell"]] = sums["a"] / sums["b"]
    sums = over_parts(observe)
    hits[sums["cell"]], seen[sums["cell"]] = sums["a"], sums["b"]
    return Model(grams, parts, low, weights, mixing.refined(hits, seen))


def _asked(raws: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts by part, in order within it, and where each part begins."""
    pieces = [mixing.counted(keys)[0] for keys, _ in mixing.windows(raws)]
    keys = mixing.counted(np.concatenate(pieces))[0] if len(pieces) > 1 else pieces[0]
    order, part = _by_part(keys, parts)
    return keys[order], np.searchsorted(part, np.arange(parts + 1))


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ordered grams stand once they are dealt into parts, and the parts, in order."""
    part = mixing.part_of(keys, parts).astype(np.min_scalar_type(parts))  # small numbers are sorted by their bytes
    order = np.argsort(part, kind="stable")
    return order, part[order]


def gram_costs(keyed: DataFrame, model: Model) -> DataFrame:
    """(pack, part, costs): bits of the distinct grams that the texts of each pack hold, as float32 in order of gram.

    Each pack sends every part its distinct grams; a part, which has all counts of their contexts, answers with costs.
    """
    parts = model.parts
    shared = keyed.sparkSession.sparkContext.broadcast((model.low, model.weights, model.curve))

    def ask(table: pa.Table) -> pa.Table:
        keys, bounds = _asked(list(texts_as_bytes(table)), parts)
        some = np.flatnonzero(np.diff(bounds))
        packed = [_packed(keys[bounds[p] : bounds[p + 1]]) for p in some]
        return pa.table({"part": pa.array(some.astype(np.int32)), "pack": pa.array([table.column("pack")[0].as_py()] * len(some), pa.int64()), "grams": pa.array(packed, pa.binary())})

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = [_unpacked(x) for x in asked.column("grams").to_pylist()]
        if not wanted:
            return pa.table({"pack": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "costs": pa.array([], pa.binary())})
        low, weights, curve = shared.value
        keys, n = next(_grams_of(known), (np.empty(0, np.uint64), np.empty(0)))
        every = np.unique(np.concatenate([keys, *wanted]))
        counts = np.zeros(len(every))
        counts[np.searchsorted(every, keys)] = n
        cost = mixing.PartMixer(weights, mixing.Exact(every, counts, low)).cost(every, curve).astype(np.float32)
        costs = [cost[np.searchsorted(every, w)].tobytes() for w in wanted]
        return pa.table({"pack": asked.column("pack"), "part": asked.column("part"), "costs": pa.array(costs, pa.binary())})

    questions = keyed.groupBy("pack").applyInArrow(ask, "part int, pack long, grams binary")
    return model.grams.groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(answer, "pack long, part int, costs binary")


def _text_bits(raws: list[bytes], costs: pa.Table, parts: int) -> np.ndarray:
    """Bits of each text with its end. Grams are sorted once, along with the numbers of their texts; what is kept of them until all distinct ones are known is small."""
    pieces = []  # first text, distinct grams, how often each occurs, texts it occurs in
    for low in range(0, len(raws), mixing.MOST_TEXTS):
        for grams, owner in mixing.windows(raws[low : low + mixing.MOST_TEXTS]):
            both = (grams << np.uint64(16)) | owner.astype(np.uint64)  # a gram has 48 bits
            both.sort()
            grams, owner = both >> np.uint64(16), both.astype(np.uint16)
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            pieces.append((low, grams[first], np.diff(first, append=len(grams)), owner))
    keys = mixing.counted(np.concatenate([p[1] for p in pieces]))[0]
    by_part = sorted(zip(costs.column("part").to_pylist(), costs.column("costs").to_pylist(), strict=True))
    cost = np.empty(len(keys), np.float32)
    cost[_by_part(keys, parts)[0]] = np.frombuffer(b"".join(c for _, c in by_part), np.float32)
    out = np.zeros(len(raws))
    for low, grams, times, owner in pieces:
        own = np.bincount(owner, np.repeat(cost[np.searchsorted(keys, grams)], times))
        out[low : low + len(own)] += own
    return out


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A table of bounded size as arrays on the driver."""
    got = df.toArrow()
    return {n: got.column(n).to_numpy() for n in got.column_names}


def score(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, counts, base_score and score of each row of docs (doc_id, text), by what train (text) teaches."""
    context = docs.sparkSession.sparkContext
    counts = word_counts(train)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = math.log10(total + 0.1 * (distinct + 1))
    least = max(1, -(-total // HOT_WORDS))
    frequent = columns(counts.where(F.col("n") >= least))  # at most HOT_WORDS rows
    hot = {w: math.log10(n + 0.1) - below for w, n in zip(frequent["word"], frequent["n"].tolist(), strict=True)}
    model = learn(train)
    words, parts = context.broadcast(hot), model.parts
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packs = max(LEAST_PACKS, -(-size // PACK_BYTES))
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", "text", row.alias("row"), F.pmod(row, F.lit(packs)).alias("pack"))

    def measure(table: pa.Table, costs: pa.Table) -> pa.Table:
        raws = list(texts_as_bytes(table))
        n = [len(space_words(raw, lower=False)) + 1 for raw in raws]
        bits = _text_bits(raws, costs, parts)
        return pa.table(
            [table.column("doc_id"), table.column("row"), pa.array([len(r) for r in raws], pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.float64())],
            names=["doc_id", "row", "n_bytes", "n_tokens", "bits"],
        )

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch, words that aren't hot and the rows that hold them, as often as they do; and for each row what
        its hot words add up to, under a blank and its number, which no word is and which deals rows evenly."""
        of = words.value.get
        for batch in slices(batches, 4000):
            held: dict[bytes, list[int]] = {}
            rows, known, sums = batch.column("row").to_pylist(), [], []
            for row, raw in zip(rows, texts_as_bytes(batch), strict=True):
                own = space_words(raw)
                own.append(END)
                values = list(map(of, own))
                others = [w for w, v in zip(own, values, strict=True) if v is None]
                for w in others:
                    if w in held:
                        held[w].append(row)
                    else:
                        held[w] = [row]
                known.append(len(own) - len(others))
                sums.append(math.fsum(filter(None, values)))
            none = [None] * len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*held, *(b" %d" % r for r in rows)], pa.binary()), pa.array([*held.values(), *([r] for r in rows)], pa.list_(pa.int64())), pa.array(none + known, pa.int64()), pa.array(none + sums, pa.float64())],
                names=["word", "rows", "hot_known", "hot_base"],
            )

    costs = gram_costs(keyed, model)  # with all columns, so that both groupings by pack share one shuffle
    measured = keyed.groupBy("pack").cogroup(costs.groupBy("pack")).applyInArrow(measure, "doc_id long, row long, n_bytes long, n_tokens long, bits double")
    measured = measured.groupBy("doc_id", "row").agg(*[F.first(c).alias(c) for c in ("n_bytes", "n_tokens", "bits")], F.count("*").alias("times"))
    postings = keyed.select("row", "text").mapInArrow(base, "word binary, rows array<long>, hot_known long, hot_base double")
    valued = postings.join(counts.where(F.col("n") < least), "word", "left").select(
        F.explode("rows").alias("row"), F.coalesce("hot_base", F.log10(F.coalesce("n", F.lit(0)) + 0.1) - below).alias("value"), F.coalesce("hot_known", F.col("n").isNotNull().cast("long")).alias("known")
    )
    sums = valued.groupBy("row").agg(F.sum("value").alias("base"), F.sum("known").alias("known"))
    out = measured.join(sums, "row", "left").withColumn("each", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(  # a repeated row's words were added up with each repetition
        "doc_id", "n_tokens", (F.col("known") / F.col("times")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("times")).alias("base_score"), (-F.col("bits") * math.log10(2)).alias("score"), (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: one row per document; rows with remainder 0 are held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, docs.where(crc_mod("doc_id", FOLDS) != 0))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


ORACLE_SQL = None
