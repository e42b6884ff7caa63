import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillgraph.llm import lm_mixing, mixing


def base_brute(rows):
    lower = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, t in rows if not held(d) for w in lower(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(lower(t)), sum(c[w] > 0 for w in lower(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(t))) for d, t in rows]


def test_base_matches_brute_force(spark, tmp_path, monkeypatch):
    docs = [r for r in map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())][:60]
    docs += [(900, None), (901, ""), (None, "a A b"), (docs[3]), (902, "never seen zzz zzz")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lm_mixing, "HOT_WORDS", 300)  # most words go by the join
    got = lm_mixing.query(spark, str(tmp_path)).collect()
    want = base_brute(docs)
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
        assert g[6] < 0


def trained(texts):
    keys, n = mixing.counted(np.concatenate([k for k, _ in mixing.windows(texts)]))
    table = np.zeros((2, mixing.SLOTS), np.int64)
    mixing.add_counts(table, keys, n)
    mixer = mixing.Mixer(*table)
    for _ in range(30):
        mixer.learn(keys, n.astype(float))
    mixer.observe(keys, n.astype(float))
    return mixer.compact()


def test_scores_are_probabilities():
    scorer = trained([b"the thing", b"another thing", "é".encode()])
    for context in (b"\0\0\0\0\0", b"e thi", b"zzzzz"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert math.isclose((2.0 ** -scorer.bits(keys)).sum(), 1, rel_tol=1e-9)


def test_text_bits_match_a_plain_loop_and_chunks_do_not_matter():
    scorer = trained([b"the thing", b"another thing"])
    texts = [b"", b"the thing again", "é x".encode() * 9]
    want = []
    for t in texts:
        padded = mixing.PAD + t + mixing.END
        want.append(sum(float(scorer.bits(np.array([int.from_bytes(padded[i : i + 6], "big")], np.uint64))[0]) for i in range(len(t) + 1)))
    assert np.allclose(scorer.text_bits(texts), want)
    whole = np.concatenate([k for k, _ in mixing.windows(texts)])
    assert (np.concatenate([k for k, _ in mixing.windows(texts, chunk=4)]) == whole).all()


def test_held_out_cost_beats_a_byte_model(spark):
    sf = "/root/testdata/sf0.01"
    got = lm_mixing.query(spark, sf).where("held_out").selectExpr("sum(-score) s").first().s / math.log10(2)
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = [t for d, t in texts if zlib.crc32(str(d).encode()) % 10 == 0]
    c = Counter(b"".join(t for d, t in texts if zlib.crc32(str(d).encode()) % 10))
    n = sum(c.values())
    unigram = sum(-math.log2((c[b] + 1) / (n + 256)) for t in held for b in t)
    assert got < 0.62 * unigram, got / unigram


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_mixing.score(docs, docs).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = lm_mixing.score(one, docs).collect()
    assert (r.n_tokens, r.n_known, r.base_score) == (3, 0, 0.0) and r.score < 0


def test_counts_are_exact_however_many_contexts():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 400_000, dtype=np.uint8))
    keys, n = mixing.counted(next(mixing.windows([text]))[0])
    assert len(keys) > 1 << mixing.SLOT_BITS  # more contexts of five bytes than a hashed table has slots
    low = np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), n, 1 << 16)
    part, padded = mixing.part_of(keys, 16), mixing.PAD + text + mixing.END
    for p in range(16):
        mine = keys[part == p]
        at = int(rng.integers(len(mine)))
        exact, gram = mixing.Exact(mine, n[part == p], low), int(mine[at]).to_bytes(6, "big")
        for order in range(1, mixing.ORDERS):
            context = gram[5 - order : 5]
            after = [m.end() for m in re.finditer(b"(?=" + re.escape(context) + b")", padded)]
            after = [padded[i + order] for i in after if 5 <= i + order < len(padded)]
            for turn in (0, 3, 7):
                zero, one = exact.counts(turn, np.array([at]))
                seen = [b >> (7 - turn) & 1 for b in after if b >> (8 - turn) == gram[5] >> (8 - turn)]
                assert (zero[order, 0], one[order, 0]) == (seen.count(0), seen.count(1))


def test_score_has_no_table_of_fixed_size(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(i, "".join(map(chr, rng.integers(97, 123, 300)))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.score for r in lm_mixing.score(df, df).collect()}
    monkeypatch.setattr(lm_mixing, "PACK_BYTES", 500)
    monkeypatch.setattr(mixing, "SLOTS", 0)  # score must not depend on a table of slots
    got = {r.doc_id: r.score for r in lm_mixing.score(df, df).collect()}
    assert all(math.isclose(got[d], want[d], rel_tol=1e-5) for d in want)


def _costs(raws, parts, value):
    """Costs of the texts' distinct grams as parts answer, out of order."""
    keys, bounds = lm_mixing._asked(raws, parts)
    some = [p for p in range(parts) if bounds[p] < bounds[p + 1]][::-1]
    return pa.table({"part": pa.array(some, pa.int32()), "costs": pa.array([value(keys[bounds[p] : bounds[p + 1]]).astype(np.float32).tobytes() for p in some], pa.binary())})


def test_grams_of_a_pack_are_sorted_once(monkeypatch):
    rng = np.random.default_rng(3)
    raws = [b"", *(bytes(rng.integers(97, 101, int(n), dtype=np.uint8)) for n in rng.integers(0, 400, 50)), b"", b"ab" * 700]
    value = lambda keys: (keys % np.uint64(1009)).astype(np.float64)
    want = [sum(value(k).sum() for k, _ in mixing.windows([r])) for r in raws]
    costs = _costs(raws, 37, value)
    distinct, sizes, argsort = len(lm_mixing._asked(raws, 37)[0]), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *rest, **more: sizes.append(len(a)) or argsort(a, *rest, **more))
    assert np.allclose(lm_mixing._text_bits(raws, costs, 37), want)
    assert max(sizes) <= distinct < sum(map(len, raws)) // 2  # never all grams, only distinct ones
    monkeypatch.setattr(mixing, "MOST_TEXTS", 7)
    monkeypatch.setattr(mixing.windows, "__defaults__", (512,))  # texts and packs in several pieces
    assert np.allclose(lm_mixing._text_bits(raws, costs, 37), want)


def test_words_of_a_text_are_looked_up_once(spark, monkeypatch):
    docs = [(1, "a b a"), (1, "a b a"), (2, None), (3, "c  c\n" * 5), (None, "A zz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (1, 3, 500_000):  # no word, some and all words are broadcast
        monkeypatch.setattr(lm_mixing, "HOT_WORDS", hot)
        scored = lm_mixing.score(df, df.where("doc_id < 3"))
        got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in scored.collect()))
        assert got == [(0, 3, 2, 9), (1, 4, 4, 9), (1, 4, 4, 9), (2, 1, 1, 9), (3, 11, 1, 9)]
        assert "hot_base" in scored._jdf.queryExecution().toString()


def test_gates_and_slopes_match_a_plain_loop():
    rng = np.random.default_rng(4)
    n = 300
    zero, one = rng.integers(0, 40, (2, mixing.ORDERS, n)).astype(np.float32) * (rng.random((2, mixing.ORDERS, n)) < 0.3)
    keys, times = rng.integers(0, 1 << 48, n, dtype=np.uint64), rng.integers(1, 9, n).astype(float)
    mixer = mixing.PartMixer(mixing.Mixer(np.empty(0), np.empty(0)).weights, None)
    mixer.turns = [(zero, one)] * 8
    want = np.zeros(n, int)
    for order in range(mixing.ORDERS):
        for i, least in enumerate(mixing.LEVELS):
            want[(zero + one)[order] >= least] = order * len(mixing.LEVELS) + i
    x, gate = mixer.inputs(keys, 0)
    assert (gate == want).all()
    weights = mixer.weights.copy()
    for turn in range(8):
        x, gate = mixer.inputs(keys, turn, True)
        error = times * (mixing.bit_of(keys, turn) - 1 / (1 + np.exp(-(weights[gate] * x.T).sum(axis=1))))
        slope, mass = np.zeros_like(weights), np.zeros(len(weights))
        for j in range(n):
            slope[gate[j]] += error[j] * x[:, j]
            mass[gate[j]] += times[j]
        weights += 0.05 * slope / np.maximum(mass, 1)[:, None]
    mixer.learn(keys, times)
    assert np.allclose(mixer.weights, weights)
