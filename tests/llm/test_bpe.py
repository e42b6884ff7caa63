import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import bpe, bpe_stream, token_prefix

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n", "  lead  and\n trail \n", "It's we'll THEY'RE 'tis I'd", "a<|endoftext|> b <|startoftext|>c", "Straße ΑΣ Σ İx é é ñ 日本語 🙂🙂", "x\x1cy \x1d z", "tab\tand\r\nnew", "12345 ½ ② 1a2b", "no break wide   x",
    "a" * 3000, "the" * 700, " " * 500, "=" * 999 + "-" * 400, "ab" * 900 + "é" * 300, "!!!???...,,,", "'" * 50, "don''t  's",
]


def more(n=300):
    rng = random.Random(3)
    parts = ["th", "er", "ing", " ", "  ", "\n", "é", "'s", "'", "1", "!", "Q", "Z", "\t", "ß", "<|", ".", "tion", "<|endoftext|>"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def all_texts(spark, sf_dir):
    return TEXTS + more() + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_byte_ids_and_round_trip(all_texts):
    t = Tokenizer.from_file(BYTE)
    for text in all_texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        got, decoded = bpe_stream.encode_text(text or "", BYTE)
        assert got == ",".join(map(str, ids)), repr((text or "")[:80])
        assert decoded == t.decode(ids, skip_special_tokens=False)
        assert bpe_stream.decode(ids, BYTE) == decoded
    rows = bpe_stream.Pieces(BYTE, 500).of([text or "" for text in all_texts])  # together, with a table that is soon full
    for text, parts in zip(all_texts, rows, strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert bpe_stream._digests(parts)[:2] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())


def test_word_counts(all_texts):
    t = Tokenizer.from_file(WORD)
    for text in all_texts:
        assert token_prefix.count_text(text or "", WORD) == len(t.encode(text or "", add_special_tokens=False).ids), repr((text or "")[:80])


def test_prefix_table_is_exact():
    t = Tokenizer.from_file(WORD)
    for text in ["It's the thousandth CAFÉ, ok?", "ab<|endoftext|> cd", "日本 straße 12"]:
        own = token_prefix.PrefixTable(text, WORD)
        for i in range(len(own.text) + 1):
            if not 2 < i < 15 or "<|" not in text:
                assert own.counts[i] == len(t.encode(own.text[:i], add_special_tokens=False).ids)
        assert own.truncate(10**6) == own.text and own.truncate(0).strip() == ""
        assert len(t.encode(own.truncate(3), add_special_tokens=False).ids) <= 3


def test_stream_is_the_same_in_any_pieces_and_keeps_a_bounded_window():
    m = bpe.load(BYTE)
    for text in ["ab" * 2000, "e" * 5000, "étionthe" * 500, "=-" * 1500 + "_" * 900]:
        raw = text.encode()
        whole = [m.ids[x] for x in m.merged(list(m.symbols(raw)))] if len(raw) < 6000 else None
        for size in (1, 7, 1000):
            stream, out, widest = bpe.Transducer(m), [], 0
            for i in range(0, len(raw), size):
                out += stream.feed(raw[i : i + size])
                widest = max(widest, len(stream.window))
            out += stream.finish()
            assert whole is None or out == whole
            assert widest < 8 * m.longest


def test_queries(spark, sf_dir):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "A b")], "doc_id long, text string")
    got = bpe_stream.encode(docs, BYTE, digests=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in got][:2] == [(0, empty)] * 2 and got[2].n_tokens == 2
    assert bpe_stream.encode(docs.limit(0), BYTE).count() == 0
    q8, q9 = token_prefix.query(spark, sf_dir), bpe_stream.query(spark, sf_dir)
    assert q8.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and q9.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert q8.where("over_limit").count() == q8.where("n_tokens > 2048").count()
    assert q9.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_ids_of_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "the the"), (3, "")], "doc_id long, text string")
    want = Tokenizer.from_file(BYTE).encode("the the", add_special_tokens=False).ids
    assert [(r.n_tokens, r.ids) for r in bpe_stream.encode(docs, BYTE).collect()] == [(0, []), (2, want), (0, [])]


def small_merges(tmp_path, rng, symbols="abc", n=12):
    """A file with random merges over a few letters, each made of tokens there are."""
    import json

    tokens, merges = list(symbols), []
    while len(merges) < n:
        pair = (rng.choice(tokens), rng.choice(tokens))
        if "".join(pair) not in tokens:
            merges.append(" ".join(pair))
            tokens.append("".join(pair))
    path = tmp_path / f"{rng.random()}.json"
    path.write_text(json.dumps({"model": {"merges": merges, "vocab": {t: i for i, t in enumerate(tokens)}}, "added_tokens": []}))
    return bpe.Merges(str(path))


def ends(tokens):
    out, at = set(), 0
    for t in tokens:
        at += len(t)
        out.add(at)
    return out


def test_lookahead_settles_boundaries(tmp_path):
    rng = random.Random(11)
    for _ in range(40):
        m = small_merges(tmp_path, rng)
        for _ in range(30):
            text = "".join(rng.choices("abc", k=60))
            full = ends(m.merged(list(text)))
            for n in range(m.lookahead, 60):
                settled = {e for e in ends(m.merged(list(text[:n]))) if e <= n - m.lookahead}
                assert settled == {e for e in full if e <= n - m.lookahead}


def test_neighbours_are_judged_as_the_merges_do(tmp_path):
    rng = random.Random(12)
    for _ in range(40):
        m = small_merges(tmp_path, rng)
        for a in m.whole:
            for b in m.whole:
                assert m.valid(a, b) == (m.merged(list(a + b)) == [a, b])


def test_every_pretoken_goes_through_the_transducer(all_texts):
    of = bpe_stream.Pieces(BYTE)
    distinct = {p for t in all_texts for part in of.pattern.split(t or "") if part not in of.special for p in bpe_stream.PRETOKEN.findall(part)}
    for parts in of.of([t or "" for t in all_texts]):
        bpe_stream._digests(parts)
    assert of.stream.fed >= len(distinct)


def test_very_long_texts_in_segments():
    t = Tokenizer.from_file(BYTE)
    rng = random.Random(4)
    words = ["the", "thé", "a\nb", " ", "  ", "\n\n", "x,", "12", "\t", "don't", "<|endoftext|>", "=" * 300]
    for text in [" ".join(rng.choices(words, k=60_000)), "a" * 300_000, " " * 200_000 + "x"]:
        want = t.encode(text, add_special_tokens=False).ids
        (parts,) = bpe_stream.Pieces(BYTE).of([text])
        n, ids, back = bpe_stream._digests(parts)
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert back == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_results_replace_columns_of_their_name_and_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, n_tokens long, IDS2 string")
    got = bpe_stream.stage(spark, docs, "")
    assert got.columns == ["doc_id", "text", "IDS2", "n_tokens", "ids", "n_ids"]
    assert [(r.n_tokens, len(r.ids), r.IDS2) for r in got.collect()] == [(2, 2, "x")]
    assert bpe_stream.stage(spark, docs.limit(0), "").count() == 0
    assert token_prefix.count(docs.limit(0), WORD).count() == 0


def test_new_pretokens_are_encoded_together(all_texts, monkeypatch):
    m = bpe.load(BYTE)
    found = sorted({p for t in all_texts[:400] for p in bpe_stream.PRETOKEN.findall(t or "")} | {"\ud800", " \udfff!", "é" * 16, "é" * 17, "x" * 33})
    one = bpe.Transducer(m)
    want = [one.encode(p) for p in found]
    together = bpe.Transducer(m)
    together.TOGETHER = 500
    assert together.encode_all(found) == want and together.fed == len(found)
    together.PAIR_BITS = 4  # judged pairs soon lose their places
    del together._judged
    assert together.encode_all(found[::-1]) == want[::-1] and together.encode_all([]) == []
    monkeypatch.setattr(bpe.Transducer, "encode", None)  # short ones must not go one by one
    of = bpe_stream.Pieces(BYTE)
    of.fill({p for p in found if len(p) <= 8})
    assert [of[p] for p in found if len(p) <= 8] == [",".join(map(str, ids)) for p, ids in zip(found, want, strict=True) if len(p) <= 8]


def test_random_merges_together(tmp_path):
    rng = random.Random(13)
    for _ in range(20):
        m = small_merges(tmp_path, rng)
        some = ["".join(rng.choices("abc", k=rng.randrange(1, 33))) for _ in range(80)]
        assert bpe.Transducer(m).encode_all(some) == [[m.ids[x] for x in m.merged(list(s))] for s in some]
