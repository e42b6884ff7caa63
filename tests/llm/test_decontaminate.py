import random

from compare import connect, difference

from quillgraph.llm import decontaminate as d
from quillgraph.llm.common import alnum_words


def rows(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ß1", "the"]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([25, 10, 11, 9, 1, 0, 40])] + [("none", None), ("again", None)]
    items[-1] = ("again", items[0][1].upper())
    docs = [(None, "x"), (1, None), (2, ""), (3, "...\n")]
    for k in range(40):
        words = rng.choices(vocabulary[:29], k=rng.randrange(0, 80))
        own = (rng.choice(items)[1] or "").split()
        at, a = rng.randrange(len(words) + 1), rng.randrange(len(own) + 1)
        docs.append((10 + k, "-".join(words[:at] + own[a : a + rng.choice([9, 10, 15, 99])] + words[at:])))
    docs.append((10, docs[-1][1]))
    return docs, items


def brute_force(words, items, window=d.WINDOW):
    """The contract read literally: hit words and items."""
    hit, names = set(), set()
    for item, own in items:
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    names.update([item] if item is not None else [])
    return len(hit), sorted(names)


def test_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    items.append((None, items[6][1]))
    items.append((None, "only w1 w2 here once w3 w4 w5 w6 w7"))
    docs.append((77, "x only w1 w2 here once w3 w4 w5 w6 w7 y"))
    own = [(i, alnum_words((t or "").encode())) for i, t in items]
    for index_bytes, chunk in ((1 << 20, 4000), (20_000, 4000), (9_000, 3)):
        monkeypatch.setattr(d, "CHUNK", chunk)
        got = d.mark(rows(spark, docs), rows(spark, items, "item_id string, text string"), index_bytes=index_bytes)
        got = got.select("doc_id", "text", "n_words", d.hit_count().alias("n_hit"), "item_ids").collect()
        assert len(got) == len(docs)
        for r in got:
            words = alnum_words((r.text or "").encode())
            assert (r.n_hit, r.item_ids) == brute_force(words, own)
            assert r.n_words == len(words)
    assert any(r.doc_id == 77 and r.n_hit == 10 and r.item_ids == [] for r in got)


def test_prefixes_are_the_rarest_shingles_of_the_documents(spark):
    docs = rows(spark, [(1, "a b c d " * 5 + "b c x"), (2, "b c b c")])
    index = d.Index([("i", 4, b"a b c d")], 10)
    seen = d.frequencies(docs, "text", index)
    assert seen == {b"a b": 5, b"b c": 8, b"c d": 5}
    assert list(index.order(seen).prefixes) == [b"a b"]


def test_chunks_hold_every_window():
    words = [b"%d" % i for i in range(50)]
    for chunk in (1, 7, 41, 100):
        found = {tuple(p[i : i + 10]) for p in d.chunks_of(words, 10, chunk) for i in range(len(p) - 9)}
        assert found == {tuple(words[i : i + 10]) for i in range(41)}
    assert list(d.chunks_of(words[:4], 10)) == [words[:4]] and list(d.chunks_of([], 10)) == []


def test_empty_tables_and_clashing_columns(spark):
    docs = rows(spark, [(1, "a b", "x")], "doc_id long, text string, hit_runs string")
    none = rows(spark, [], "item_id long, text string")
    assert [(r.n_words, r.hit_runs) for r in d.mark(docs, none).collect()] == [(2, [])]
    assert d.mark(docs.limit(0), none).count() == 0


def test_stage_keeps_columns_whose_names_clash(spark, tmp_path):
    rows(spark, [(1, "w1 w2 w3 w4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = "z " * 200_000
    data = [(1, "a b c d W1 w2-w3 w4 e", 7, "h", "i"), (2, None, 8, "h", "i"), (3, long + "w1 w2 w3 w4", 9, "h", "i"), (4, "w1 w2 w3 w4 x", 1, "h", "i")]
    docs = rows(spark, data + data[:1], "doc_id long, text string, N_words long, hit_runs string, item_ids string")
    got = d.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    got = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.N_words, r.hit_runs, r.item_ids) for r in got] == [(1, 7, "h", "i")] * 2 + [(2, 8, "h", "i"), (3, 9, "h", "i")]
    assert got[0].text == "a b c d  e" and got[3].text == long
    assert d.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stage_is_the_same_with_several_indexes(spark, tmp_path, monkeypatch):
    docs, items = fixture()
    rows(spark, items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = rows(spark, docs)
    one = sorted(d.stage(spark, own, str(tmp_path)).collect(), key=str)
    monkeypatch.setattr(d, "INDEX_BYTES", 4_000)
    monkeypatch.setattr(d.mark, "__defaults__", ("text", 10, 4_000, d.NAMES))
    assert sorted(d.stage(spark, own, str(tmp_path)).collect(), key=str) == one and len(one) < len(docs)


def test_excise_keeps_the_rest():
    assert d.excise("Ab c-D é, f!", [1, 3]) == "Ab  é, f!"


def test_query(spark, sf_dir):
    got = d.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got.where("contaminated").count() > 0


def test_matches_sql(spark, sf_dir):
    assert difference(d.query(spark, sf_dir), connect(sf_dir), d.ORACLE_SQL) is None
