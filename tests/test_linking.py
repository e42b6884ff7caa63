import random

from quillgraph.operators import linking


def brute(text, names):
    w = [x for x in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]
    out, at = [], 0
    while at < len(w):
        size = next((n for n in range(4, 0, -1) if at + n <= len(w) and " ".join(w[at : at + n]) in names), 0)
        if size:
            out.append((at, size, names[" ".join(w[at : at + size])]))
        at += size or 1
    return out


def test_longest_match(spark, monkeypatch):
    rng = random.Random(1)
    pool = ["new", "york", "city", "hall", "of", "the", "Rome"]
    names = {" ".join(rng.choices(pool, k=n)).lower(): f"u{i}" for i, n in enumerate([1, 2, 2, 3, 3, 4, 4, 2, 3])}
    rows = [(n.upper(), u, 0.9, 5) for n, u in names.items()] + [("york", "weak", 0.1, 5), ("hall", "rare", 0.9, 1), (None, "x", 0.9, 5), ("...", "y", 0.9, 5), ("new", None, 0.9, 5)]
    first = next(iter(names))
    rows += [(first, "zz", 0.9, 4), (first, "a0", 0.5, 99)]
    docs = [(i, ", ".join(rng.choices(pool, k=rng.randrange(0, 30)))) for i in range(40)] + [(90, None), (91, "the new york " * 5000)]
    table = spark.createDataFrame(rows, "name string, uri string, confidence double, support long")
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((d, *m) for d, t in docs for m in brute(t, names))
    for limit in (200_000, 0):
        monkeypatch.setattr(linking, "BROADCAST_ROWS", limit)
        got = linking.link(texts, table, least_confidence=0.5, least_support=2).collect()
        assert sorted((r.doc_id, r.place, r.size, r.uri) for r in got) == want and len(want) > 20
    assert linking.link(texts, table.limit(0)).count() == 0 and linking.link(texts.limit(0), table).count() == 0
