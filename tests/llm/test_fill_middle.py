import hashlib
import re

import numpy as np
import pyarrow as pa
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, rate=50, spm_rate=80):
    text = text or ""
    g = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(g[8 * i : 8 * i + 8], 16) for i in range(4))
    k = TOKEN.findall(text)
    a, b = sorted((h1 % (len(k) + 1), h2 % (len(k) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(k), "plain", None, None, text
    p, m, s = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    if h4 % 100 < spm_rate:
        return len(k), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(k), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def run(texts, keys, rate=50, spm_rate=80):
    made = fm.kernel(pa.array(texts, pa.string()), keys, 42, rate, spm_rate)
    return list(zip(*(made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("a é\t\n\x0b\x0c\r\x1c\x85\u2028<PSM>漢😀"), max_size=12), min_size=1, max_size=8))
def test_kernel_matches_brute_force(texts):
    keys = list(range(len(texts)))
    for rate, spm_rate in ((100, 50), (50, 80)):
        assert run(texts, keys, rate, spm_rate) == [brute(k, t, rate, spm_rate) for k, t in zip(keys, texts, strict=True)]


def test_markers_do_not_span_texts():
    texts = ["a <", "P> b", "<P", ">", "x<M>", "<S>"]
    assert [r[1] != "plain" for r in run(texts, [1] * 6, 100)] == [True] * 4 + [False] * 2


def test_sliced_arrays_and_offsets():
    whole = pa.array(["zz", "é a", None, " b  c ", "", "\t"])
    part = whole.slice(1, 4).fill_null("")
    offsets, data = fm.buffers(part)
    assert bytes(data).decode() == "é a b  c " and offsets.tolist() == [0, 4, 4, 10, 10]
    starts = fm.token_starts(offsets, data)
    assert np.flatnonzero(starts).tolist() == [0, 2, 4, 6, 9]


def test_cases(spark):
    long = ("word é " * 100_000).strip()
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "a b c d e f", "x", 5), (3, "a b c d e f", "x", 5), (4, long, "x", 5), (None, "q r s", "x", 5), (7, "<P> a", "x", 5), (8, " \n ", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form string, n_words long")
    made = fm.transform(docs, rate=100)
    assert made.columns == ["doc_id", "text", "n_words", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fm.restored(made["output"], made["form"])).collect()
    want = sorted(((r[0] or 0, *brute(r[0], r[1], 100)) for r in rows), key=str)
    assert sorted(((r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert all(r.back == (r.text or "") and r.n_words == 5 for r in got)
    assert fm.transform(docs.limit(0)).count() == 0


def test_rates(spark, sf_dir):
    made = fm.query(spark, sf_dir).groupBy("form").count().collect()
    share = {r.form: r["count"] for r in made}
    assert share["spm"] > 2 * share["psm"] > 0 and 0.3 < share["plain"] / sum(share.values()) < 0.7


def test_matches_sql(spark, sf_dir):
    assert difference(fm.query(spark, sf_dir), connect(sf_dir), fm.ORACLE_SQL) is None
