import itertools
import random
import re
import time

import numpy as np

from quillgraph.llm import crf, pii_crf


def plain_base(text):
    """The contract's patterns with re alone."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = d[-1::-2]
        even = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii_crf.BASE.index(s[2])))


def test_base_matches_the_patterns(spark, sf_dir):
    rng = random.Random(4)
    pieces = ["a", "@", ".", "-", "b.c", "1", "25", "255.", "300", "+", " ", "(", ")", "4111 1111 1111 1111", "é", "_%", "+1 (555) 555-1234", "x@y.z", "1.2.3.4", "00000000001.2.3.4"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(4000)]
    for text in made + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]:
        assert pii_crf.base_spans(text) == plain_base(text), text


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    k = len(crf.LABELS)
    field = pii_crf.model()
    rows = rng.normal(size=(9, k)) * 4
    numbers = [np.array([1, 2, 3, 4], np.int32), np.array([5], np.int32), np.array([6, 7, 8], np.int32)]
    for own, path in zip(numbers, field.decode(numbers, rows), strict=True):
        s = rows[own]
        score = lambda p: crf.START[p[0]] + sum(s[i, y] for i, y in enumerate(p)) + sum(field.transition[a, b] for a, b in itertools.pairwise(p))  # noqa: E731, B023
        assert np.isclose(score(path), max(score(p) for p in itertools.product(range(k), repeat=len(own))))


def test_pieces_give_the_path_of_the_whole_text():
    field, rng = pii_crf.model(), random.Random(8)
    for _ in range(150):
        table = pii_crf.labelled_table(4, seed=rng.randrange(10**6))
        text = " ".join(" ".join(["wort"] * rng.randrange(0, 40)) + " " + t for t, _ in table) + " end" * rng.randrange(0, 30)
        tokens = [m.span() for m in crf.TOKEN.finditer(text)]
        shapes = ["", *[crf.token_shape(text[a:b]) for a, b in tokens], ""]
        scores = crf.Scores(field)
        (path,) = field.decode([scores.of(shapes)], np.array(scores.rows))
        whole = []
        for t, y in enumerate(path.tolist()):
            name = crf.LABELS[y]
            if name[0] == "B":
                whole.append([tokens[t][0], tokens[t][1], name[2:]])
            elif name[0] == "I":
                whole[-1][1] = tokens[t][1]
        want = [(*pii_crf.trimmed(text, a, b, k), k) for a, b, k in whole]
        assert pii_crf.crf_spans([text], field) == [[s for s in want if s[0] < s[1]]]


def test_long_texts_take_time_in_proportion():
    field = pii_crf.model()
    for text in ["1" * 1_000_000, "1." * 300_000, "a@" * 200_000, "9 " * 200_000, "+1 " * 200_000, "1-" * 300_000, "x" * 1_000_000]:
        began = time.process_time()
        pii_crf.all_spans([text, "short 1.2.3.4"], field)
        assert time.process_time() - began < 60


def test_recall_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    found = planted = 0
    for text, (_, every) in zip(texts, pii_crf.all_spans(texts, pii_crf.model()), strict=True):
        for m in re.finditer(r"(?<![0-9A-Fa-f])(?:[0-9]{16}|[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Fa-f])|[\w.]+@\w+(?:\.\w+)+|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", text):
            planted += 1
            found += any(a <= m.start() and m.end() <= b for a, b, _ in every)
    assert planted > 30 and found >= 0.9 * planted


def test_kinds_beyond_the_base():
    field = pii_crf.model()
    for text, value in [("his SSN 123-45-6789 there", "123-45-6789"), ("ab ghp_abcdEFGHijklMNOPqrstUVWXyzabCDEFghij cd", "ghp_abcdEFGHijklMNOPqrstUVWXyzabCDEFghij"), ("the password: hunter27x is", "hunter27x")]:
        ((_, every),) = pii_crf.all_spans([text], field)
        assert [text[a:b] for a, b, _ in every] == [value]


def test_trained_field_on_rows_it_has_not_seen():
    table = pii_crf.labelled_table(200, seed=99)
    got = pii_crf.crf_spans([t for t, _ in table], pii_crf.model())
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, table, strict=True))
    assert right / sum(len(s) for _, s in table) > 0.9
    assert right / sum(map(len, got)) > 0.9


def test_added_spans():
    field = pii_crf.model()
    secret = 'un token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" est'
    ((base, every),) = pii_crf.all_spans([secret], field)
    assert base == [] and [(secret[a:b], k) for a, b, k in every] == [("2321bac4d15ec8f90433955bf9d3cf61da5bdd1e", "secret")]
    clean = "In 1999 there were 12 of 300 (see Version 2.0.) at 10:30, $5 or 7%."
    assert pii_crf.all_spans([clean, "", "no signs"], field) == [([], [])] * 3
    assert pii_crf.masked("ab 1.2.3.4 c", [(3, 10, "ip")]) == "ab [ip] c"


def test_columns_pass_whatever_their_names(spark):
    rows = [(1, "mail a@b.cd", "s", 3, "i"), (2, None, "s", 4, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Spans string, n_spans long, base_sha256 string")
    got = pii_crf.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert [(r.text, r.Spans, r.n_spans) for r in got.collect()] == [("mail [email]", "s", 3), (None, "s", 4)]
    assert pii_crf.stage(spark, docs.limit(0), "").count() == 0


def test_query(spark, sf_dir):
    docs = spark.createDataFrame([(1, None), (None, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string")
    assert [(r.n_email, r.spans) for r in pii_crf.find(docs).collect()] == [(0, ""), (1, "email:0:6"), (1, "email:0:6")]
    assert [r.text for r in pii_crf.mask(docs).collect()] == [None, "[email]", "[email]"]
    assert pii_crf.find(docs.limit(0)).count() == 0
    got = pii_crf.query(spark, sf_dir)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"] and got.where("spans != ''").count() > 0
