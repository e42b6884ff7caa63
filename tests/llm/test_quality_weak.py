import random
import re
from collections import Counter

import numpy as np

from quillgraph.llm import quality_weak as q


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_match_brute_force(spark, sf_dir):
    rng = random.Random(8)
    made = ["".join(rng.choices(["a", "b ", " c", "\n", "é", "#", "a b c", " ", "|", "\x1c"], k=rng.randrange(0, 60))) for _ in range(1500)]
    for text in made + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]:
        assert q.statistics(text.encode())[:5] == brute(text), repr(text[:90])


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.7
    true_good, true_bad = np.array([0.9, 0.8, 0.7, 0.95, 0.6]), np.array([0.85, 0.7, 0.9, 0.6, 0.8])
    right = rng.random((20000, 5)) < np.where(good[:, None], true_good, true_bad)
    votes = np.where(right == good[:, None], 1, -1) * (rng.random((20000, 5)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.LabelModel(5).fit(patterns, counts, 2000)
    assert abs(model.prior - 0.7) < 0.05
    assert np.abs(model.accuracy - np.array([true_bad, true_good])).max() < 0.08
    assert ((model.log_odds(votes) >= 0) == good).mean() > 0.85


def test_verdicts_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = q.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    got = got[~got.base_failed]
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert got[got.quality == 1].kept.mean() > 0.98


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 60), (4, " ".join(f"word{i}" for i in range(80)))], "doc_id long, text string")
    got = q.judge(q.measure(docs))[0].collect()
    assert [(r.n_words, r.base_failed) for r in got] == [(0, True), (0, True), (60, True), (80, False)]
    assert not any(r.kept for r in got[:3])
    assert q.judge(q.measure(docs.limit(0)))[0].count() == 0
