from collections import Counter

import numpy as np

from quillgraph.llm import lang_rank


def brute(text, lists, ranks):
    """The distances, spelled out."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter(w[i : i + n] for x in words for w in [f" {x} "] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != " ")
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = [key(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))][:ranks]
    far = {}
    for name, profile in lists.items():
        place = {k: i for i, k in enumerate(profile)}
        far[name] = sum(min(abs(place[k] - i), ranks) if k in place else ranks for i, k in enumerate(own))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (ranks * len(own))


def test_distance_matches_brute_force():
    texts = {"a": "The thing is the other, that.", "b": "Der Über-Ding und die Äpfel!", "c": "x 1 yy"}
    lists = {k: lang_rank.ranked(lang_rank.ngrams(lang_rank.code_points(t))).tolist() for k, t in texts.items()}
    profiles = lang_rank.Profiles(lists)
    for text in [*texts.values(), "the und", "zz9zz", "é"]:
        got = profiles.predict(text)
        want = brute(text, lists, lang_rank.RANKS)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-12


def test_ties_and_counts():
    assert lang_rank.ranked(np.array([5, 3, 3, 5, 9], np.uint64), 2).tolist() == [3, 5]
    two = lang_rank.Profiles({"y": [97], "x": [97]})
    assert two.predict("a")[0] == "x"


def test_profiles_equal_whole_text_counts(spark):
    rows = [(i, "Ab ab-c\n é9é  zz", "x") for i in range(3)] + [(9, None, "x"), (8, "q", None)]
    profiles = lang_rank.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = lang_rank.ranked(lang_rank.ngrams(lang_rank.code_points(rows[0][1])))
    assert profiles.keys[profiles.places[0].argsort()].tolist() == own.tolist()


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "12 !", 7), (None, "abc", 7)], "doc_id long, text string, score long")
    none = lang_rank.Profiles({})
    assert [r.lang_pred for r in lang_rank.identify(docs, none).collect()] == ["und"] * 3
    got = lang_rank.identify(docs, lang_rank.Profiles({"en": [97]})).collect()
    assert [(r.lang_pred) for r in got] == ["und", "und", "en"] and got[0].score == 0.0
    assert lang_rank.identify(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null")
    known = lang_rank.query(spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(known) > 20 and sum(r.lang == r.lang_pred for r in known) > 0.95 * len(known)


def test_stage_keeps_columns_whose_names_clash(spark):
    rows = [(i, t, "x", 90 + i, "p") for i, t in enumerate(["abc abd", None, "", "12", "abc " * 40_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score long, lang_pred string")
    got = lang_rank.stage(spark, docs.union(docs), "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.Score, r.lang_pred, r.lang) for r in got.collect()) == [(i, 90 + i, "p", "x") for i in (0, 0, 4, 4)]
    assert lang_rank.stage(spark, docs.limit(0), "").count() == 0
