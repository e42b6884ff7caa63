"""The flows end to end on small tables, and the older rules case by case."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import rules
from quillgraph.operators import triples as tr
from quillgraph.plans import flows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").where("doc_id < 60")


def tagged(spark, text, **parts):
    rows = [tuple(t.rsplit("/", 1)) for t in text.split()]
    df = spark.createDataFrame([(rows,)], "tokens array<struct<word:string,tag:string>>")
    return df.withColumns({k: F.lit(v) for k, v in parts.items()})


def test_rules(spark):
    t = F.col("tokens")
    df = tagged(spark, "dogs/NNS chase/VBP cats/NNS near/IN Rome/NNP", s="dogs", r="chase near", o="cats")
    s, r, o = F.col("s"), F.col("r"), F.col("o")
    vocabulary = F.array(F.lit("cats"))
    row = df.select(
        rules.valid_sentence(t).alias("sentence"), rules.verb_noun_preposition(t).alias("vni"), rules.verb_then_preposition(r, t).alias("vp"), rules.valid_predicate(r, t).alias("pred"),
        rules.is_candidate(s, r, o, t, vocabulary).alias("cand"), rules.is_candidate(s, r, o, t, F.array(F.lit("x"))).alias("no"), rules.normalised(s, F.lit("can chase"), o, t).alias("norm"),
        rules.named(F.lit("rome"), F.array(F.lit("rome"), F.lit("Old Rome"))).alias("named"), rules.nearest_svo(t).alias("svo"), rules.equivalent(F.lit("Cities"), F.lit("city")).alias("same"),
        rules.type_names(F.lit("DBpedia:Food,Wikidata:Q123,plain,x:y")).alias("types"), rules.admissible_terms(F.array(F.lit("1a"), F.lit("b"), F.lit("b"))).alias("terms"),
        rules.is_present(F.lit("dogs"), F.array(F.lit("dog"))).alias("present"),
    ).first()
    assert (row.sentence, row.vni, row.vp, row.pred, row.cand, row.no) == (False, 1, True, True, True, False)
    assert tuple(row.norm) == ("dogs", "chase", "cats") and row.named == "Old Rome" and row.same and row.present
    assert [tuple(x) for x in row.svo] == [("dogs", "chase", "cats")]
    assert row.types == ["food"] and row.terms == ["b"]


def test_enrich_and_extract(spark, docs):
    rich = flows.enrich(docs)
    assert rich.where("text_clean is not null and size(entities) > 0").count() > 30
    lists = flows.triples_only(docs)
    rows = flows.exploded(lists)
    patterns = tr.extract(docs)
    assert rows.count() >= patterns.count() > 0
    topics = docs.select("doc_id", F.col("source").alias("topic"))
    assert flows.with_topics(docs, topics).where("topic is null").count() == 0
    again = flows.add_topics(flows.add_topics(rows, topics), topics.withColumn("topic", F.lit("new")))
    assert [r.topic for r in again.select("topic").distinct().collect()] == ["new"]


def test_topics(spark, docs):
    assigned, terms = flows.assign_topics(docs, k=2, iterations=3)
    assert assigned.count() == docs.count() and set(r.topic for r in terms.select("topic").distinct().collect()) == {0, 1}


def test_classify(spark):
    rows = [(f"s{i % 6}", "r" if i % 2 else "q", f"o{i % 5}", i % 2) for i in range(60)]
    triples = spark.createDataFrame(rows, "subject string, relation string, object string, label int")
    out = flows.classify_triples(triples, [{"config": 0, "model": "distmult", "dim": 4, "rate": 0.1, "epochs": 3}], k=2)
    summary = out["summary"].first()
    assert 0 <= summary["mean"] <= 1 and out["folds"].count() == 2 and out["embeddings"].count() == 1


def test_explain(spark):
    terms = spark.createDataFrame([(t, f"w{i}", [float(i % 2), float(i // 3), 1.0]) for t in ("a", "b") for i in range(8)] + [("c", "only", [1.0, 0.0, 0.0])], "topic string, term string, vec array<double>")
    one, two = (flows.explain_topics(terms, m) for m in ("hierarchical", "spectral"))
    assert one["summary"].count() == 3 and one["clusters"].where("topic = 'c'").first().best_k == 1
    assert [r.winner for r in flows.compare_methods(one["summary"], two["summary"]).collect()] == ["tie"] * 3
    types = spark.createDataFrame([("w0", "t1", [0.0, 0.0, 1.0]), ("w0", "t2", [1.0, 0.0, 0.0])], "term string, type string, vec array<double>")
    own = flows.expand_vocabulary(terms.where("topic = 'a'").select("term", "vec"), types)
    assert sorted(r.expansion for r in own.where("term = 'w0'").collect()) == ["t1", "w0"]
    words = spark.createDataFrame([("a",), ("b",)], "term string")
    syn = spark.createDataFrame([("a", "z"), ("a", "y")], "term string, value string")
    assert [(r.synonyms, r.hypernyms) for r in flows.expand_synonyms(words, syn, syn.limit(0)).orderBy("term").collect()] == [(["y", "z"], []), ([], [])]
    assert flows.project(terms).columns[-2:] == ["x", "y"]


def test_categories_fill_in_order(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "y"]), (3, ["y"]), (4, ["x"]), (5, ["n"])], "doc_id long, categories array<string>")
    mapping = spark.createDataFrame([("x", "X"), ("y", "Y")], "code string, category string")
    assert sorted((r.doc_id, r.category) for r in flows.merge_categories(docs, mapping, 1).collect()) == [(1, "X"), (2, "Y")]
