"""Steps whose work must grow no faster than the input."""

from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from quillgraph.functions import sets
from quillgraph.operators import patterns, topics, vocabulary
from quillgraph.operators import triples as tr
from quillgraph.plans import registry, table_queries, text_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_about_properties_shuffle_no_relations_by_property(spark):
    g = spark.createDataFrame([("a", "rdfs:label", "A"), *[("a", "near", f"x{i}") for i in range(20)], ("near", "rdfs:comment", "beside"), ("near", "rdfs:range", "place")], "s string, p string, o string")
    found = patterns.semantics(spark.createDataFrame([("a",)], "term string"), [g])
    assert "hashpartitioning(property" not in plan(found.where("kind = 'relation'"))
    assert {(r.value, r.comment, r.label, r.range) for r in found.collect()} == {(f"x{i}", "beside", None, "place") for i in range(20)}


def test_shared_words_shuffle_documents_and_not_pairs(spark):
    a = spark.createDataFrame([(1, ["cat", "the"]), (1, ["cat", "dog"]), (2, [])], "doc_id long, ws array<string>")
    b = spark.createDataFrame([(7, "Cat"), (7, "cat"), (8, "DOG"), (8, "owl")], "item_id long, spelled string")
    found = sets.shared_words(a, b)
    assert {tuple(r) for r in found.collect()} == {(1, 7, 2, True), (1, 8, 1, False)}
    assert "item_id" not in "".join(x for x in plan(found).split("\n") if "hashpartitioning" in x)


def test_folded_map_shuffles_no_words(spark):
    rows = spark.createDataFrame([(1, ["The", "cat", "the", "CAT", "owl"]), (1, ["OWL"]), (2, []), (3, None)], "id long, keys array<string>")
    found = sets.folded_map(rows, "id", "keys")
    assert {tuple(r) for r in found.collect()} == {(1, "The", 2), (1, "cat", 3), (1, "OWL", 4)}
    assert "low" not in "".join(x for x in plan(found).split("\n") if "hashpartitioning" in x)


def test_graph_split_extracts_once(spark, sf_dir):
    assert not any("documents" in f for f in table_queries.kg_split(spark, sf_dir).inputFiles())


def test_longer_triples_come_from_one_extraction(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(text_queries, "stored", lambda df: seen.append(df) or df)
    text_queries.superset_maximal(spark, sf_dir)
    assert plan(seen[0]).count("FileScan parquet") == 1


def test_accepted_triples_are_compared_by_words_made_once(spark):
    rows = [(1, i, f"S{i % 3} x" if i % 4 else "s1", "r", f"O{i % 5}") for i in range(30)]
    df = spark.createDataFrame(rows, "g int, triple_seq int, subject string, relation string, object string")
    words = lambda x: set(x.lower().split())
    last, want = rows[0], []
    for t in rows:
        holds = lambda a, b: all(words(y) <= words(x) for x, y in zip(a[2:], b[2:], strict=True))
        if t[2] != last[2] and t[4] != last[4] and holds(t, last) == holds(last, t):
            want.append(t[1])
            last = t
    found = tr.accept_sequence(df, "g")
    assert sorted(r.triple_seq for r in found.collect()) == want
    assert "regexp" not in found.select("triple_seq")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[0]


def test_topic_models_of_a_grid_are_judged_in_one_pass(spark, monkeypatch):
    calls, umass = [], topics.umass
    monkeypatch.setattr(topics, "umass", lambda *args: calls.append(1) or umass(*args))
    tokens = spark.createDataFrame([(d, f"w{(d * 7 + i) % 9}") for d in range(30) for i in range(6)], "doc_id long, token string")
    features, words = topics.bag_of_words(tokens)
    assert "token" not in "".join(x for x in plan(features).split("\n") if "hashpartitioning" in x)
    configs = topics.grid([2, 3], ["symmetric"], [0.5])
    found = {r.grid_id: r.coherence for r in topics.search(features, words, tokens, configs, 2).collect()}
    assert len(calls) == 1 and set(found) == {0, 1} and all(v is not None for v in found.values())
    one = topics.top_terms(topics.fit(features, configs[1], 2), words, 10)
    assert abs(umass(one, tokens).agg(F.avg("coherence")).first()[0] - found[1]) < 1e-9


def test_tokens_bring_their_topic(spark):
    docs = spark.createDataFrame([(1, "s", "Cats sit.")], "doc_id long, source string, text string")
    assert {tuple(r) for r in vocabulary.content_tokens(docs, "source").collect()} == {(1, "s", "cats"), (1, "s", "sit")}


def test_models_of_the_grid_take_whole_passes_over_all_documents(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(topics, "LDA", lambda **how: asked.append(how) or LDA(**how | {"maxIter": 1}))
    registry.queries()["lda_grid"](spark, "/root/testdata/sf0.001")
    assert len(asked) == 4 and all(how["subsamplingRate"] == 1.0 and how["maxIter"] == 50 for how in asked)
