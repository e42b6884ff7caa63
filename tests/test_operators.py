"""What SQL can't compare: rules case by case, invariants of models, statistics against known values, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import sets, text
from quillgraph.operators import classify, clusters, explain, graph, kge, metrics, sampling, topics
from quillgraph.operators import triples as tr
from quillgraph.plans import registry
from quillgraph.sources import files
from quillgraph.streaming import documents as stream


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def tokens(spark, tagged):
    rows = [tuple(t.rsplit("/", 1)) for t in tagged.split()]
    return spark.createDataFrame([(rows,)], "tokens array<struct<word:string,tag:string>>")


@pytest.mark.parametrize(
    ("tagged", "want"),
    [
        ("red/JJ car/NN stops/VBZ", [("car", "has_property", "red"), ("car", "has_property", "red")]),
        ("president/NN Lincoln/NNP", [("president", "is_instance_of", "Lincoln")]),
        ("price/NN of/IN oil/NN", [("price", "part_of", "oil")]),
        ("station/NN In/IN Paris/NNP", [("station", "located_In", "Paris")]),
        ("big/JJ old/JJ house/NN", [("house", "has_property", "old"), ("house", "has_property", "old"), ("house", "has_property", "big")]),
        ("house/NN big/JJ old/JJ", [("house", "has_property", "big"), ("house", "has_property", "old")]),
        ("quickly/RB", []),
    ],
)
def test_generators(spark, tagged, want):
    got = tr.generate(tokens(spark, tagged)).orderBy("triple_seq").collect()
    assert [(r.subject, r.relation, r.object) for r in got] == want


@pytest.mark.parametrize(
    ("triple", "tagged", "rule", "pos"),
    [
        (("car", "part_of", "oil"), "car/NN oil/NN", None, "predicate tag"),
        (("c", "part_of", "oil"), "c/NN oil/NN", "too short", "predicate tag"),
        (("runs", "part_of", "oil"), "runs/VBZ oil/NN", "subject tags", "subject tag"),
        (("being", "is", "oil"), "being/VB oil/NN", "subject tags", None),
        (("car", "located_under", "oil"), "car/NN oil/NN", "relation tags", "predicate tag"),
        (("thing", "part_of", "oil"), "thing/NN oil/NN", "blacklisted word", "predicate tag"),
        (("Oil", "part_of", "oil"), "Oil/NN oil/NN", "subject equals object", "predicate tag"),
        (("oil", "is", "oil"), "oil/NN", "relation tags", "equal parts"),
        (("", "is", "oil"), "oil/NN", "too short", "empty part"),
        (("a**b", "is", "oil"), "oil/NN", "subject tags", "strange marks"),
        (("car", "The", "oil"), "car/NN oil/NN", "relation tags", "article as relation"),
        (("of to", "is", "oil"), "of/IN to/TO oil/NN", "subject tags", "subject without content"),
        (("the", "part_of", "the oil"), "the/NN oil/NN", "only stopwords", "predicate tag"),
    ],
)
def test_validators(spark, triple, tagged, rule, pos):
    df = tokens(spark, tagged).withColumns({n: F.lit(v) for n, v in zip(("subject", "relation", "object"), triple, strict=True)})
    args = [F.col(c) for c in ("subject", "relation", "object", "tokens")]
    got = df.select(tr.rule_reason(*args).alias("rule"), tr.pos_reason(*args).alias("pos")).first()
    assert (got.rule, got.pos) == (rule, pos)


def test_accepted_sequence(spark):
    rows = [(1, 1, "a", "r", "b"), (1, 2, "a", "r", "c"), (1, 3, "c", "r", "d"), (1, 4, "c", "q", "e"), (1, 5, "f", "r", "d"), (1, 6, "f", "r", "g"), (1, 7, "f x", "r y", "g z")]
    df = spark.createDataFrame(rows, "g int, triple_seq int, subject string, relation string, object string")
    assert [r.triple_seq for r in tr.accept_sequence(df, "g").orderBy("triple_seq").collect()] == [3, 6]


def test_maximal(spark):
    rows = [(1, 1, "red car", "is", "fast"), (1, 2, "car", "is", "fast"), (1, 3, "Car red", "is", "fast"), (2, 1, "car", "is", "fast")]
    df = spark.createDataFrame(rows, "g int, triple_seq int, subject string, relation string, object string")
    assert sorted((r.g, r.triple_seq) for r in tr.maximal(df, "g").collect()) == [(1, 1), (2, 1)]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, text.remove_markup(t), t="upright=1.2\nCategory: x\nA [12] thumb|20px b\n") == "A   b\n"
    assert one(spark, text.strip_formatting(t), t="See http://a.b/c, OK!") == "see http:abc ok"
    assert one(spark, text.strip_formatting(t, urls_first=True), t="See http://a.b/c OK!") == "see  ok"
    assert one(spark, text.normalise_predicate(t), t="can be running") == "running"
    assert one(spark, text.normalise_predicate(t), t="has been") == "has been"
    assert one(spark, text.normalise_sentence(t), t="It's here,they don't") == "It is here they do not"
    assert one(spark, text.last_segment(t), t="http://a/b#c") == "c" and one(spark, text.last_segment(t), t="http://a/b") == "b"
    assert one(spark, text.casefold(t), t="STRAßE") == "strasse"
    assert one(spark, text.drop_punctuation(t), t="a.b!c") == "abc"
    answer = one(spark, text.json_answer(t), t='{"explanation": "x", "coherence": 4')
    assert (answer.explanation, answer.coherence, answer.relevance) == ("x", 4, None)
    assert one(spark, text.json_answer(t), t="no json") is None
    assert one(spark, text.json_answer(t), t='say {"coherence": 2} ok').coherence == 2


def test_sets(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "B", "c"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    r = df.select(sets.shared_ignoring_case(a, b).alias("s"), sets.strict_superset(sets.folded(b), sets.folded(a)).alias("sup"), sets.strict_superset(a, a).alias("same")).first()
    assert (r.s, r.sup, r.same) == (["a", "B"], True, False)


def test_statistics():
    assert metrics.t_quantile(0.975, 9) == pytest.approx(2.2621571627982, abs=1e-8)
    assert sampling.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert sampling.chi_square_p(30.0, 3) == pytest.approx(1.3800570312932553e-06, rel=1e-6)
    assert sampling.ks_p(0.3, 50, 60) == pytest.approx(0.01475, abs=1e-3)
    assert metrics.wilcoxon([1, 2, 3, 4, 5], [2, 4, 6, 8, 10]) == (0, 0.0625)
    assert metrics.wilcoxon([1], [1, 2]) is None and metrics.wilcoxon([1.0], [1.0]) is None


def test_capacity_scaling(spark):
    vectors = spark.createDataFrame([("a", [2.0]), ("b", [2.0]), ("c", [2.0])], "entity string, vec array<double>")
    freq = spark.createDataFrame([("a", 8), ("b", 2)], "entity string, freq long")
    got = {r.entity: (r.scale, r.vec[0]) for r in graph.scaled(vectors, freq).collect()}
    assert got["a"] == (1.0, 2.0) and got["b"] == (0.5, 1.0) and got["c"][0] == pytest.approx((1 / 8) ** 0.5)


def test_ranks_share_equal_places(spark):
    scored = spark.createDataFrame([(1, 0, 0.5, True), (1, 1, 0.5, False), (1, 2, 0.9, False), (1, 3, 0.8, False)], "query int, candidate int, score double, is_truth boolean")
    known = spark.createDataFrame([(1, 2), (1, 0)], "query int, candidate int")
    assert metrics.filtered_ranks(scored, known).first()["rank"] == 2.5


def test_types_and_terms(spark):
    uris = spark.createDataFrame([("u",), ("v",), ("w",)], "uri string")
    local = spark.createDataFrame([("u", "B"), ("u", "A")], "uri string, type string")
    remote = spark.createDataFrame([("u", "X"), ("v", "Y")], "uri string, type string")
    assert {r.uri: r.types for r in graph.types_of(uris, local, remote).collect()} == {"u": ["A", "B"], "v": ["Y"], "w": []}
    own = spark.createDataFrame([("C", "p", "1"), ("p", "rdfs:label", "P")], "s string, p string, o string")
    assert [(r.value, r.label, r.comment) for r in graph.describe_term(own, "c").collect()] == [("1", "P", None)]


def test_embeddings_learn():
    triples = np.array([[i, 0, (i + 1) % 12] for i in range(12)] + [[i, 1, (i + 6) % 12] for i in range(12)])
    for kind in kge.MODELS:
        model, losses = kge.train(triples, 12, 2, {"model": kind, "dim": 8, "rate": 0.1, "epochs": 150}, batch=24)
        assert losses[-1] < 0.6 * losses[0], kind
        assert kge.filtered_metrics(model, triples, triples)["mrr"] > 0.4, kind


def test_embedding_gradients():
    for kind in kge.MODELS:
        model = kge.Model(kind, 4, 2, 3)
        h, r, t = np.array([0]), np.array([1]), np.array([2])
        of = lambda: float(model.score(model.p["e"][h], model.p["r"][r], model.p["e"][t])[0])  # noqa: E731, B023
        before, got = of(), {}

        def seen(name, grad, rate, rows=slice(None)):
            full = np.zeros_like(model.p[name])  # noqa: B023
            full[rows] = grad
            got[name] = full  # noqa: B023

        model._apply = seen
        model.step(h, r, t, np.ones(1), 0.1)
        for name, grad in got.items():
            for at in zip(*np.nonzero(np.abs(grad) > 1e-9), strict=True):
                model.p[name][at] += 1e-6
                assert (of() - before) / 1e-6 == pytest.approx(grad[at], abs=1e-3), (kind, name)
                model.p[name][at] -= 1e-6


def test_ward_and_silhouette():
    points = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [5, 20]])
    tree = clusters.ward(points)
    assert tree[0, :2].tolist() == [0, 1] and tree[0, 2] == 1 and (np.diff(tree[:, 2]) >= -1e-12).all()
    assert clusters.cut_tree(tree, 5, 3).tolist() == [0, 0, 1, 1, 2]
    own = clusters.silhouettes(points, np.array([0, 0, 1, 1, 2]))
    assert own[4] == 0 and own[0] == pytest.approx(1 - 1 / ((10 + 101**0.5) / 2))
    assert clusters.spectral(np.kron(np.eye(2), np.ones((3, 3))) + 0.01, 2).tolist() in ([0, 0, 0, 1, 1, 1], [1, 1, 1, 0, 0, 0])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_model_queries(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name.startswith("clusters"):
        assert got["silhouette"].between(-1, 1).all() and (got.groupby("topic")["cluster"].nunique() == got.groupby("topic")["best_k"].first()).all()
    if name == "kge_train":
        assert (got["last_loss"] < got["first_loss"]).all() and set(got["model"]) == set(kge.MODELS)
    if name == "explanations":
        assert (got["coherence"] == explain.FALLBACK).all() and got["explanation"].str.contains("groups").all()
    if name == "classifier_cv":
        assert 0 < got["ci_low"][0] <= got["mean"][0] <= 1


def test_grid_priors():
    assert [c["grid_id"] for c in topics.grid([2, 3], ["asymmetric"], [0.5, "symmetric"])] == [0, 1, 2, 3]
    own = topics._prior("asymmetric", 4)
    assert sum(own) == pytest.approx(1) and own == sorted(own, reverse=True)
    assert callable(classify.linear)


def test_sliding_window_coherence(spark):
    docs = [["a", "b", "x", "a", "c"], ["c"], [], ["b", "b", "a"]]
    terms = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "zz")], "topic int, rank int, term string")
    got = topics.c_v(terms, spark.createDataFrame([(d,) for d in docs], "tokens array<string>"), width=2)
    windows = [set(d[i : i + 2]) for d in docs for i in range(max(1, len(d) - 1))]
    p = lambda *w: sum(set(w) <= x for x in windows) / len(windows)
    info = lambda x, y: np.log((p(x, y) + 1e-12) / max(p(x) * p(y), 1e-12)) / -np.log(p(x, y) + 1e-12)
    v = np.array([[info(x, y) for y in "ab"] for x in "ab"])
    whole = v.sum(0)
    assert got[0] == pytest.approx(np.mean(v @ whole / (np.linalg.norm(v, axis=1) * np.linalg.norm(whole))))
    assert got[1] == pytest.approx(0.5)  # a term that never occurs agrees with nothing


def test_files(spark, tmp_path):
    corpus = spark.createDataFrame([("One; two\nthree \"x\"", "a"), ("", "b")], "text string, category string")
    files.write_corpus(corpus, f"{tmp_path}/corpus")
    back = files.read_corpus(spark, f"{tmp_path}/corpus", "text string, category string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, corpus.collect()))
    triples = spark.createDataFrame([("a", "r", "b, c", 3, 0)], "subject string, relation string, object string, new_topic int, old_index long")
    triples.write.csv(f"{tmp_path}/triples", header=True)
    assert tuple(files.read_triples(spark, f"{tmp_path}/triples").first()) == ("a", "r", "b, c", "3", 0)
    (tmp_path / "papers.json").write_text('{"abstract": " A b ", "categories": "cs.CL math.CO", "versions": [{"v": "1"}]}\n{"abstract": "x", "versions": []}\nbad\n')
    assert [tuple(r) for r in files.read_abstracts(spark, f"{tmp_path}/papers.json").collect()] == [("A b", "cs")]
    (tmp_path / "o.nt").write_text('<http://x/A> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://x/B> .\n<http://x/A> <http://www.w3.org/2000/01/rdf-schema#label> "The A"@en .\n# no\n')
    assert sorted(tuple(r) for r in files.read_ontology(spark, f"{tmp_path}/o.nt").collect()) == [("http://x/A", "rdfs:label", "The A"), ("http://x/A", "rdfs:subClassOf", "http://x/B")]
    lists = spark.createDataFrame([("[{'subject': 'a', 'relation': 'r', 'object': 'b'}]",)], "t string").select(files.parse_triple_list("t").alias("t"))
    assert lists.first().t[0].object == "b"
    assert files.read_results(spark, f"{tmp_path}/none", "a int").count() == 0
    vectors = spark.createDataFrame([(0, "a", [1.0, 2.0])], "id long, entity string, vec array<float>")
    assert files.write_vectors(vectors, f"{tmp_path}/vec", "transe").first().embedding_dim == 2
    assert files.read_vectors(spark, f"{tmp_path}/vec").count() == 1
    assert one(spark, F.col("t"), t="x") == "x"
    assert files.with_text(spark.createDataFrame([(" ", "n")], "text string, news string")).first().text == "n"


def test_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    query = stream.triples_to(stream.read(spark, f"{tmp_path}/in", "doc_id long, text string"), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == tr.extract(docs).count() > 0
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{tmp_path}/events")
    events = stream.read(spark, f"{tmp_path}/events", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    counts = stream.event_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.sql("select sum(n) s from counts").first().s == spark.read.parquet(f"{sf_dir}/events.parquet").count()
