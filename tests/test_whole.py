"""Queries over whole tables, by brute force."""

import hashlib

from quillgraph.functions import text
from quillgraph.plans import registry


def test_predicate_normalise_takes_the_text(spark, tmp_path):
    long = "it can be " + "running fast " * 400
    rows = [(1, long + "to the end"), (2, long + "to the edge"), (3, "has been"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in registry.queries()["predicate_normalise"](spark, str(tmp_path)).collect()}

    def brute(t):
        words = [w for w in t.split(" ") if w and w.lower() not in text.MODALS]
        kept = [w for w in words if w.lower() not in text.AUXILIARIES]
        return hashlib.md5(" ".join(kept or words).encode()).hexdigest()

    assert got == {d: t and brute(t) for d, t in rows} and got[1] != got[2]


SF = "/root/testdata/sf0.001"


def test_every_row_of_the_table_takes_part(spark):
    rows = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    run = lambda name: registry.queries()[name](spark, SF)
    customers, vectors = rows("customer").collect(), rows("embeddings").collect()
    nation = {r.n_nationkey: r.n_regionkey for r in rows("nation").collect()}
    want = {("c%d" % r.c_custkey, x, d) for r in customers for x, d in (("n%d" % r.c_nationkey, 1), ("r%d" % nation[r.c_nationkey], 2), ("world", 3))}
    got = {tuple(r) for r in run("ontology_hierarchy").collect()}
    assert {r for r in got if r[0][0] == "c"} == want

    known = {(r.c_custkey, (r.c_nationkey + d) % 25) for r in customers for d in (1, 2)}
    ranks = []
    for r in customers:
        score = {n: (r.c_custkey * 7 + n * 13) % 25 for n in nation}
        left = [n for n in nation if n != r.c_nationkey and (r.c_custkey, n) not in known]
        own = score[r.c_nationkey]
        ranks.append(1 + sum(score[n] > own for n in left) + 0.5 * sum(score[n] == own for n in left))
    got = run("filtered_rank_metrics").first()
    assert abs(got.mrr - sum(1 / x for x in ranks) / len(ranks)) < 1e-5 and abs(got.hits10 - sum(x <= 10 for x in ranks) / len(ranks)) < 1e-5

    assert run("silhouette").count() == len(vectors) and run("cluster_top_terms").count() == 30
    assert run("clusters_hierarchical").select("topic").distinct().count() == len({r.label for r in vectors})
    assert run("clusters_hierarchical").count() == len(vectors)
    assert run("umass_coherence").count() == rows("documents").select("source").distinct().count()
    graph = registry.model_queries._graph(spark, SF)
    assert graph.where("relation = 'has_property'").count() > 0


def test_documents_meet_all_items_they_share_words_with(spark, tmp_path):
    spark.createDataFrame([(1, "The cat sat"), (2, "A dog")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "CAT the"), (99, "dog cat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in registry.queries()["case_insensitive_sets"](spark, str(tmp_path)).collect()}
    assert got == {(1, 7, 2, True), (1, 99, 1, False), (2, 99, 1, False)}
