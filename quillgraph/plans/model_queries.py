"""Queries that fit models; SQL can't express them, so tests check invariants (umass_coherence has SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, cluster_rounds, explain, kge, kge_blocks, metrics, parsing, quota, sampling, search, similar, spectral_rounds, topics
from ..operators import triples as tr
from ..operators import vocabulary as vo
from ..session import cut, stored
from .common import entry, table
from .text_queries import _BAG, docs, valid_triples


def _tokens(spark, sf_dir):
    return vo.content_tokens(docs(spark, sf_dir, "doc_id", "text"))


@entry()
def lda_topics(spark, sf_dir):
    features, words = topics.bag_of_words(_tokens(spark, sf_dir))
    model = topics.fit(cut(features), {"k": 4, "alpha": "asymmetric", "eta": "symmetric"}, iterations=10)
    return topics.top_terms(model, words, 10).withColumn("weight", F.round("weight", 6))


#: Passes over all documents of each model of a grid, as many as the survey's M1 has.
PASSES = 50


@entry()
def lda_grid(spark, sf_dir):
    """Every model is fitted by whole passes over all documents. The survey's whole grid (M2) has 980 models; these are four of them."""
    tokens = stored(_tokens(spark, sf_dir))
    features, words = topics.bag_of_words(tokens)
    configs = topics.grid([2, 4], [0.069, "symmetric"], [0.5])
    return topics.best(topics.search(cut(features), words, tokens, configs, iterations=PASSES, share=1.0))


@entry(f"""with {_BAG}, ct as (select source as topic, token, count(*) as n from bag join documents using (doc_id) group by all),
tm as (select topic, token, row_number() over (partition by topic order by n desc, token) as rank from ct qualify rank <= 6), us as (select distinct doc_id, token from bag),
pr as (select x.topic, x.token as a, y.token as b from tm x join tm y on x.topic = y.topic and y.rank < x.rank),
sc as (select topic, ln(((select count(*) from us u join us v using (doc_id) where u.token = a and v.token = b) + 1) / greatest(1, (select count(*) from us where token = b))) as v from pr)
select topic, round(avg(v), 6) as coherence from sc group by topic""")
def umass_coherence(spark, sf_dir):
    tokens = stored(vo.content_tokens(docs(spark, sf_dir, "doc_id", "source", "text"), "source"))
    counted = tokens.groupBy(F.col("source").alias("topic"), "token").agg(F.count("*").alias("n"))
    terms = vo.top_per(counted, "topic", F.desc("n"), "token", n=6).select("topic", F.col("place").alias("rank"), F.col("token").alias("term"))
    return topics.umass(cut(terms), tokens.select("doc_id", "token")).withColumn("coherence", F.round("coherence", 6))


@entry()
def classifier_cv(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").withColumnRenamed("embedding", "features")
    folds = classify.cross_validate(rows, "vec_id", k=3)
    return metrics.fold_summary(folds, "accuracy", 3)


def _judged(spark, sf_dir):
    """Documents with a quality label, and what their whole texts count up to."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    counts = [F.length(text), F.size(words), F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)), F.size(lines), F.size(F.array_distinct(lines)) / F.size(lines), F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / F.greatest(F.length(text), F.lit(1)), F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.length(text), F.lit(1))]
    rows = table(spark, sf_dir, "documents", "doc_id", "text").join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    return rows.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"), F.array(*[c.cast("double") for c in counts]).alias("features")).dropDuplicates(["doc_id"])


@entry()
def model_search(spark, sf_dir):
    """Three draws of small boosted trees over labelled documents, with their measures over three folds, and the winner."""
    space = search.SPACE | {"n_estimators": [5, 10], "max_depth": [3, 5]}
    return search.search(_judged(spark, sf_dir), "doc_id", search.draws(space, 3), parallel=3)


@entry("""with e as (select label, vec_id, embedding::double[] as v from embeddings), p as (select a.label, a.vec_id, b.vec_id as other, round(list_cosine_similarity(a.v, b.v), 9) as s from e a join e b on a.label = b.label and a.vec_id <> b.vec_id)
select label, vec_id, other, round(s, 6) as similarity, row_number() over (partition by label, vec_id order by s desc, other) as place from p qualify place <= 5""")
def similar_terms(spark, sf_dir):
    """The five most similar vectors of each in its label."""
    found = similar.within(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"), ["label"], 5, "vec_id", "embedding")
    return found.select("label", F.col("key").alias("vec_id"), "other", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@entry()
def parsed_triples(spark, sf_dir):
    """Relations between the nouns of a verb, by the trained parser, over all phrases."""
    phrases = tr.phrases_of(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", "phrase")
    parsed = parsing.parse(phrases.repartition(spark.sparkContext.defaultParallelism * 2))  # far more work than reading: files of a few rows too
    found = parsed.select("doc_id", F.explode(parsing.svo(F.col("parsed"))).alias("t")).select("doc_id", "t.*")
    return found.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@entry()
def category_fill(spark, sf_dir):
    """Orders by customer segment, priority and status, whichever of these isn't full first; an order's places run from the rarest kind on."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey").join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    choices = orders.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array("c_mktsegment", "o_orderpriority", "o_orderstatus")).alias("place", "category"))
    return quota.fill(choices, 100)


def _graph(spark, sf_dir):
    triples = stored(valid_triples(spark, sf_dir).select("subject", "relation", "object").distinct())  # read three times
    keyed = triples.withColumn("key", F.concat_ws("|", "subject", "relation", "object"))
    return cut(sampling.split_graph(keyed, "key").select("subject", "relation", "object", "split"))


@entry()
def kge_train(spark, sf_dir):
    """Every model over the whole graph, with filtered ranks of all test triples."""
    return kge_blocks.train_all(_graph(spark, sf_dir), kge.configurations(dims=(8,), epochs=5)).results


def _vocabularies(spark, sf_dir):
    """Vectors of a label stand for the vocabulary of a topic, all of them."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    return e.select(F.col("label").cast("string").alias("topic"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("term"), F.col("embedding").alias("vec"))


@entry()
def clusters_hierarchical(spark, sf_dir):
    return cluster_rounds.cluster_terms(_vocabularies(spark, sf_dir))


@entry()
def clusters_spectral(spark, sf_dir):
    return spectral_rounds.cluster_terms(_vocabularies(spark, sf_dir))


@entry()
def explanations(spark, sf_dir):
    return explain.explanations(clusters_hierarchical(spark, sf_dir))
