"""Topic models and their choice."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Topic shares below this count as 0.
LEAST_SHARE = 0.01
#: Terms that a vocabulary may have: it and the model's tables lie on the driver.
MOST_TERMS = 2_000_000


def grid(ks: list[int], alphas: list[float | str], etas: list[float | str]) -> list[dict]:
    """Configurations in order; symmetric is 1 / k for either, asymmetric falls with the topic's number."""
    return [{"grid_id": i, "k": k, "alpha": a, "eta": e} for i, (a, e, k) in enumerate(itertools.product(alphas, etas, ks))]


def _prior(value: float | str, k: int) -> list[float]:
    if value == "asymmetric":
        raw = [1 / (i + k**0.5) for i in range(k)]
        return [x / sum(raw) for x in raw]
    return [1 / k if value == "symmetric" else float(value)] * k


def bag_of_words(tokens: DataFrame, least: int = 5, most: float = 0.7) -> tuple[DataFrame, CountVectorizerModel]:
    """doc_id, features from doc_id, token rows."""
    gathered = stored(tokens.groupBy("doc_id").agg(F.collect_list("token").alias("tokens")))
    # documents' words are counted where they lie: only a word's counts are shuffled
    df = gathered.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    terms = df.count()
    if terms > MOST_TERMS:
        raise ValueError(f"{terms} terms, more than {MOST_TERMS}; prune the vocabulary first")
    model = CountVectorizer(inputCol="tokens", outputCol="features", minDF=least, maxDF=most, vocabSize=max(1, terms)).fit(gathered)
    return model.transform(gathered).select("doc_id", "features"), model


def fit(features: DataFrame, config: dict, iterations: int = 20, seed: int = 0, share: float = 0.05) -> LDAModel:
    """share: of the documents, drawn anew for each iteration; 1 for all of them."""
    k = config["k"]
    eta = 1 / k if config["eta"] == "symmetric" else float(config["eta"])
    return LDA(k=k, maxIter=iterations, optimizer="online", seed=seed, subsamplingRate=share, docConcentration=_prior(config["alpha"], k), topicConcentration=eta).fit(features)


def top_terms(model: LDAModel, words: CountVectorizerModel, n: int = 30) -> DataFrame:
    """topic, rank, term, weight."""
    vocabulary = F.array(*[F.lit(w) for w in words.vocabulary]) if len(words.vocabulary) <= 200 else None
    found = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    found = found.select("topic", "rank", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    if vocabulary is not None:
        return found.select("topic", "rank", F.get(vocabulary, F.col("i")).alias("term"), "weight")
    spark = found.sparkSession
    names = spark.createDataFrame(list(enumerate(words.vocabulary)), "i int, term string")
    return found.join(F.broadcast(names), "i").select("topic", "rank", "term", "weight")  # at most VOCABULARY rows


def document_topics(model: LDAModel, features: DataFrame) -> DataFrame:
    """doc_id, shares (small ones 0), topic: the first of the largest share."""
    out = model.transform(features).select("doc_id", vector_to_array("topicDistribution").alias("raw"))
    shares = F.transform("raw", lambda x: F.when(x < LEAST_SHARE, 0.0).otherwise(x))
    return out.select("doc_id", shares.alias("shares"), (F.array_position("raw", F.array_max("raw")) - 1).cast("int").alias("topic"))


def umass(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """topic, coherence: the mean over pairs of ln((D(a, b) + 1) / D(b)), b ranked before a. terms: topic, rank, term; tokens: doc_id, token."""
    used = tokens.join(F.broadcast(terms.select(F.col("term").alias("token")).distinct()), "token").distinct()
    single = used.groupBy("token").agg(F.count("*").alias("n"))
    pairs = terms.select("topic", F.col("rank").alias("ra"), F.col("term").alias("a")).join(terms.select("topic", F.col("rank").alias("rb"), F.col("term").alias("b")), "topic").where("rb < ra")
    wanted = pairs.select("a", "b").distinct()
    left, right = used.select("doc_id", F.col("token").alias("a")), used.select("doc_id", F.col("token").alias("b"))
    both = left.join(F.broadcast(wanted), "a").join(right, ["doc_id", "b"]).groupBy("a", "b").agg(F.count("*").alias("nab"))
    scored = pairs.join(both, ["a", "b"], "left").join(single.withColumnsRenamed({"token": "b", "n": "nb"}), "b", "left")
    value = F.log((F.coalesce("nab", F.lit(0)) + 1) / F.greatest(F.coalesce("nb", F.lit(0)), F.lit(1)))
    return scored.groupBy("topic").agg(F.avg(value).alias("coherence"))


def _window_counts(batches: Iterator[pa.RecordBatch], index: dict[str, int], width: int) -> Iterator[pa.RecordBatch]:
    total, windows = np.zeros((len(index), len(index)), np.int64), 0
    for batch in batches:
        for tokens in batch.column("tokens").to_pylist():
            places: dict[int, list[int]] = {}
            for i, t in enumerate(tokens or []):
                if t in index:
                    places.setdefault(index[t], []).append(i)
            n = max(1, len(tokens or []) - width + 1)
            windows += n
            inside = np.zeros((len(places), n + 1), np.int64)
            for row, own in enumerate(places.values()):
                for i in own:
                    inside[row, max(0, i - width + 1)] += 1
                    inside[row, min(i, n - 1) + 1] -= 1
            held = (np.cumsum(inside, axis=1)[:, :n] > 0).astype(np.int64)
            terms = np.array(list(places), np.int64)
            if len(terms):
                total[np.ix_(terms, terms)] += held @ held.T
    a, b = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(a, -1)), pa.array(np.append(b, -1)), pa.array(np.append(total[a, b], windows))], names=["a", "b", "n"])


def c_v(terms: DataFrame, docs: DataFrame, width: int = 110) -> dict[int | str, float]:
    """topic to coherence: the mean cosine of each term's vector of normalised pointwise information with the topic's, over sliding windows.

    terms: topic, rank, term, a top list for each topic, so its size and the pair counts that come back are bounded by
    it; docs: tokens in order.
    """
    lists: dict[int | str, list[str]] = {}
    for r in terms.orderBy("topic", "rank").collect():
        lists.setdefault(r.topic, []).append(r.term)
    index = {t: i for i, t in enumerate(sorted({t for own in lists.values() for t in own}))}
    counted = docs.select("tokens").mapInArrow(lambda batches: _window_counts(batches, index, width), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    n = np.zeros((len(index), len(index)))
    windows = 1
    for r in counted.collect():
        if r.a < 0:
            windows = max(1, r.n)
        else:
            n[r.a, r.b] = r.n
    tiny, p = 1e-12, n / windows
    single = np.diag(p)
    joint = p + tiny
    information = np.log(joint / np.maximum(np.outer(single, single), tiny)) / -np.log(joint)
    out = {}
    for topic, own in lists.items():
        v = information[np.ix_([index[t] for t in own], [index[t] for t in own])]
        whole = v.sum(axis=0)
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(whole)
        out[topic] = float(np.mean(np.divide(v @ whole, size, out=np.zeros(len(own)), where=size > 0)))
    return out


def best(results: DataFrame, n: int = 10) -> DataFrame:
    """The first n by coherence; equals in grid order."""
    return results.orderBy(F.desc("coherence"), "grid_id").limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("coherence"), "grid_id")))


def search(features: DataFrame, words: CountVectorizerModel, tokens: DataFrame, configs: list[dict], iterations: int = 10, share: float = 0.05) -> DataFrame:
    """grid_id, k, alpha, eta, coherence of each configuration; one model at a time, each fit on all executors, and one pass over the tokens for the terms of all."""
    spark = features.sparkSession
    lists = []
    for c in configs:
        found = top_terms(fit(features, c, iterations, share=share), words, 10)
        lists += [(f"{c['grid_id']}/{r.topic}", r["rank"], r.term) for r in found.collect()]  # ten a topic
    values = umass(spark.createDataFrame(lists, "topic string, rank int, term string"), tokens)
    values = values.groupBy(F.substring_index("topic", "/", 1).cast("int").alias("grid_id")).agg(F.avg("coherence").alias("coherence"))
    rows = [(c["grid_id"], c["k"], str(c["alpha"]), str(c["eta"])) for c in configs]
    return spark.createDataFrame(rows, "grid_id int, k int, alpha string, eta string").join(values, "grid_id", "left")
