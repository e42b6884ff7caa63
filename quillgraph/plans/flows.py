"""The four flows end to end: enrich documents, extract triples, classify them by topic, explain topics.

Linguistic parts are functions of columns (``Providers``); the defaults are rules and identities that stand in for
trained models and services.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import classify, cluster_rounds, explain, graph, kge, kge_blocks, metrics, parsing, sampling, search, spectral_rounds, topics
from ..operators import quota as quota_fill
from ..operators import triples as tr
from ..operators import vocabulary as vo
from ..session import cut, stored


def proper_runs(value: Column) -> Column:
    """Runs of capitalised words, in lower case: the default for named entities. Ordinals, numbers and times never match."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"), F.lit(0)), F.lower)))


@dataclass(frozen=True)
class Providers:
    coreference: Callable[[Column], Column] = lambda c: c
    entities: Callable[[Column], Column] = proper_runs
    svo: Callable[[Column], Column] = rules.nearest_svo
    #: Phrases (with tokens) to phrases with other tags; and to phrases with ``svo``, in place of the function of tokens.
    tagger: Callable[[DataFrame], DataFrame] | None = None
    parser: Callable[[DataFrame], DataFrame] | None = None
    explanation: Callable[[Column, Column], Column] = explain.explain


DEFAULT = Providers()


def trained_tags(tokens: DataFrame) -> DataFrame:
    """tokens and codes by the trained tagger: a word has the tag of its first place in the phrase."""
    rows = parsing.parse(tokens, name="_parsed")
    own = F.transform("_parsed", lambda t: t["word"])
    first = F.transform(F.array_distinct(own), lambda w: F.struct(w.alias("word"), F.get("_parsed", F.array_position(own, w).cast("int") - 1)["tag"].alias("tag")))
    return rows.withColumn("tokens", first).withColumn("codes", tr.codes(F.col("tokens"))).drop("_parsed")


def trained_parser(tokens: DataFrame) -> DataFrame:
    """svo by the trained parser."""
    return parsing.parse(tokens, name="_parsed").withColumn("svo", parsing.svo(F.col("_parsed"))).drop("_parsed")


def enrich(docs: DataFrame, providers: Providers = DEFAULT) -> DataFrame:
    """docs with text_coref, text_clean and entities."""
    resolved = F.coalesce(providers.coreference(F.col("text")), F.col("text"))
    return docs.withColumn("text_coref", resolved).withColumns({"text_clean": text.strip_formatting(text.remove_markup(F.col("text_coref"))), "entities": providers.entities(F.col("text_coref"))})


def assign_topics(docs: DataFrame, k: int = 4, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """docs with topic, and the top terms of each topic."""
    tokens = cut(vo.content_tokens(docs.select("doc_id", "text")))
    features, vocabulary = topics.bag_of_words(tokens)
    features = cut(features)
    model = topics.fit(features, {"k": k, "alpha": "symmetric", "eta": "symmetric"}, iterations)
    return docs.join(topics.document_topics(model, features).select("doc_id", "topic"), "doc_id", "left"), topics.top_terms(model, vocabulary)


def triples_only(docs: DataFrame, providers: Providers = DEFAULT) -> DataFrame:
    """doc_id, phrase_id, triples (array): parsed ones first, or the patterns' alone where a phrase has none; then the patterns in order."""
    tokens = tr.phrase_tokens(docs)
    if providers.tagger:
        tokens = providers.tagger(tokens)
    tokens = providers.parser(tokens) if providers.parser else tokens.withColumn("svo", providers.svo(F.col("tokens")))
    own = "array<struct<subject:string,relation:string,object:string>>"
    parsed = F.filter(F.col("svo").cast(own), lambda t: tr.rule_reason(t["subject"], t["relation"], t["object"], F.col("tokens")).isNull())
    made = F.concat(*[g(F.col("tokens"), F.col("codes")) for g in tr.GENERATORS.values()])
    patterns = F.transform(F.filter(made, lambda t: tr.generated_reason(lambda c: t[c]).isNull()), lambda t: F.struct(t["subject"].alias("subject"), t["relation"].alias("relation"), t["object"].alias("object")))
    return tokens.withColumn("triples", F.concat(parsed, patterns)).drop("tokens", "codes", "phrase", "svo").where(F.size("triples") > 0)


def with_topics(docs: DataFrame, assigned: DataFrame, providers: Providers = DEFAULT) -> DataFrame:
    return add_topics(triples_only(docs, providers), assigned)


def add_topics(triples: DataFrame, assigned: DataFrame) -> DataFrame:
    """Triples with the topic of their document; columns that both have come from ``assigned``."""
    shared = [c for c in assigned.columns if c in triples.columns and c != "doc_id"]
    return triples.drop(*shared).join(assigned, "doc_id", "left")


def exploded(lists: DataFrame) -> DataFrame:
    """One row a triple."""
    return lists.select("*", F.posexplode("triples").alias("triple_seq", "t")).select("*", "t.*").drop("triples", "t")


def classify_triples(triples: DataFrame, configs: list[dict] | None = None, alpha: float | None = 0.5, k: int = 3) -> dict[str, DataFrame]:
    """Embeds the graph, scales by frequency, and classifies each triple's topic (label) by its ends.

    The configuration with the best test MRR is taken; triples is subject, relation, object, label (from 0).
    """
    unique = triples.select("subject", "relation", "object").distinct().withColumn("key", F.concat_ws("|", "subject", "relation", "object"))
    trained = kge_blocks.train_all(cut(sampling.split_graph(unique, "key")), configs or kge.configurations(dims=(8,), epochs=10))
    best = kge.best_by(trained.results, "test_mrr").first()["config"]
    vectors = trained.vectors.where(F.col("config") == best).select("entity", "vec")
    if alpha is not None:
        vectors = graph.scaled(vectors, graph.entity_frequency(triples), alpha).select("entity", "vec")
    vectors = cut(vectors)
    width = vectors.select(F.size("vec")).first()[0]
    rows = graph.pair_features(triples.withColumn("key", F.concat_ws("|", "subject", "relation", "object", "label")), vectors, width).dropDuplicates(["key"])
    folds = classify.cross_validate(rows.select("key", "label", "features"), "key", k)
    return {"embeddings": trained.results, "folds": folds, "summary": metrics.fold_summary(folds, "accuracy", k)}


def classify_by_auc(triples: DataFrame, configs: list[dict], alpha: float | None = 0.5, draws: list[dict] | None = None, k: int = 10, judge: dict = search.JUDGE) -> dict[str, DataFrame]:
    """As classify_triples, but the embedding is the one whose classifier has the largest AUC, the classifier is searched among draws, and the final fit is reported.

    triples: subject, relation, object, label (from 0). With alpha, vectors are scaled by frequency first, and the ranks before and after are told.
    """
    unique = triples.select("subject", "relation", "object").distinct().withColumn("key", F.concat_ws("|", "subject", "relation", "object"))
    trained = kge_blocks.train_all(cut(sampling.split_graph(unique, "key")), configs)
    out, vectors = {"embeddings": trained.results}, trained.vectors
    if alpha is not None:
        out["scaling"], out["scaling_summary"], vectors = kge_blocks.scaling_impact(trained, graph.entity_frequency(triples), alpha)
    keyed = triples.withColumn("key", F.concat_ws("|", "subject", "relation", "object", "label")).dropDuplicates(["key"])
    features = {c["config"]: graph.pair_features(keyed, vectors.where(F.col("config") == c["config"]).select("entity", "vec"), kge.width_of(c["model"], c["dim"])) for c in configs}
    out["choice"] = search.by_auc(features, "key", judge)
    best = out["choice"].where("best").first()
    if best is None:
        raise ValueError("no embedding gave an AUC")
    rows = stored(features[best.config].select("key", "label", "features"))
    train = sampling.split(rows, "label", "key", 0.2).where("split = 'train'")
    out["search"] = search.search(train, "key", draws or search.draws(search.SPACE, 20))
    return out | search.final(rows, "key", search.winner(out["search"]), k)


def explain_topics(terms: DataFrame, method: str = "hierarchical", providers: Providers = DEFAULT) -> dict[str, DataFrame]:
    """terms (topic, term, vec) to clusters, explanations and their summary; topics of fewer than three terms are one cluster."""
    found = cut((cluster_rounds if method == "hierarchical" else spectral_rounds).cluster_terms(terms))
    told = explain.explanations(found, providers.explanation)
    return {"clusters": found, "explanations": told, "summary": explain.summary(told)}


def compare_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """Scores of common topics in two summaries, their differences, and which has more better ones."""
    scores = ("avg_coherence", "avg_relevance", "avg_coverage")
    side = lambda df, p: df.select("topic", *[F.col(s).alias(f"{p}_{s}") for s in scores])
    both = side(a, "a").join(side(b, "b"), "topic")
    more = lambda x, y: sum((F.when(F.col(f"{x}_{s}") > F.col(f"{y}_{s}"), 1).otherwise(0) for s in scores), F.lit(0))
    out = both.withColumns({f"diff_{s}": F.col(f"b_{s}") - F.col(f"a_{s}") for s in scores})
    return out.withColumn("winner", F.when(more("b", "a") > more("a", "b"), "b").when(more("b", "a") < more("a", "b"), "a").otherwise("tie"))


def expand_vocabulary(terms: DataFrame, types: DataFrame) -> DataFrame:
    """term, expansion: the term and, of its types (term, type, vec), the one most like it (terms: term, vec)."""
    typed = types.select("term", "type", F.col("vec").alias("type_vec")).join(terms.select("term", "vec"), "term")
    best = typed.groupBy("term").agg(F.max_by("type", F.struct(metrics.cosine(F.col("vec"), F.col("type_vec")), "type")).alias("type"))
    own = terms.select("term", F.lower("term").alias("expansion"))
    return own.union(best.where("type is not null").select("term", rules.lemma(F.col("type")))).distinct()


def expand_synonyms(terms: DataFrame, synonyms: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """term with its synonyms and hypernyms (term, value tables), sorted; empty where there are none."""
    gather = lambda t, n: t.groupBy("term").agg(F.array_sort(F.collect_set("value")).alias(n))
    empty = F.array().cast("array<string>")
    out = terms.join(gather(synonyms, "synonyms"), "term", "left").join(gather(hypernyms, "hypernyms"), "term", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("synonyms", "hypernyms")})


def project(vectors: DataFrame) -> DataFrame:
    """vectors (.., vec) with x and y: the first two principal components, in place of a neighbour embedding."""
    rows = vectors.withColumn("v", array_to_vector(F.col("vec").cast("array<double>")))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return out.withColumns({"x": F.get("p", F.lit(0)), "y": F.get("p", F.lit(1))}).drop("v", "p")


def merge_categories(docs: DataFrame, mapping: DataFrame, quota: int) -> DataFrame:
    """docs (doc_id, categories array) with the first mapped category that isn't full, in doc_id order; others go. See operators.quota."""
    codes = docs.select("doc_id", F.posexplode("categories").alias("place", "code")).join(mapping, "code")  # mapping: code, category
    return docs.join(quota_fill.fill(codes, quota), "doc_id")
