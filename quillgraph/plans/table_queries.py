"""Queries over samples, metrics, graph features and embeddings, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, metrics, pair_blocks, patterns, sampling
from ..operators import vocabulary as vo
from ..session import stored
from ..sources import sparse
from .common import entry, table
from .text_queries import VALID, docs, valid_triples

ROUND = 6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at six places, so that sums in another order compare equal."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, ROUND) for c in names})


# --- samples and splits ----------------------------------------------------------------------------------------


@entry("with c as (select source, count(*) as n from documents group by source) select source, n, round(n / sum(n) over (), 6) as share, round(sum(n) over (order by source) / sum(n) over (), 6) as cum_share from c")
def topic_share(spark, sf_dir):
    return rounded(sampling.shares(docs(spark, sf_dir, "source"), "source"))


_draw = "row_number() over (partition by {0} order by md5('42-' || doc_id), doc_id)"


@entry(f"""with r as (select doc_id, lang, {_draw.format('lang')} as draw, count(*) over (partition by lang) as n, count(*) over () as total from documents)
select doc_id, lang from r where draw <= least(greatest(1, floor(n * least(1.0::double, 100.0::double / total))), n)""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(docs(spark, sf_dir, "doc_id", "lang"), "lang", "doc_id", 100)


@entry(f"""with r as (select doc_id, lang, {_draw.format('lang')} as draw, count(*) over (partition by lang) as n, count(*) over () as total from documents),
s as (select * from r where draw <= least(greatest(1, floor(n * least(1.0::double, 100.0::double / total))), n)),
b as (select lang, count(*) as n_a from documents group by lang), c as (select lang, count(*) as n_b from s group by lang),
j as (select lang, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b from b full outer join c using (lang)),
p as (select *, n_a / sum(n_a) over () as p, n_b / sum(n_b) over () as q, n_a / sum(n_a) over () * sum(n_b) over () as e from j),
d as (select *, abs(sum(p) over (order by lang) - sum(q) over (order by lang)) as d, abs(p - q) * 100 as gap from p),
o as (select round(sum(case when e > 0 then (n_b - e) * (n_b - e) / e end), 6) as chi2, count(*) - 1 as df, round(max(d), 6) as ks, round(max(gap), 6) as max_dev, round(avg(gap), 6) as mean_dev, round(sqrt(avg(gap * gap)), 6) as rmse from d)
select *, case when max_dev < 2 then 'excellent' when max_dev < 5 then 'good' else 'poor' end as quality from o""")
def sample_validation(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang")
    return rounded(sampling.validate(d, sampling.stratified(d, "lang", "doc_id", 100), "lang"))


@entry(f"""with c as (select lang, count(*) as n from documents group by lang), q as (select lang, n, round_even(n * 90.0::double / sum(n) over (), 0)::bigint as quota from c),
f as (select lang, quota + case when row_number() over (order by n desc, lang) = 1 then 90 - sum(quota) over () else 0 end as quota from q),
r as (select doc_id, lang, {_draw.format('lang')} as draw from documents) select lang, doc_id from r join f using (lang) where draw <= quota""")
def proportional_quota(spark, sf_dir):
    return sampling.proportional(docs(spark, sf_dir, "doc_id", "lang"), "lang", "doc_id", 90)


@entry("with c as (select source, count(*) as n from documents group by source order by n desc, source limit 5) select source, n, (row_number() over (order by n desc, source) - 1)::int as class_id from c")
def topk_classes(spark, sf_dir):
    return sampling.top_classes(docs(spark, sf_dir, "source"), "source", 5)


@entry(f"select doc_id, quality, case when {_draw.format('quality')} <= floor(count(*) over (partition by quality) * 0.2::double) then 'test' else 'train' end as split from labels")
def train_test_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "labels", "doc_id", "quality"), "quality", "doc_id")


@entry(f"select doc_id, quality, (({_draw.format('quality')} - 1) % 10)::int as fold from labels")
def kfold(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "labels", "doc_id", "quality"), "quality", "doc_id")


@entry("select source, doc_id, place::int as place from (select source, doc_id, row_number() over (partition by source order by doc_id) as place from documents) where place <= 7")
def quota_fill(spark, sf_dir):
    return sampling.fill_quota(docs(spark, sf_dir, "source", "doc_id"), "source", "doc_id", 7)


@entry("select source, (dense_rank() over (order by source) - 1)::bigint as id from (select distinct source from documents where source is not null)")
def category_mapping(spark, sf_dir):
    return graph.dense_ids(docs(spark, sf_dir, "source"), "source").withColumn("id", F.col("id").cast("long"))


@entry("select source, count(*) as n_docs, round(avg(len(regexp_extract_all(text, '\\S+'))), 6) as mean_words, max(n_chars) as longest from documents group by source")
def corpus_stats(spark, sf_dir):
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    d = docs(spark, sf_dir, "source", "text", "n_chars").groupBy("source")
    return rounded(d.agg(F.count("*").alias("n_docs"), F.avg(words).alias("mean_words"), F.max("n_chars").alias("longest")))


@entry(f"""with {VALID}, t as (select distinct subject, relation, object from valid), d as (select *, md5('42-' || subject || '|' || relation || '|' || object) as h from t),
tr as (select * from d where substr(h, 1, 8) >= '33333333'), e as (select subject as x from tr union select object from tr), r as (select distinct relation from tr)
select subject, relation, object, case when substr(h, 1, 8) < '33333333' and subject in (select x from e) and object in (select x from e) and relation in (select relation from r) then 'test' else 'train' end as split from d""")
def kg_split(spark, sf_dir):
    t = stored(valid_triples(spark, sf_dir).select("subject", "relation", "object").distinct())  # read three times
    keyed = t.withColumn("key", F.concat_ws("|", "subject", "relation", "object"))
    return sampling.split_graph(keyed, "key").select("subject", "relation", "object", "split")


# --- metrics ---------------------------------------------------------------------------------------------------

#: A stand-in classifier: the share of capitals against a threshold, so that predictions need no model.
_SCORED = """sc as (select l.doc_id, l.quality as label, round(len(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(1, length(text)), 6) as score from labels l join documents d using (doc_id)),
pr as (select *, case when score > 0.7 then 1 else 0 end as pred, case when label = 1 then score else 1 - score end as p_true from sc)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels", "doc_id", "quality").join(docs(spark, sf_dir, "doc_id", "text"), "doc_id")
    score = F.round(F.length(F.regexp_replace("text", "[^a-z]", "")) / F.greatest(F.lit(1), F.length("text")), 6)
    out = both.select("doc_id", F.col("quality").alias("label"), score.alias("score"))
    return out.withColumn("pred", (F.col("score") > 0.7).cast("int")).withColumn("p_true", F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")))


@entry(f"with {_SCORED} select label, pred, count(*) as n from pr group by all")
def confusion(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


_REPORT = f"""{_SCORED}, m as (select label, pred, count(*) as n from pr group by all), k as (select label as class from m union select pred from m),
rep as (select class, coalesce((select sum(n) from m where label = class), 0)::bigint as support, coalesce((select sum(n) from m where pred = class), 0) as predicted, coalesce((select sum(n) from m where pred = class and label = class), 0) as hit from k),
rp as (select class, support, case when predicted > 0 then hit / predicted else 0 end as precision, case when support > 0 then hit / support else 0 end as recall from rep),
r3 as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from rp)"""


@entry(f"with {_REPORT} select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from r3")
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(metrics.confusion(scored(spark, sf_dir))))


@entry(f"""with {_REPORT} select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(precision * support) / sum(support), 6) as weighted_precision,
round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(avg(case when support > 0 then 1 - recall end), 6) as mpce from r3""")
def report_averages(spark, sf_dir):
    return rounded(metrics.averages(metrics.class_report(metrics.confusion(scored(spark, sf_dir)))))


@entry(f"with {_SCORED} select round(avg((label = pred)::int), 6) as accuracy, round(avg(-ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) as log_loss from pr")
def accuracy_logloss(spark, sf_dir):
    return rounded(metrics.accuracy_log_loss(scored(spark, sf_dir), "label", "pred", "p_true"))


@entry(f"with {_SCORED}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from sc) select round((sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) as auc from r")
def auc_binary(spark, sf_dir):
    return rounded(metrics.auc(scored(spark, sf_dir), F.col("label") == 1, "score"))


@entry("""with s as (select label, unnest(range(0, 10)) as class, embedding from embeddings), x as (select label, class, round(embedding[class + 1]::double, 4) as score from s),
r as (select class, label = class as pos, rank() over (partition by class order by score) + (count(*) over (partition by class, score) - 1) / 2 as rk from x),
a as (select class, (sum(case when pos then rk end) - sum(pos::int) * (sum(pos::int) + 1) / 2) / (sum(pos::int) * (count(*) - sum(pos::int))) as auc from r group by class)
select count(auc) as n_classes, round(avg(auc), 6) as macro_auc from a""")
def auc_macro_ovr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "label", "embedding").select("label", F.posexplode(F.slice("embedding", 1, 10)).alias("class", "v"))
    own = metrics.auc(e.withColumn("score", F.round(F.col("v").cast("double"), 4)), F.col("label") == F.col("class"), "score", "class")
    return rounded(own.agg(F.count("auc").alias("n_classes"), F.avg("auc").alias("macro_auc")))


@entry(f"""with {_SCORED}, f as (select avg((label = pred)::int) as v from (select pr.*, (row_number() over (partition by label order by md5('42-' || doc_id), doc_id) - 1) % 10 as fold from pr) group by fold)
select round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(avg(v) - 2.2621571627982 * stddev_samp(v) / sqrt(count(*)), 6) as ci_low, round(avg(v) + 2.2621571627982 * stddev_samp(v) / sqrt(count(*)), 6) as ci_high from f""")
def fold_summary(spark, sf_dir):
    own = sampling.folds(scored(spark, sf_dir), "label", "doc_id").groupBy("fold").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("v"))
    return rounded(metrics.fold_summary(own, "v", 10))


_TOPIC_METRIC = "select source as topic, round(avg(quality), 6) as q, round(avg(toxic), 6) as t from labels join documents using (doc_id) where (doc_id // 20) % 2 = {0} group by source"


@entry(f"""with h as ({_TOPIC_METRIC.format(0)}), s as ({_TOPIC_METRIC.format(1)}) select topic, h.q as h_q, s.q as s_q, round(s.q - h.q, 6) as diff_q, round(s.t - h.t, 6) as diff_t,
case when (s.q > h.q)::int + (s.t > h.t)::int > (h.q > s.q)::int + (h.t > s.t)::int then 'spectral' when (s.q > h.q)::int + (s.t > h.t)::int < (h.q > s.q)::int + (h.t > s.t)::int then 'hierarchical' else 'tie' end as winner from h join s using (topic)""")
def method_comparison(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(docs(spark, sf_dir, "doc_id", "source"), "doc_id")

    def side(k: int, name: str) -> DataFrame:
        own = both.where(F.floor(F.col("doc_id") / 20) % 2 == k).groupBy(F.col("source").alias("topic"))
        return own.agg(F.round(F.avg("quality"), 6).alias(f"{name}_q"), F.round(F.avg("toxic"), 6).alias(f"{name}_t"))

    out = side(0, "h").join(side(1, "s"), "topic")
    ahead = lambda a, b: sum((F.when(F.col(f"{a}_{m}") > F.col(f"{b}_{m}"), 1).otherwise(0) for m in "qt"), F.lit(0))
    s, h = ahead("s", "h"), ahead("h", "s")
    winner = F.when(s > h, "spectral").when(s < h, "hierarchical").otherwise("tie")
    return out.select("topic", "h_q", "s_q", F.round(F.col("s_q") - F.col("h_q"), 6).alias("diff_q"), F.round(F.col("s_t") - F.col("h_t"), 6).alias("diff_t"), winner.alias("winner"))


# --- graph -----------------------------------------------------------------------------------------------------

_FREQ = f"{VALID}, fr as (select entity, count(*) as freq from (select subject as entity from valid union all select object from valid) group by entity)"


@entry(f"with {_FREQ} select entity, freq from fr")
def entity_freq(spark, sf_dir):
    return graph.entity_frequency(valid_triples(spark, sf_dir))


@entry(f"with {_FREQ} select count(*) as n, max(freq) as max, round(avg(freq), 6) as mean, median(freq)::double as median, min(freq) as min, count(*) filter (freq < 0.1 * (select max(freq) from fr)) as rare_n, round(100.0 * count(*) filter (freq < 0.1 * (select max(freq) from fr)) / count(*), 6) as rare_pct from fr")
def entity_freq_stats(spark, sf_dir):
    return rounded(graph.frequency_summary(graph.entity_frequency(valid_triples(spark, sf_dir))))


#: Embeddings stand for entities by their number; entity ids are the sorted places of the triples' entities.
_IDS = f"{_FREQ}, ids as (select entity, row_number() over (order by entity) - 1 as id, freq from fr), vx as (select coalesce(entity, 'free' || vec_id) as entity, embedding as vec, freq from embeddings left join ids on id = vec_id)"


def entity_vectors(spark: SparkSession, sf_dir: str, freq: DataFrame) -> DataFrame:
    ids = graph.dense_ids(freq, "entity")
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    named = e.join(ids, F.col("id") == F.col("vec_id"), "left")
    return named.select(F.coalesce("entity", F.concat(F.lit("free"), F.col("vec_id").cast("string"))).alias("entity"), F.col("embedding").alias("vec"))


@entry(f"with {_IDS}, s as (select entity, pow(coalesce(freq, 1) / (select max(freq) from fr), 0.5) as scale, vec from vx) select entity, round(scale, 6) as scale, round(sqrt(list_sum(list_transform(vec, lambda x: pow(x::double * scale, 2)))), 4) as norm from s")
def ces_scaling(spark, sf_dir):
    freq = stored(graph.entity_frequency(valid_triples(spark, sf_dir)))  # read twice
    out = graph.scaled(entity_vectors(spark, sf_dir, freq), freq)
    return out.select("entity", F.round("scale", 6).alias("scale"), F.round(graph.norm(F.col("vec")), 4).alias("norm"))


@entry(f"""with {_IDS}, t as (select distinct subject, relation, object from valid)
select subject, relation, object, round(coalesce(list_sum(list_transform(a.vec, lambda x: x::double)), 0), 4) as s_sum, round(coalesce(list_sum(list_transform(b.vec, lambda x: x::double)), 0), 4) as o_sum
from t left join vx a on a.entity = t.subject left join vx b on b.entity = t.object""")
def subject_object_features(spark, sf_dir):
    triples = stored(valid_triples(spark, sf_dir).select("subject", "relation", "object"))  # read twice
    vectors = entity_vectors(spark, sf_dir, graph.entity_frequency(triples))
    out = graph.pair_features(triples.select("subject", "relation", "object").distinct(), vectors, 64)
    total = lambda a, b: F.round(F.aggregate(F.slice("features", a, b), F.lit(0.0), lambda s, x: s + x), 4)
    return out.select("subject", "relation", "object", total(1, 64).alias("s_sum"), total(65, 64).alias("o_sum"))


_KG = """kg as (select c_custkey as query, c_nationkey as truth from customer), sc as (select query, n_nationkey as candidate, round((query * 7 + n_nationkey * 13) % 25 / 25.0, 6) as score, n_nationkey = truth as is_truth from kg join nation on true),
kn as (select query, (truth + 1) % 25 as candidate from kg union select query, (truth + 2) % 25 from kg), lf as (select * from sc where is_truth or not exists (select 1 from kn where kn.query = sc.query and kn.candidate = sc.candidate)),
rk as (select query, 1 + (select count(*) from lf x where x.query = t.query and x.score > t.score) + 0.5 * (select count(*) from lf x where x.query = t.query and x.score = t.score and not x.is_truth) as rank from lf t where is_truth)"""


@entry(f"with {_KG} select round(avg(1 / rank), 6) as mrr, round(avg((rank <= 1)::int), 6) as hits1, round(avg((rank <= 10)::int), 6) as hits10 from rk")
def filtered_rank_metrics(spark, sf_dir):
    kg = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("query"), F.col("c_nationkey").alias("truth"))
    nations = F.broadcast(table(spark, sf_dir, "nation", "n_nationkey"))  # 25 rows by definition of the table
    asked = kg.crossJoin(nations)  # every candidate is scored for every query: a column of 25 places, not a join of two tables that grow
    score = F.round((F.col("query") * 7 + F.col("n_nationkey") * 13) % 25 / 25.0, 6)
    all_scores = asked.select("query", F.col("n_nationkey").cast("long").alias("candidate"), score.alias("score"), (F.col("n_nationkey") == F.col("truth")).alias("is_truth"))
    known = kg.select("query", F.explode(F.array((F.col("truth") + 1) % 25, (F.col("truth") + 2) % 25)).alias("candidate")).distinct()
    return rounded(metrics.rank_metrics(metrics.filtered_ranks(all_scores, known)))


_ONTOLOGY = """o as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union select 'r' || r_regionkey, 'world' from region union select 'c' || c_custkey, 'n' || c_nationkey from customer)"""


@entry(f"with recursive {_ONTOLOGY}, up as (select child as class, parent as ancestor, 1 as depth from o union all select up.class, o.parent, depth + 1 from up join o on o.child = up.ancestor) select class, ancestor, depth from up")
def ontology_hierarchy(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    regions = table(spark, sf_dir, "region", "r_regionkey").select(name("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    return graph.ancestors(nations.union(regions).union(customers))


_TRIPLES = """g as (select 'n' || n_nationkey as s, 'rdfs:subClassOf' as p, 'r' || n_regionkey as o from nation union all select 'r' || r_regionkey, 'rdfs:subClassOf', 'world' from region
union all select 'n' || n_nationkey, 'rdf:type', 'owl:Class' from nation union all select 'r' || r_regionkey, 'rdf:type', 'owl:Class' from region
union all select 'n' || n_nationkey, 'rdfs:label', n_name from nation union all select 'r' || r_regionkey, 'rdfs:label', r_name from region
union all select 'c' || c_custkey, 'rdf:type', 'n' || c_nationkey from customer union all select 'c' || c_custkey, 'rdfs:label', c_name from customer union all select 'c' || c_custkey, 'tpch:segment', c_mktsegment from customer
union all select 's' || s_suppkey, 'tpch:seat', 'n' || s_nationkey from supplier union all select 's' || s_suppkey, 'rdfs:label', s_name from supplier
union all select 'o' || o_orderkey, 'tpch:orderedBy', 'c' || o_custkey from orders union all select 'o' || o_orderkey, 'tpch:' || lower(replace(o_orderpriority, ' ', '')), o_orderstatus from orders where o_orderpriority like '1%'
union all values ('tpch:segment', 'rdfs:range', 'word'), ('tpch:segment', 'rdfs:comment', 'what a customer buys for'), ('tpch:seat', 'rdfs:domain', 'supplier'), ('rdfs:subClassOf', 'rdfs:label', 'kind of'))"""


def _triples(spark, sf_dir):
    """The tables as triples."""

    def of(name, key, kind, p, o):
        rows = table(spark, sf_dir, name, *dict.fromkeys([key, *([o] if isinstance(o, str) else o[1:])]))
        o = F.col(o) if isinstance(o, str) else o[0]
        return rows.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("s"), F.lit(p).alias("p"), o.alias("o"))

    node = lambda kind, c: (F.concat(F.lit(kind), F.col(c).cast("string")), c)
    fixed = lambda x: (F.lit(x),)
    urgent = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").where("o_orderpriority like '1%'")
    parts = [
        of("nation", "n_nationkey", "n", "rdfs:subClassOf", node("r", "n_regionkey")), of("region", "r_regionkey", "r", "rdfs:subClassOf", fixed("world")),
        of("nation", "n_nationkey", "n", "rdf:type", fixed("owl:Class")), of("region", "r_regionkey", "r", "rdf:type", fixed("owl:Class")),
        of("nation", "n_nationkey", "n", "rdfs:label", "n_name"), of("region", "r_regionkey", "r", "rdfs:label", "r_name"),
        of("customer", "c_custkey", "c", "rdf:type", node("n", "c_nationkey")), of("customer", "c_custkey", "c", "rdfs:label", "c_name"), of("customer", "c_custkey", "c", "tpch:segment", "c_mktsegment"),
        of("supplier", "s_suppkey", "s", "tpch:seat", node("n", "s_nationkey")), of("supplier", "s_suppkey", "s", "rdfs:label", "s_name"),
        of("orders", "o_orderkey", "o", "tpch:orderedBy", node("c", "o_custkey")),
        urgent.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("s"), F.concat(F.lit("tpch:"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("")))).alias("p"), F.col("o_orderstatus").alias("o")),
        spark.createDataFrame([("tpch:segment", "rdfs:range", "word"), ("tpch:segment", "rdfs:comment", "what a customer buys for"), ("tpch:seat", "rdfs:domain", "supplier"), ("rdfs:subClassOf", "rdfs:label", "kind of")], "s string, p string, o string"),
    ]
    return reduce(DataFrame.unionByName, parts)


@entry(f"""with {_TRIPLES}, u as (select s, o as status from g where p = 'tpch:1-urgent')
select w.o as region, x.o as segment, u.status, count(*) as n, count(distinct a.o) as customers from g a join g t on t.s = a.o and t.p = 'rdf:type' join g w on w.s = t.o and w.p = 'rdfs:subClassOf'
join g x on x.s = a.o and x.p = 'tpch:segment' left join u on u.s = a.s where a.p = 'tpch:orderedBy' group by all""")
def graph_patterns(spark, sf_dir):
    """Orders of customers of nations of regions, urgent or not."""
    patterns_of_order = [("?order", "tpch:orderedBy", "?customer"), ("?customer", "rdf:type", "?nation"), ("?nation", "rdfs:subClassOf", "?region"), ("?customer", "tpch:segment", "?segment")]
    found = patterns.match(_triples(spark, sf_dir), patterns_of_order, [[("?order", "tpch:1-urgent", "?status")]])
    return found.groupBy("region", "segment", "status").agg(F.count("*").alias("n"), F.count_distinct("customer").alias("customers"))


@entry(f"""with {_TRIPLES}, t as (select lower(n_name) as term from nation union select r_name from region union select c_name from customer union select 'nowhere'),
c as (select term, min(s) as concept from t join g on p = 'rdfs:label' and lower(o) = lower(term) group by term),
e as (select c.*, p, o from c join g on s = concept), f as (
select term, concept, 'type' as kind, null as property, o as value, lower(replace(o, ':', ' ')) as normalised, null as comment, null as label, null as range, null as domain from e where p = 'rdf:type'
union all select term, concept, 'narrower', null, b.s, null, null, null, null, null from c join g b on b.p = 'rdfs:subClassOf' and b.o = concept join g k on k.s = b.s and k.p = 'rdf:type' and k.o = 'owl:Class'
union all select term, concept, 'broader', null, o, null, null, null, null, null from e where p = 'rdfs:subClassOf'
union all select term, concept, 'relation', e.p, e.o, null, d1.o, d2.o, d3.o, d4.o from e left join g d1 on d1.s = e.p and d1.p = 'rdfs:comment' left join g d2 on d2.s = e.p and d2.p = 'rdfs:label'
left join g d3 on d3.s = e.p and d3.p = 'rdfs:range' left join g d4 on d4.s = e.p and d4.p = 'rdfs:domain' where e.p not in ('rdf:type', 'rdfs:label'))
select term, 0 as ontology, concept, kind, property, value, normalised, comment, label, range, domain from f""")
def term_semantics(spark, sf_dir):
    """Concepts by label whatever its case, their types, the classes above and below, and other properties."""
    names = [table(spark, sf_dir, "nation", "n_name").select(F.lower("n_name").alias("term")), table(spark, sf_dir, "region", "r_name"), table(spark, sf_dir, "customer", "c_name")]
    return patterns.semantics(reduce(DataFrame.union, names), [_triples(spark, sf_dir)])


@entry("""with r as (select l_orderkey as doc_id, l_partkey as term, sum(l_quantity)::double as weight from lineitem group by all),
b as (select doc_id, count(*) filter (weight <> 0) as feature_count, array_to_string((list(term order by weight desc, term))[1:50], ',') as top_terms from r group by doc_id),
c as (select o_orderkey as doc_id, case o_orderstatus when 'O' then 'open' when 'F' then 'finished' when 'P' then 'in part' end as category from orders
union select o_orderkey, 'urgent' from orders where o_orderstatus || left(o_orderpriority, 1) like 'O1%'),
d as (select c.* from c semi join b using (doc_id) where category is not null qualify row_number() over (partition by category order by md5('42-' || doc_id), doc_id) <= 300)
select 'order_' || doc_id as doc_id, category, 'order_document_' || doc_id as text, doc_id as original_index, feature_count, top_terms from d join b using (doc_id)""")
def sparse_corpus(spark, sf_dir):
    """A draw of orders as rows of parts, by the beginnings of their codes (the draw is the feature)."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("long").alias("term")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    rows = lines.groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))  # an order has seven lines at most
    codes = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select(F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("code"), F.col("o_orderkey").alias("doc_id"))
    found = sparse.corpus(rows, codes, {"O": "open", "F": "finished", "P": "in part", "O1": "urgent"}, 300, label="order")
    return found.withColumn("top_terms", F.concat_ws(",", F.col("top_terms").cast("array<string>")))


# --- embeddings ------------------------------------------------------------------------------------------------

_PAIRS = "pa as (select a.vec_id as i, b.vec_id as j, a.label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)"


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label: terms are compared within a topic."""
    return pair_blocks.cosines(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"), "vec_id", "embedding", "label")


@entry(f"with {_PAIRS} select i, j, label, round(sim, 5) as sim from pa")
def similarity_pairs(spark, sf_dir):
    return label_pairs(spark, sf_dir).withColumn("sim", F.round("sim", 5))


@entry(f"with {_PAIRS}, b as (select i as term, j as type, sim from pa union all select j, i, sim from pa) select term, arg_max(type, struct_pack(s := round(sim, 5), t := type)) as type, round(max(sim), 5) as sim from b group by term")
def best_type(spark, sf_dir):
    found = pair_blocks.best_other(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"), "vec_id", "embedding", "label")
    return found.select(F.col("key").alias("term"), F.col("other").alias("type"), "sim")


_SIL = """e3 as (select vec_id, label % 3 as c, embedding::double[] as v from embeddings), ds as (select a.vec_id, a.c, b.c as c2, avg(list_distance(a.v, b.v)) as d from e3 a join e3 b on a.vec_id <> b.vec_id group by all),
ab as (select vec_id, c, min(case when c2 = c then d end) as a, min(case when c2 <> c then d end) as b from ds group by all), si as (select vec_id, c, case when a is null or b is null then 0 else (b - a) / greatest(a, b) end as s from ab)"""


def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all vectors, in three clusters."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").withColumn("c", F.col("label") % 3)
    return metrics.silhouette(e, "vec_id", "embedding", "c")


@entry(f"with {_SIL} select vec_id, c, round(s, 5) as silhouette from si")
def silhouette(spark, sf_dir):
    return silhouettes(spark, sf_dir).withColumn("silhouette", F.round("silhouette", 5))


@entry(f"with {_SIL} select c, vec_id, place::int as place from (select c, vec_id, row_number() over (partition by c order by round(s, 5) desc, vec_id) as place from si) where place <= 10")
def cluster_top_terms(spark, sf_dir):
    s = silhouettes(spark, sf_dir).withColumn("silhouette", F.round("silhouette", 5))
    return vo.top_per(s, "c", F.desc("silhouette"), "vec_id").select("c", "vec_id", "place")


@entry("with g as (select label as grid_id, round(avg(embedding[1]::double), 6) as coherence from embeddings group by label) select grid_id, coherence from g order by coherence desc, grid_id limit 3")
def best_model(spark, sf_dir):
    grid = table(spark, sf_dir, "embeddings", "label", "embedding").groupBy(F.col("label").alias("grid_id")).agg(F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 6).alias("coherence"))
    return grid.orderBy(F.desc("coherence"), "grid_id").limit(3)


@entry("select source, arg_max(doc_id, doc_id) as doc_id, arg_max(lang, doc_id) as lang, arg_max(md5(text), doc_id) as digest from documents group by source")
def last_doc_per_topic(spark, sf_dir):
    d = docs(spark, sf_dir, "source", "doc_id", "lang", "text").withColumn("order_id", F.col("doc_id"))
    last = vo.last_by(d, "source", "order_id")
    return last.select("source", "doc_id", "lang", F.md5("text").alias("digest"))


@entry(f"with {VALID}, v as (select source as topic, lower(subject) as term from valid union select source, lower(object) from valid), c as (select topic, count(*) as n from v group by topic), m as (select count(*) as n_common from (select term from v group by term having count(distinct topic) >= 2)) select topic, n, n_common from c, m")
def vocab_union(spark, sf_dir):
    t = stored(valid_triples(spark, sf_dir).select("source", "subject", "object"))  # read twice
    v = t.select(F.col("source").alias("topic"), F.lower("subject").alias("term")).union(t.select("source", F.lower("object"))).distinct()
    common = v.groupBy("term").agg(F.count("*").alias("k")).where("k >= 2").agg(F.count("*").alias("n_common"))
    return v.groupBy("topic").agg(F.count("*").alias("n")).crossJoin(F.broadcast(common))


@entry("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


