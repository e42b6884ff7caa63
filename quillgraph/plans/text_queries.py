"""Queries over text and triples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, sets, tagging, text
from ..operators import linking
from ..operators import triples as tr
from ..operators import vocabulary as vo
from ..session import stored
from .common import entry, table

# --- SQL shared by the entries -------------------------------------------------------------------------------------

#: Distinct words of each phrase in order, tagged, with the next ones. Tables: tok(doc_id, phrase_id, pos, word, tag, w1, t1, w2, t2).
TOK = f"""
split_docs as (select doc_id, source, string_split(text, '.') as ps from documents where text is not null),
phr as (select doc_id, source, unnest(ps) as phrase, unnest(range(len(ps))) as phrase_id from split_docs),
occ as (select doc_id, source, phrase_id, unnest(ws) as word, unnest(range(len(ws))) as place from
  (select doc_id, source, phrase_id, regexp_extract_all(phrase, '[\\p{{L}}\\p{{N}}]+') as ws from phr where regexp_matches(phrase, '\\S'))),
firsts as (select doc_id, source, phrase_id, word, min(place) as place from occ group by all),
tok as (select *, lead(word) over w as w1, lead(tag) over w as t1, lead(word, 2) over w as w2, lead(tag, 2) over w as t2 from
  (select *, row_number() over (partition by doc_id, phrase_id order by place) - 1 as pos, {tagging.tag_sql()} as tag from firsts)
  window w as (partition by doc_id, phrase_id order by pos))"""
NOUN = "('NN','NNS','NNP','NNPS')"
FIRST = "qualify row_number() over (partition by doc_id, phrase_id order by pos) = 1"
SPATIAL = ", ".join(f"'{x}'" for x in tr.SPATIAL)
GEN = {
    "has_property": f"select doc_id, source, phrase_id, pos, w1 as subject, 'has_property' as relation, word as object from tok where tag = 'JJ' and t1 in {NOUN} {FIRST}",
    "instance_of": f"select doc_id, source, phrase_id, pos, word as subject, 'is_instance_of' as relation, w1 as object from tok where tag in ('NN','NNS') and t1 in ('NNP','NNPS') {FIRST}",
    "part_of": f"select doc_id, source, phrase_id, pos, word as subject, 'part_of' as relation, w2 as object from tok where tag in {NOUN} and lower(w1) = 'of' and t2 in {NOUN} {FIRST}",
    "located": f"select doc_id, source, phrase_id, pos, word as subject, 'located_' || w1 as relation, w2 as object from tok where tag in {NOUN} and t1 = 'IN' and lower(w1) in ({SPATIAL}) and t2 in {NOUN} {FIRST}",
    # an adjective belongs to the noun that ends its run on either side
    "adjective_runs": f"""select a.doc_id, a.source, a.phrase_id, n.pos, n.word as subject, 'has_property' as relation, a.word as object
from (select *, pos - row_number() over (partition by doc_id, phrase_id order by pos) as run from tok where tag = 'JJ') a
join (select doc_id, phrase_id, run, min(pos) as low, max(pos) as high from (select *, pos - row_number() over (partition by doc_id, phrase_id order by pos) as run from tok where tag = 'JJ') group by all) r
  using (doc_id, phrase_id, run)
join tok n on n.doc_id = a.doc_id and n.phrase_id = a.phrase_id and n.tag in {NOUN} and (n.pos = r.low - 1 or n.pos = r.high + 1)""",
}
ALL = ", ".join(f"g_{k} as ({v})" for k, v in GEN.items())
#: All triples (bag) as raw(doc_id, source, phrase_id, subject, relation, object).
RAW = f"{TOK}, {ALL}, raw as (" + " union all ".join(f"select doc_id, source, phrase_id, subject, relation, object from g_{k}" for k in GEN) + ")"
OWN = "(select list(tag) from tok t where t.doc_id = raw.doc_id and t.phrase_id = raw.phrase_id and t.word = raw.{})"


def _in(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


REASON = f"""case when length(subject) < 2 or length(relation) < 2 or length(object) < 2 then 'too short'
when not coalesce(list_has_any(st, {_in(tr.SUBJECT_TAGS)}), false) then 'subject tags'
when not coalesce(list_has_any(ot, {_in(tr.OBJECT_TAGS)}), false) then 'object tags'
when not list_contains({_in(tr.EXEMPT)}, relation) and not coalesce(list_has_any(rt, {_in(tr.RELATION_TAGS)}), false) then 'relation tags'
when list_contains({_in(tr.STOPWORDS)}, lower(subject)) or list_contains({_in(tr.STOPWORDS)}, lower(object)) then 'only stopwords'
when list_contains({_in(tr.BLACKLIST)}, lower(subject)) or list_contains({_in(tr.BLACKLIST)}, lower(object)) then 'blacklisted word'
when lower(subject) = lower(object) then 'subject equals object' end"""
TAGGED = f"""tagged as (select raw.*, [s.tag] as st, [o.tag] as ot, [r.tag] as rt from raw
left join tok s on s.doc_id = raw.doc_id and s.phrase_id = raw.phrase_id and s.word = raw.subject
left join tok o on o.doc_id = raw.doc_id and o.phrase_id = raw.phrase_id and o.word = raw.object
left join tok r on r.doc_id = raw.doc_id and r.phrase_id = raw.phrase_id and r.word = raw.relation),
judged as (select *, {REASON} as reason from tagged), valid as (select * from judged where reason is null)"""
VALID = f"{RAW}, {TAGGED}"


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


def valid_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, phrase_id, triple_seq, subject, relation, object of all documents, by the rule validator."""
    return tr.extract(docs(spark, sf_dir, "doc_id", "source", "text"))


# --- entries -------------------------------------------------------------------------------------------------------


def _markup_sql(column: str) -> str:
    for pattern in text.MARKUP:
        column = f"regexp_replace({column}, '{pattern}', '', 'g')"
    return column


_marks = text.MARKS.replace("'", "''")


@entry(f"select doc_id, regexp_replace(regexp_replace(lower({_markup_sql('text')}), '{_marks}', '', 'g'), '{text.URL}', '', 'g') as clean, len(regexp_extract_all(text, '\\S+'))::int as n_words from documents")
def text_clean(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", text.strip_formatting(text.remove_markup(t)).alias("clean"), text.word_count(t).alias("n_words"))


@entry("select d.doc_id, coalesce(nullif(p.html, ''), nullif(d.text, '')) as chosen from documents d left join pages p on p.page_id = d.doc_id")
def first_nonempty_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    both = docs(spark, sf_dir, "doc_id", "text").join(pages, F.col("doc_id") == F.col("page_id"), "left")
    return both.select("doc_id", text.first_text("html", "text").alias("chosen"))


@entry("with s as (select doc_id, string_split(text, '.') as ps from documents), p as (select doc_id, unnest(range(len(ps)))::int as phrase_id, unnest(ps) as phrase from s) select * from p where regexp_matches(phrase, '\\S')")
def phrases(spark, sf_dir):
    out = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(text.phrases(F.col("text"))).alias("phrase_id", "phrase"))
    return out.where(F.col("phrase").rlike(r"\S"))


@entry(f"with {TOK} select doc_id, phrase_id::int as phrase_id, pos::int as pos, word, tag from tok")
def pos_map(spark, sf_dir):
    return tr.phrase_words(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", "phrase_id", "pos", "word", "tag")


@entry(f"with {TOK} select doc_id, lower(word) as token, count(*) as n from tok where tag not in ('RB','PRP','CC','DT','IN','TO','MD') and regexp_matches(word, '^\\p{{L}}+$') and length(word) > 1 group by all")
def tokens_filtered(spark, sf_dir):
    return vo.content_tokens(docs(spark, sf_dir, "doc_id", "text")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


_BAG = f"{TOK}, bag as (select doc_id, lower(word) as token from tok where tag not in ('RB','PRP','CC','DT','IN','TO','MD') and regexp_matches(word, '^\\p{{L}}+$') and length(word) > 1)"


@entry(f"with {_BAG}, c as (select token, count(distinct doc_id) as df, count(*) as tf from bag group by token) select * from c where df >= 5 and df <= 0.7 * (select count(*) from documents)")
def dictionary_prune(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text")
    return vo.dictionary(vo.content_tokens(d), d.count())


def _generator(name):
    def run(spark, sf_dir):
        made = tr.generate(tr.phrase_tokens(docs(spark, sf_dir, "doc_id", "text")), [name])
        return made.select("doc_id", "phrase_id", "subject", "relation", "object")

    run.__name__ = f"triples_{name}"
    return entry(f"with {TOK}, g as ({GEN[name]}) select doc_id, phrase_id::int as phrase_id, subject, relation, object from g")(run)


for _name in GEN:
    globals()[f"triples_{_name}"] = _generator(_name)


@entry(f"with {RAW} select doc_id, phrase_id::int as phrase_id, subject, relation, object, count(*) as copies from raw group by all")
def triples_all(spark, sf_dir):
    made = tr.generate(tr.phrase_tokens(docs(spark, sf_dir, "doc_id", "text")))
    return made.groupBy("doc_id", "phrase_id", "subject", "relation", "object").agg(F.count("*").alias("copies"))


@entry(f"with {VALID} select coalesce(reason, 'valid') as reason, relation, count(*) as n from judged group by all")
def validate_rule(spark, sf_dir):
    made = tr.generate(tr.phrase_tokens(docs(spark, sf_dir, "doc_id", "text")))
    return made.groupBy(F.coalesce(tr.generated_reason(), F.lit("valid")).alias("reason"), "relation").agg(F.count("*").alias("n"))


_CORE = _in(tr.PREDICATE_CORE)
_POS = f"""with {TOK}, three as (select word as s, w1 as r, w2 as o, tag as st, t1 as rt, t2 as ot from tok where w2 is not null),
judged as (select case when lower(r) in ('the', 'a', 'an') then 'article as relation'
when st in ('CC','DT','EX','IN','TO','UH') or (st in ('VB','VBP','VBZ') and lower(s) not in ('being','having')) then 'subject tag'
when lower(r) not in ('locatedat','isat','has','have','had','is','are','was','were') and not list_contains({_CORE}, rt) then 'predicate tag'
when ot in ('CC','DT','EX','TO','UH') or (ot in ('VB','VBP','VBZ') and lower(o) not in ('being','having')) then 'object tag' end as reason, st, rt, ot from three)
select coalesce(reason, 'valid') as reason, st as subject_tag, rt as relation_tag, ot as object_tag, count(*) as n from judged group by all"""


@entry(_POS)
def validate_pos(spark, sf_dir):
    """Runs of three words as triples, so that every rule is met."""
    tokens = tr.phrase_tokens(docs(spark, sf_dir, "doc_id", "text"))
    made = tokens.select(F.explode(tr.word_runs(F.col("tokens"))).alias("t")).select("t.*")
    reason = tr.generated_pos_reason(relation_tag=F.col("relation_tag"))
    return made.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason"), "subject_tag", "relation_tag", "object_tag").agg(F.count("*").alias("n"))


_BENCH_WORDS = "bw as (select distinct lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) as term from benchmark)"


@entry(f"with {VALID}, {_BENCH_WORDS} select doc_id, count(*) as n_triples from valid where lower(subject) in (select term from bw) or lower(object) in (select term from bw) group by doc_id")
def vocab_filter(spark, sf_dir):
    vocabulary = vo.words_of(table(spark, sf_dir, "benchmark", "text"), "text")
    return vo.with_term(valid_triples(spark, sf_dir), vocabulary).groupBy("doc_id").agg(F.count("*").alias("n_triples"))


@entry(f"""with {VALID}, {_BENCH_WORDS}, used as (select doc_id, lower(subject) as term from valid union all select doc_id, lower(object) from valid)
select doc_id, count(distinct case when term in (select term from bw) then term end) as n_found, count(distinct case when term not in (select term from bw) then term end) as n_missing from used group by doc_id""")
def vocab_found_and_missing(spark, sf_dir):
    vocabulary = vo.words_of(table(spark, sf_dir, "benchmark", "text"), "text").withColumn("known", F.lit(True))
    used = valid_triples(spark, sf_dir).select("doc_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("term"))
    marked = used.join(vocabulary, "term", "left")
    distinct = lambda c: F.count_distinct(F.when(c, F.col("term")))
    return marked.groupBy("doc_id").agg(distinct(F.col("known").isNotNull()).alias("n_found"), distinct(F.col("known").isNull()).alias("n_missing"))


@entry(f"""with {TOK}, {_BENCH_WORDS}, g as (select term, 'http://terms/' || term as uri, case when length(term) % 3 = 0 then null when length(term) % 2 = 0 then 'kg:Even' else 'kg:Odd' end as type from bw),
l as (select distinct doc_id, word as surface, uri, coalesce(type, 'kg:Other') as type from tok join g on lower(word) = term)
select doc_id, count(*) as n_links, string_agg(type || '=' || uri, ';' order by type, uri, surface) as links from l group by doc_id""")
def entity_link(spark, sf_dir):
    terms = vo.words_of(table(spark, sf_dir, "benchmark", "text"), "text")
    size = F.length("term")
    gazetteer = terms.select("term", F.concat(F.lit("http://terms/"), F.col("term")).alias("uri"), F.when(size % 3 == 0, None).when(size % 2 == 0, "kg:Even").otherwise("kg:Odd").alias("type"))
    fallback = gazetteer.select("uri", F.lit("kg:Other").alias("type"))
    return vo.linked(docs(spark, sf_dir, "doc_id", "text"), gazetteer, fallback)


@entry("""with n as (select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, '''s', ' is'), 'n''t', ' not'), '''ll', ' will'), '''m', ' am'), 'can not', 'cannot'), ',', ' , '), '[^A-Za-z0-9]+', ' ', 'g')) as normal from documents)
select doc_id, normal, md5(normal) as digest from n""")
def sentence_normalise(spark, sf_dir):
    out = docs(spark, sf_dir, "doc_id", "text").select("doc_id", text.normalise_sentence(F.col("text")).alias("normal"))
    return out.withColumn("digest", F.md5("normal"))


_modals = _in(text.MODALS)
_aux = _in(text.AUXILIARIES)


@entry(f"""with w as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '' and not list_contains({_modals}, lower(x))) as a from documents),
m as (select doc_id, a, list_filter(a, lambda x: not list_contains({_aux}, lower(x))) as b from w)
select doc_id, md5(array_to_string(case when len(b) > 0 then b else a end, ' ')) as digest from m""")
def predicate_normalise(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(text.normalise_predicate(F.col("text"))).alias("digest"))


_verbs = _in(rules.PREDICATE_TAGS)


@entry(f"""with {TOK}, adv as (select doc_id, phrase_id, arg_min(word, pos) as a from tok where tag in ('RB','RBS','RBP') group by all),
pr as (select doc_id, phrase_id, word || ' ' || w1 as p, list_contains({_verbs}, tag) and t1 in ('IN','TO') as kept, a, list_filter([word, w1], lambda x: not list_contains({_modals}, lower(x))) as m
  from tok left join adv using (doc_id, phrase_id) where w1 is not null and (list_contains({_verbs}, tag) or list_contains({_verbs}, t1))),
n as (select doc_id, p, array_to_string(case when kept and len(m) = 2 then m else list_filter(m, lambda x: not list_contains({_in(rules.BE_HAVE)}, lower(x))) end, ' ') as v, a from pr)
select doc_id, p as predicate, case when a is null then v else replace(v, a, '') end as normal, count(*) as n from n group by all""")
def predicate_rules(spark, sf_dir):
    """Runs of two words with a verb as predicates, normalised by the tags of their phrase."""
    tokens = tr.phrase_tokens(docs(spark, sf_dir, "doc_id", "text"))
    word, tag = (lambda i: F.get("tokens", i)["word"]), (lambda i: F.get("tokens", i)["tag"])
    verb = lambda i: tag(i).isin(rules.PREDICATE_TAGS)
    places = F.when(F.size("tokens") > 1, F.sequence(F.lit(0), F.size("tokens") - 2)).otherwise(F.array().cast("array<int>"))
    adverb = rules.first_adverb(F.col("tokens"))
    made = F.transform(F.filter(places, lambda i: verb(i) | verb(i + 1)), lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1)).alias("predicate"), (verb(i) & tag(i + 1).isin(rules.PREPOSITION_TAGS)).alias("kept")))
    rows = tokens.select("doc_id", adverb.alias("adverb"), F.explode(made).alias("p")).select("doc_id", "adverb", "p.*")
    return rows.groupBy("doc_id", "predicate", rules.predicate_normalised(F.col("predicate"), F.col("kept"), F.col("adverb")).alias("normal")).agg(F.count("*").alias("n"))


@entry("""with a as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as w from documents),
b as (select distinct item_id, x as spelled, lower(x) as w from (select item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) as x from benchmark)),
s as (select item_id, count(distinct w) as size from b group by item_id)
select doc_id, item_id, count(*) as n_shared, count(distinct w) = any_value(size) as is_superset from a join b using (w) join s using (item_id) group by doc_id, item_id""")
def case_insensitive_sets(spark, sf_dir):
    """Documents and items that share a word, whatever its case: how many of the item's words, and whether all."""
    a = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("ws"))
    return sets.shared_words(a, table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("spelled")))


@entry("""with w as (select doc_id, unnest(ws) as key, unnest(range(len(ws))) as pos from (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as ws from documents))
select doc_id, arg_min(key, pos) as first_spelling, max(pos)::int as last_value from w group by doc_id, lower(key)""")
def case_insensitive_map(spark, sf_dir):
    """Words as keys without case, their places as values: the first spelling and the last value stay."""
    words = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("keys"))
    return sets.folded_map(words, "doc_id", "keys").select("doc_id", F.col("key").alias("first_spelling"), F.col("value").alias("last_value"))


@entry(f"""with {VALID}, longer as (select doc_id, phrase_id, subject, relation, object from valid union all select doc_id, phrase_id, subject || ' ' || object, relation, object from valid where length(subject) % 2 = 0),
u as (select *, row_number() over (partition by doc_id, phrase_id order by subject, relation, object) as seq, list_distinct(string_split(lower(subject), ' ')) as s, list_distinct(string_split(lower(relation), ' ')) as r, list_distinct(string_split(lower(object), ' ')) as o from longer)
select distinct doc_id, phrase_id::int as phrase_id, subject, relation, object from u a where not exists (select 1 from u b where b.doc_id = a.doc_id and b.phrase_id = a.phrase_id and b.seq <> a.seq
 and list_has_all(b.s, a.s) and list_has_all(b.r, a.r) and list_has_all(b.o, a.o) and (not (list_has_all(a.s, b.s) and list_has_all(a.r, b.r) and list_has_all(a.o, b.o)) or b.seq < a.seq))""")
def superset_maximal(spark, sf_dir):
    """Valid triples, and for some of them one whose subject holds the object's words too."""
    valid = valid_triples(spark, sf_dir).select("doc_id", "phrase_id", "subject", "relation", "object")
    both = F.array(F.col("subject"), F.when(F.length("subject") % 2 == 0, F.concat_ws(" ", "subject", "object")))
    every = valid.withColumn("subject", F.explode(F.array_compact(both)))  # of one extraction
    place = F.row_number().over(Window.partitionBy("doc_id", "phrase_id").orderBy("subject", "relation", "object"))
    kept = tr.maximal(stored(every.withColumn("triple_seq", place)), "doc_id", "phrase_id")
    return kept.select("doc_id", "phrase_id", "subject", "relation", "object").distinct()


@entry(f"""with {VALID}, o as (select doc_id, list(struct_pack(q := rn, s := subject, o := object) order by rn) as rows from
 (select *, row_number() over (partition by doc_id order by phrase_id, subject, relation, object) as rn from valid) group by doc_id),
f as (select doc_id, list_reduce(rows, lambda acc, t: struct_pack(s := case when t.s <> acc.s and t.o <> acc.o then t.s else acc.s end, o := case when t.s <> acc.s and t.o <> acc.o then t.o else acc.o end,
   kept := case when t.s <> acc.s and t.o <> acc.o then list_append(acc.kept, t.q) else acc.kept end), struct_pack(s := rows[1].s, o := rows[1].o, kept := []::bigint[])) as r from o)
select doc_id, unnest(r.kept)::int as triple_seq from f""")
def accept_sequence(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("phrase_id", "subject", "relation", "object"))
    return tr.accept_sequence(valid_triples(spark, sf_dir).withColumn("triple_seq", place), "doc_id").select("doc_id", "triple_seq")


@entry(f"with {VALID} select doc_id, source as topic, relation, count(*) as n from valid group by all")
def add_topics(spark, sf_dir):
    made = valid_triples(spark, sf_dir).drop("source")
    topics = docs(spark, sf_dir, "doc_id", "source").withColumnRenamed("source", "topic")
    return made.join(topics, "doc_id", "left").groupBy("doc_id", "topic", "relation").agg(F.count("*").alias("n"))


_ANSWER = """'Answer: {"explanation": "' || role || '", "coherence": ' || (turn % 5 + 1) || case when turn % 3 = 0 then ', "relevance": 4} done' else '' end"""


@entry(f"""with a as (select conv_id, turn, role, {_ANSWER} as answer from conversations)
select conv_id, turn, role as explanation, (turn % 5 + 1)::int as coherence, case when turn % 3 = 0 then 4 end::int as relevance from a""")
def json_extract(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    tail = F.when(F.col("turn") % 3 == 0, ', "relevance": 4} done').otherwise("")
    answer = F.concat(F.lit('Answer: {"explanation": "'), "role", F.lit('", "coherence": '), (F.col("turn") % 5 + 1).cast("string"), tail)
    return conv.select("conv_id", "turn", text.json_answer(answer).alias("a")).select("conv_id", "turn", "a.explanation", "a.coherence", "a.relevance")


@entry("select doc_id, case when source like '%#%' then regexp_extract('http://kg/' || source, '[^#]*$') else source end as segment, regexp_replace(source, '\\d+', '', 'g') as bare from documents")
def uri_segment(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source")
    return d.select("doc_id", text.last_segment(F.concat(F.lit("http://kg/"), "source")).alias("segment"), text.remove_numbers(F.col("source")).alias("bare"))


@entry(f"with {VALID} select relation, count(*) as n, count(distinct subject) as n_subjects, count(distinct object) as n_objects from valid group by relation")
def relations(spark, sf_dir):
    return valid_triples(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("object").alias("n_objects"))




_WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: Every benchmark item is named by its first one to four words; longer names and larger ids weigh more.
_NAMES_SQL = f"""nm as (select item_id, w[1:1 + item_id % 4] as w from (select item_id, {_WORDS_SQL.format("text")} as w from benchmark) where len(w) > 0),
nb as (select array_to_string(w, ' ') as name, len(w) as size, arg_max(item_id, (len(w), item_id)) as item from nm where item_id % 7 > 0 group by w)"""


@entry(f"""with recursive {_NAMES_SQL}, dw as (select doc_id, {_WORDS_SQL.format("text")} as w from documents where text is not null),
ps as (select doc_id, unnest(w) as w, unnest(range(len(w))) as place from dw),
ld as (select doc_id, place, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2, lead(w, 3) over o as w3 from ps window o as (partition by doc_id order by place)),
ng as (select doc_id, place, 1 as size, w as name from ld union all select doc_id, place, 2, w || ' ' || w1 from ld union all select doc_id, place, 3, w || ' ' || w1 || ' ' || w2 from ld union all select doc_id, place, 4, w || ' ' || w1 || ' ' || w2 || ' ' || w3 from ld),
hit as (select doc_id, place, max(size) as size, arg_max(name, size) as name, arg_max(item, size) as item from ng join nb using (size, name) group by doc_id, place),
nx as (select h.*, k.place as after from hit h asof left join hit k on k.doc_id = h.doc_id and h.place + h.size <= k.place),
g as (select * from (select * from nx qualify place = min(place) over (partition by doc_id)) union all select nx.* from g join nx on nx.doc_id = g.doc_id and nx.place = g.after)
select name, 'item:' || item as uri, count(*) as n, count(distinct doc_id) as n_docs, sum(place)::bigint as places from g group by all""")
def entity_links(spark, sf_dir):
    """Names of one to four words found in all texts, the longest match at each place."""
    own = linking.words(F.col("text"))
    items = table(spark, sf_dir, "benchmark", "item_id", "text").where(F.size(own) > 0)
    name = F.array_join(F.slice(own, F.lit(1), (1 + F.col("item_id") % 4).cast("int")), " ")
    names = items.select(name.alias("name"), F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("uri"), F.when(F.col("item_id") % 7 > 0, 1.0).otherwise(0.1).alias("confidence"), F.col("item_id").alias("support"))
    found = linking.link(docs(spark, sf_dir, "doc_id", "text"), names, least_confidence=0.5)
    return found.groupBy("name", "uri").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("place").alias("places"))
