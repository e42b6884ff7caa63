"""Triples from tagged phrases: generators, validators and list operators. Everything up to explode is narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sets, tagging, text

NOUNS, PROPER = tagging.NOUNS, tagging.PROPER
#: Prepositions of place, relations that validation exempts, and words it knows.
SPATIAL = ["in", "on", "at", "near", "under", "above", "below", "beside", "between", "behind", "front"]
EXEMPT = ["has_property", "is_instance_of", "part_of", "located_in", "located_on", "located_at"]
SUBJECT_TAGS = ["NN", "NNS", "NNP", "NNPS", "PRP"]
OBJECT_TAGS = ["NN", "NNS", "NNP", "NNPS", "JJ", "CD"]
RELATION_TAGS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "IN"]
STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]
BLACKLIST = ["thing", "stuff", "something", "it", "this", "that"]
SUBJECT_NEVER, OBJECT_NEVER = ["CC", "DT", "EX", "IN", "TO", "UH"], ["CC", "DT", "EX", "TO", "UH"]
PREDICATE_CORE = ["VB", "VBN", "VBP", "VBZ", "VBD", "MD"]
PREDICATE_KNOWN = ["locatedat", "isat", "has", "have", "had", "is", "are", "was", "were"]
CONTENT_TAGS = ["NN", "NNS", "NNP", "NNPS", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "JJ", "JJR", "JJS", "RB", "RBR", "RBS", "CD", "FW"]
CONTENT_WORDS = ["it", "they", "he", "she", "we"]
AUXILIARY = ["am", "is", "are", "do", "have", "does", "has", "can", "will", "would", "should"]

TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "relation", "object", "subject_tag", "object_tag")])


def phrase_tokens(docs: DataFrame, first_phrase_only: bool = False) -> DataFrame:
    """doc_id, phrase_id, tokens and their codes for each phrase that isn't blank; other columns stay."""
    out = phrases_of(docs)
    if first_phrase_only:
        out = out.where("phrase_id = 0")
    return out.drop("text").withColumn("tokens", tagging.tokens(F.col("phrase"))).withColumn("codes", codes(F.col("tokens")))


def phrases_of(docs: DataFrame) -> DataFrame:
    """phrase_id and phrase of each phrase that isn't blank; other columns stay."""
    return docs.select("*", F.posexplode(text.phrases(F.col("text"))).alias("phrase_id", "phrase")).where(F.col("phrase").rlike(r"\S"))


def phrase_words(docs: DataFrame) -> DataFrame:
    """doc_id, phrase_id, pos, word, tag: a row for each distinct word of a phrase, tagged in compiled code; other columns stay."""
    own = F.array_distinct(F.regexp_extract_all("phrase", F.lit(tagging.TOKEN), F.lit(0)))
    out = phrases_of(docs).drop("text")
    out = out.select(*[c for c in out.columns if c != "phrase"], F.posexplode(own).alias("pos", "word"))
    return out.withColumn("low", F.lower("word")).withColumn("tag", tagging.tag(F.col("word"), F.col("low"))).drop("low")


def codes(tokens: Column) -> Column:
    """One letter for each token, so that patterns over tags are patterns over a string: J adjective, N common and P proper noun, o the word of, s preposition of place."""
    word = lambda t: F.lower(t["word"])
    code = lambda t: F.when(t["tag"] == "JJ", "J").when(t["tag"].isin("NN", "NNS"), "N").when(t["tag"].isin(PROPER), "P").when(word(t) == "of", "o").when((t["tag"] == "IN") & word(t).isin(SPATIAL), "s").otherwise("-")
    return F.array_join(F.transform(tokens, code), "")


def _at(tokens: Column, i: Column, field: str = "word") -> Column:
    return F.get(tokens, i)[field]


def _triple(tokens: Column, s: Column, r: Column | str, o: Column) -> Column:
    """The triple of the tokens in places s and o, with their tags."""
    return F.struct(_at(tokens, s).alias("subject"), (F.lit(r) if isinstance(r, str) else r).alias("relation"), _at(tokens, o).alias("object"), _at(tokens, s, "tag").alias("subject_tag"), _at(tokens, o, "tag").alias("object_tag"))


def _first(codes: Column, pattern: str, make) -> Column:
    """The first run of tokens that matches, as an array of at most one triple."""
    at = F.regexp_instr(codes, F.lit(pattern))
    return F.when(at > 0, F.array(make(at - 1))).otherwise(F.array().cast(T.ArrayType(TRIPLE)))


def has_property(tokens: Column, codes: Column) -> Column:
    """First adjective right before a noun."""
    return _first(codes, "J[NP]", lambda i: _triple(tokens, i + 1, "has_property", i))


def instance_of(tokens: Column, codes: Column) -> Column:
    """First common noun right before a proper one."""
    return _first(codes, "NP", lambda i: _triple(tokens, i, "is_instance_of", i + 1))


def part_of(tokens: Column, codes: Column) -> Column:
    """First noun of noun."""
    return _first(codes, "[NP]o[NP]", lambda i: _triple(tokens, i, "part_of", i + 2))


def located(tokens: Column, codes: Column) -> Column:
    """First noun, preposition of place as spelled, noun."""
    return _first(codes, "[NP]s[NP]", lambda i: _triple(tokens, i, F.concat(F.lit("located_"), _at(tokens, i + 1)), i + 2))


def adjective_runs(tokens: Column, codes: Column) -> Column:
    """For each noun, each adjective of the unbroken runs at its sides: leftwards first, then rightwards."""
    code = lambda i: F.substring(codes, i + 1, F.lit(1))

    def near(i: Column) -> Column:
        before, behind = F.substring(codes, F.lit(1), i), F.substring(codes, i + 2, F.length(codes))
        left = F.length(before) - F.length(F.rtrim(before, F.lit("J")))
        right = F.length(behind) - F.length(F.ltrim(behind, F.lit("J")))
        none = F.array().cast("array<int>")
        places = F.concat(F.when(left > 0, F.sequence(i - 1, i - left, F.lit(-1))).otherwise(none), F.when(right > 0, F.sequence(i + 1, i + right)).otherwise(none))
        return F.transform(places, lambda a: _triple(tokens, i, "has_property", a))

    beside = lambda i: ((i > 0) & (code(i - 1) == "J")) | (code(i + 1) == "J")
    nouns = F.filter(F.sequence(F.lit(0), F.length(codes) - 1), lambda i: code(i).isin("N", "P") & beside(i))
    return F.when(codes.rlike("J[NP]|[NP]J"), F.flatten(F.transform(nouns, near))).otherwise(F.array().cast(T.ArrayType(TRIPLE)))


GENERATORS = {"has_property": has_property, "instance_of": instance_of, "part_of": part_of, "located": located, "adjective_runs": adjective_runs}


def generate(tokenised: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each triple, in generator order, duplicates kept: phrase columns without the tokens, triple_seq, subject, relation, object and the tags of both ends."""
    if "codes" not in tokenised.columns:
        tokenised = tokenised.withColumn("codes", codes(F.col("tokens")))
    made = F.concat(*[GENERATORS[n](F.col("tokens"), F.col("codes")) for n in names or GENERATORS])
    kept = [c for c in tokenised.columns if c not in ("tokens", "codes", "phrase")]
    return tokenised.select(*kept, F.posexplode(made).alias("triple_seq", "triple")).select(*kept, "triple_seq", "triple.*")


def _tags(part: Column, tokens: Column) -> Column:
    """Tags of the words of a part that are in the map."""
    own = F.regexp_extract_all(part, F.lit(r"\S+"), F.lit(0))
    return F.transform(F.filter(tokens, lambda t: F.array_contains(own, t["word"])), lambda t: t["tag"])


def rule_reason(s: Column, r: Column, o: Column, tokens: Column) -> Column:
    """Why the rule validator rejects a triple; null if it doesn't."""
    s, r, o = (F.trim(x) for x in (s, r, o))
    any_of = lambda part, allowed: F.arrays_overlap(_tags(part, tokens), F.array(*map(F.lit, allowed)))
    return _reason(s, r, o, any_of(s, SUBJECT_TAGS), any_of(o, OBJECT_TAGS), any_of(r, RELATION_TAGS))


def generated_reason(row=F.col) -> Column:
    """rule_reason() for generated triples, whose ends are single words with known tags and whose relations are no words of the phrase."""
    return _reason(row("subject"), row("relation"), row("object"), row("subject_tag").isin(SUBJECT_TAGS), row("object_tag").isin(OBJECT_TAGS), F.lit(False))


def _reason(s: Column, r: Column, o: Column, s_fits: Column, o_fits: Column, r_fits: Column) -> Column:
    low = lambda part: F.regexp_extract_all(F.lower(part), F.lit(r"\S+"), F.lit(0))
    only_stop = lambda part: F.size(F.array_except(low(part), F.array(*map(F.lit, STOPWORDS)))) == 0
    black = lambda part: F.arrays_overlap(low(part), F.array(*map(F.lit, BLACKLIST)))
    return (
        F.when((F.length(s) < 2) | (F.length(r) < 2) | (F.length(o) < 2), "too short")
        .when(~s_fits, "subject tags")
        .when(~o_fits, "object tags")
        .when(~r.isin(EXEMPT) & ~r_fits, "relation tags")
        .when(only_stop(s) | only_stop(o), "only stopwords")
        .when(black(s) | black(o), "blacklisted word")
        .when(F.lower(s) == F.lower(o), "subject equals object")
    )


def basic_reason(s: Column, r: Column, o: Column) -> Column:
    """Why a triple isn't well-formed; null if it is."""
    return (
        F.when((s == "") | (r == "") | (o == "") | s.isNull() | r.isNull() | o.isNull(), "empty part")
        .when((s == r) | (s == o) | (r == o), "equal parts")
        .when(s.contains("**") | r.contains("**") | o.contains("**"), "strange marks")
        .when(F.lower(r).isin("the", "a", "an"), "article as relation")
    )


def lookup(word: Column, tokens: Column) -> Column:
    """A word's tag: as spelled, else without case, else verb for auxiliaries, else a full stop."""
    exact = F.filter(tokens, lambda t: t["word"] == word)
    loose = F.filter(tokens, lambda t: F.lower(t["word"]) == F.lower(word))
    return F.coalesce(F.get(exact, F.lit(0))["tag"], F.get(loose, F.lit(0))["tag"], F.when(F.lower(word).isin(AUXILIARY), "VB"), F.lit("."))


def pos_reason(s: Column, r: Column, o: Column, tokens: Column) -> Column:
    """Basic form, then subject, predicate and object by their tags; the first thing that is wrong, or null."""
    return _pos_reason(s, r, o, *[lambda w: lookup(w, tokens)] * 3)


def word_runs(tokens: Column) -> Column:
    """Each run of three words as a triple, with the tags of all parts."""
    part = lambda i, name: (_at(tokens, i).alias(name), _at(tokens, i, "tag").alias(f"{name}_tag"))
    places = F.when(F.size(tokens) > 2, F.sequence(F.lit(0), F.size(tokens) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(*part(i, "subject"), *part(i + 1, "relation"), *part(i + 2, "object")))


def generated_pos_reason(row=F.col, relation_tag: Column | None = None) -> Column:
    """pos_reason() for generated triples: ends are single words with known tags, relations no words of the phrase unless their tag is given."""
    tag_of = lambda end: lambda w: row(f"{end}_tag")
    return _pos_reason(row("subject"), row("relation"), row("object"), tag_of("subject"), lambda w: F.when(F.lower(w).isin(AUXILIARY), "VB").otherwise(".") if relation_tag is None else relation_tag, tag_of("object"))


def _pos_reason(s: Column, r: Column, o: Column, s_tag, r_tag, o_tag) -> Column:
    split = lambda part: F.regexp_extract_all(part, F.lit(r"\S+"), F.lit(0))

    def noun_part(part: Column, tag_of, never: list[str], name: str) -> Column:
        own = split(part)
        one = tag_of(F.get(own, F.lit(0)))
        content = F.exists(own, lambda w: tag_of(w).isin(CONTENT_TAGS) | F.lower(w).isin(CONTENT_WORDS))
        bare = one.isin("VB", "VBP", "VBZ") & ~F.lower(part).isin("being", "having")
        return F.when((F.size(own) == 1) & (one.isin(never) | bare), f"{name} tag").when((F.size(own) != 1) & ~content, f"{name} without content")

    verb = ~F.lower(r).isin(PREDICATE_KNOWN) & ~r_tag(F.get(split(r), F.lit(0))).isin(PREDICATE_CORE)
    return F.coalesce(basic_reason(s, r, o), noun_part(s, s_tag, SUBJECT_NEVER, "subject"), F.when(verb, "predicate tag"), noun_part(o, o_tag, OBJECT_NEVER, "object"))


def extract(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Valid triples of docs (doc_id, text, ...)."""
    made = generate(phrase_tokens(docs), names)
    return made.where(generated_reason().isNull()).drop("subject_tag", "object_tag")


def maximal(triples: DataFrame, *group: str) -> DataFrame:
    """Triples that no other of their group holds in every part; of equal ones the first (triple_seq). Only rows of one group meet."""
    part = [F.col(c) for c in ("subject", "relation", "object")]
    own = triples.select(*group, "triple_seq", *[sets.words(c).alias(f"w{i}") for i, c in enumerate(part)])
    other = own.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col("triple_seq").alias("q"), *[F.col(f"w{i}").alias(f"v{i}") for i in range(3)])
    same = F.lit(True)
    holds, held = F.lit(True), F.lit(True)
    for i, g in enumerate(group):
        same = same & (F.col(g) == F.col(f"g{i}"))
    for i in range(3):
        holds = holds & sets.superset(F.col(f"v{i}"), F.col(f"w{i}"))
        held = held & sets.superset(F.col(f"w{i}"), F.col(f"v{i}"))
    beaten = own.join(other, same & holds & (F.col("q") != F.col("triple_seq")) & (~held | (F.col("q") < F.col("triple_seq"))), "left_semi")
    return triples.join(beaten.select(*group, "triple_seq"), [*group, "triple_seq"], "left_anti")


def accept_sequence(triples: DataFrame, *group: str, order: str = "triple_seq") -> DataFrame:
    """Of each group in order, triples whose subject and object differ from the last accepted one's, where neither or both hold the other's words.

    The first row is what the others are compared with and is dropped itself. A fold over one group's ordered array.
    """
    names = ("subject", "relation", "object")
    words = [sets.words(F.col(c)).alias(f"{c[0]}w") for c in names]  # once a triple and not once a comparison
    item = F.struct(F.col(order).alias("seq"), *[F.col(c).alias(c[0]) for c in names], *words)
    rows = triples.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("rows"))

    def holds(a: Column, b: Column) -> Column:
        return sets.superset(a["sw"], b["sw"]) & sets.superset(a["rw"], b["rw"]) & sets.superset(a["ow"], b["ow"])

    def step(acc: Column, t: Column) -> Column:
        last = acc["last"]
        ok = (t["s"] != last["s"]) & (t["o"] != last["o"]) & (holds(t, last) == holds(last, t))
        return F.struct(F.when(ok, t).otherwise(last).alias("last"), F.when(ok, F.array_append(acc["kept"], t)).otherwise(acc["kept"]).alias("kept"))

    first = F.get("rows", F.lit(0))
    start = F.struct(first.alias("last"), F.slice("rows", 1, 0).alias("kept"))
    kept = F.aggregate("rows", start, step)["kept"]
    return rows.select(*group, F.explode(kept).alias("t")).select(*group, F.col("t.seq").alias(order), F.col("t.s").alias("subject"), F.col("t.r").alias("relation"), F.col("t.o").alias("object"))
