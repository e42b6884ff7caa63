"""Older rules over tagged words: sentences, predicates, candidates and normalised triples, as columns over ``tokens``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.triples import lookup
from .sets import strict_superset, words
from .text import MODALS, casefold, normalise_predicate

#: Tags that can be a subject, a predicate or an object.
SUBJECT_TAGS = ["NN", "NNS", "NNP", "NNPS", "PRP", "WP"]
PREDICATE_TAGS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD"]
OBJECT_TAGS = ["NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS", "CD", "RB", "PRP"]
PREPOSITION_TAGS = ["IN", "TO"]
ADVERB_TAGS = ["RB", "RBS", "RBP"]
#: Forms that a normalised predicate leaves out.
BE_HAVE = ["is", "are", "am", "was", "were", "has", "have", "had"]


def lemma(word: Column) -> Column:
    """A rule lemma: common English endings off."""
    low = F.lower(word)
    return F.when(low.rlike("^.{2,}ies$"), F.regexp_replace(low, "ies$", "y")).when(low.rlike("^.{2,}(sses|shes|ches|xes)$"), F.regexp_replace(low, "es$", "")).when(low.rlike("^.{2,}[^su]s$"), F.regexp_replace(low, "s$", "")).otherwise(low)


def equivalent(a: Column, b: Column) -> Column:
    """Equal without case, or one is the other's lemma."""
    return (F.lower(a) == F.lower(b)) | (lemma(a) == F.lower(b)) | (lemma(b) == F.lower(a))


def is_present(word: Column, lemmas: Column) -> Column:
    return F.array_contains(lemmas, lemma(word))


def _has(tokens: Column, allowed: list[str], but: list[str] | None = None) -> Column:
    return F.exists(tokens, lambda t: t["tag"].isin(allowed) & ~t["tag"].isin(but or [""]))


def valid_sentence(tokens: Column) -> Column:
    """A tag for each of subject, predicate and object; a tag that can be a subject isn't counted as an object."""
    return _has(tokens, SUBJECT_TAGS) & _has(tokens, PREDICATE_TAGS, SUBJECT_TAGS) & _has(tokens, OBJECT_TAGS, SUBJECT_TAGS + PREDICATE_TAGS)


def tags_of(part: Column, tokens: Column) -> Column:
    return F.transform(F.split(part, " "), lambda w: lookup(w, tokens))


def verb_then_preposition(part: Column, tokens: Column) -> Column:
    """A verb right before a preposition within the part."""
    tags = tags_of(part, tokens)
    return F.exists(F.arrays_zip(tags.alias("a"), F.slice(tags, F.lit(2), F.size(tags)).alias("b")), lambda p: p["a"].isin(PREDICATE_TAGS) & F.coalesce(p["b"], F.lit("")).isin(PREPOSITION_TAGS))


def verb_noun_preposition(tokens: Column) -> Column:
    """Place of the first verb, noun, preposition run; -1 without one."""
    n = F.size(tokens)
    at = F.filter(F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), lambda i: F.get(tokens, i)["tag"].isin(PREDICATE_TAGS) & F.get(tokens, i + 1)["tag"].startswith("NN") & F.get(tokens, i + 2)["tag"].isin(PREPOSITION_TAGS))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def first_adverb(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t["tag"].isin(ADVERB_TAGS)), F.lit(0))["word"]


def predicate_normalised(part: Column, verb_preposition: Column, adverb: Column) -> Column:
    """A predicate of several words without modals, without be and have unless what is left is a verb with its preposition
    (``verb_then_preposition``), and without the phrase's first adverb. One word stays as it is."""
    words = F.filter(F.split(part, " "), lambda w: ~F.lower(w).isin(MODALS))
    kept = F.when(verb_preposition & (F.size(words) == 2), words).otherwise(F.filter(words, lambda w: ~F.lower(w).isin(BE_HAVE)))
    left = F.array_join(kept, " ")
    return F.when(F.size(F.split(part, " ")) > 1, F.when(adverb.isNull(), left).otherwise(F.replace(left, adverb, F.lit("")))).otherwise(part)


def valid_predicate(part: Column, tokens: Column) -> Column:
    """A verb in it, and nothing that could be a subject."""
    tags = tags_of(part, tokens)
    return F.exists(tags, lambda t: t.isin(PREDICATE_TAGS)) & ~F.exists(tags, lambda t: t.isin("NNP", "NNPS"))


def valid_subject(part: Column, tokens: Column) -> Column:
    return F.exists(tags_of(part, tokens), lambda t: t.isin(SUBJECT_TAGS))


def valid_object(part: Column, tokens: Column) -> Column:
    return F.exists(tags_of(part, tokens), lambda t: t.isin(OBJECT_TAGS))


def is_candidate(s: Column, r: Column, o: Column, tokens: Column, *vocabularies: Column) -> Column:
    """A part's words are in one of the vocabularies, and the parts have the tags of a triple."""
    hit = F.lit(False)
    for v in vocabularies:
        for part in (s, r, o):
            hit = hit | F.arrays_overlap(words(part), v)
    return hit & valid_subject(s, tokens) & valid_predicate(r, tokens) & valid_object(o, tokens)


def named(part: Column, entities: Column) -> Column:
    """The first entity whose words hold all of the part's and more, else the part."""
    return F.coalesce(F.get(F.filter(entities, lambda e: strict_superset(words(e), words(part))), F.lit(0)), part)


def normalised(s: Column, r: Column, o: Column, tokens: Column) -> Column:
    """Folded ends and a normalised predicate; null if an end has no fitting tag or the predicate nothing left."""
    ok = valid_subject(s, tokens) & valid_object(o, tokens) & (normalise_predicate(r) != "")
    return F.when(ok, F.struct(casefold(s).alias("subject"), normalise_predicate(r).alias("relation"), casefold(o).alias("object")))


def admissible_terms(terms: Column) -> Column:
    """Terms that don't start with a digit, once each."""
    return F.array_distinct(F.filter(terms, lambda t: (t != "") & ~t.rlike(r"^\d")))


def type_names(types: Column) -> Column:
    """Names of a comma-separated type list: what follows the colon, unless it is a bare number code or one letter."""
    own = F.filter(F.split(types, ","), lambda t: t.contains(":"))
    names = F.transform(own, lambda t: F.lower(F.trim(F.substring_index(t, ":", -1))))
    return F.filter(names, lambda t: (F.length(t) > 1) & ~t.rlike(r"^q\d*$"))


def nearest_svo(tokens: Column) -> Column:
    """The default for a dependency parse: for each verb, the nearest noun on either side, as an array of triples."""
    # a letter for each token, so that the nearest noun is found by text search and not by going through the phrase for each verb
    kinds = F.array_join(F.transform(tokens, lambda t: F.when(t["tag"].startswith("NN"), "N").when(t["tag"].isin(PREDICATE_TAGS), "V").otherwise("-")), "")
    verbs = F.filter(F.when(F.length(kinds) >= 3, F.sequence(F.lit(1), F.length(kinds) - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(kinds, i + 1, F.lit(1)) == "V")

    def made(i: Column) -> Column:
        before, behind = F.substring(kinds, F.lit(1), i), F.substring(kinds, i + 2, F.length(kinds))
        left = F.when(before.contains("N"), F.length(before) - F.length(F.substring_index(before, "N", -1)) - 1)
        right = F.when(behind.contains("N"), i + F.length(F.substring_index(behind, "N", 1)) + 1)
        return F.struct(F.get(tokens, left)["word"].alias("subject"), lemma(F.get(tokens, i)["word"]).alias("relation"), F.get(tokens, right)["word"].alias("object"))

    return F.filter(F.transform(verbs, made), lambda t: t["subject"].isNotNull() & t["object"].isNotNull())
