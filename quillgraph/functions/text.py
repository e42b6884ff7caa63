"""Text functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markup that is removed, in this order, and the marks that cleaning drops.
MARKUP = [r"(?m)^upright=.*[\r\n]", r"(?m)^upright = .*?[\r\n]", r"(?m)Category:.*?[\r\n]", r"(?m)Cat\D*:.*?[\r\n]", r"\[\d+\]", "thumb", "[|]", r"\d+px"]
MARKS = r"[\.\!\?,;\-_'/|()=<>+*`]"
URL = r"https?://\S+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Contractions and what they stand for, in this order.
CONTRACTIONS = [("'s", " is"), ("n't", " not"), ("'ll", " will"), ("'m", " am"), ("can not", "cannot")]
#: Modal verbs that a normalised predicate leaves out, and forms of be and have. "should" and "shouldn't" are two entries on purpose.
MODALS = ["can", "cannot", "can't", "could", "couldn't", "couldnt", "dare", "may", "might", "must", "need", "ought", "shall", "should", "shouldn't", "shouldnt", "will", "would"]
AUXILIARIES = ["am", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "having"]


def remove_markup(text: Column) -> Column:
    """Lines and marks of wiki markup go."""
    for pattern in MARKUP:
        text = F.regexp_replace(text, pattern, "")
    return text


def strip_formatting(text: Column, urls_first: bool = False) -> Column:
    """Lower case without marks and URLs. Marks go first, which leaves most URLs as words; urls_first takes them out whole."""
    text = F.lower(text)
    steps = [URL, MARKS] if urls_first else [MARKS, URL]
    for pattern in steps:
        text = F.regexp_replace(text, pattern, "")
    return text


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), F.lit(0))


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def first_text(*columns: str) -> Column:
    """The first column that isn't null or empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def phrases(text: Column) -> Column:
    """Pieces between full stops, with the blank ones."""
    return F.split(text, r"\.")


def expand_contractions(text: Column) -> Column:
    for short, long in CONTRACTIONS:
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def normalise_sentence(text: Column) -> Column:
    """Contractions expanded, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.replace(expand_contractions(text), F.lit(","), F.lit(" , ")), "[^A-Za-z0-9]+", " "))


def normalise_predicate(predicate: Column) -> Column:
    """Without modals; be and have go too, unless they stand alone. ``rules.predicate_normalised`` heeds tags as well."""
    words = F.filter(F.split(predicate, " "), lambda w: (w != "") & ~F.lower(w).isin(MODALS))
    main = F.filter(words, lambda w: ~F.lower(w).isin(AUXILIARIES))
    return F.array_join(F.when(F.size(main) > 0, main).otherwise(words), " ")


def last_segment(uri: Column) -> Column:
    """What follows the last # or, without one, the last /."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "")


def casefold(text: Column) -> Column:
    """Lower case for comparisons; ß as ss."""
    return F.lower(F.replace(text, F.lit("ß"), F.lit("ss")))


def json_answer(text: Column) -> Column:
    """The object in a model's answer: from the first { to the last } if that parses, else field by field, else null."""
    schema = "explanation string, coherence int, relevance int, coverage int"
    whole = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
    number = lambda name: F.regexp_extract(text, rf'"{name}":\s*(\d+)', 1).try_cast("int")
    quoted = F.nullif(F.regexp_extract(text, r'"explanation":\s*"([^"]*)"', 1), F.lit(""))
    fields = F.struct(quoted.alias("explanation"), *[number(n).alias(n) for n in ("coherence", "relevance", "coverage")])
    has = lambda s: F.coalesce(s["explanation"], s["coherence"].cast("string"), s["relevance"].cast("string"), s["coverage"].cast("string")).isNotNull()
    return F.when(whole.isNotNull() & has(whole), whole).when(has(fields), fields)


def prompt(topic: Column, terms: Column, domain: str) -> Column:
    """A request for an explanation of a cluster's terms."""
    return F.format_string(f"In the domain of {domain}, explain topic %s by its terms: %s.", topic.cast("string"), F.left(F.array_join(terms, ", "), F.lit(200)))
