"""The default tagger: closed-class words and endings, as one column expression.

It stands in for a trained tagger and isn't one; ``plans`` take any other expression of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOUNS, PROPER = ["NN", "NNS", "NNP", "NNPS"], ["NNP", "NNPS"]
TOKEN = r"[\p{L}\p{N}]+"
#: Words of closed classes in the four languages of the corpus.
LEXICON = {
    "DT": "the a an this that these those le la les un une des der die das den dem ein eine el los las una",
    "IN": "of in on at by for with from near under above below beside between behind front de du dans sur par von zu auf mit für del en con por para al",
    "TO": "to",
    "CC": "and or but et ou mais und oder aber y o pero",
    "PRP": "it they he she we i you il elle ils nous vous er sie es wir ihr su se",
    "MD": "can could may might must shall should will would",
    "VBZ": "is has does est ist hat es",
    "VBP": "are have do sont sind haben son",
    "VBD": "was were had did",
    "VB": "be been being",
    "RB": "not very as pas nicht als no que qui",
}
ENDINGS = [("RB", "ly"), ("VBG", "ing"), ("VBN", "ed"), ("JJ", "ble|ous|ful|ive|less|ish|lich|eux"), ("NNS", "s")]


def _lexicon() -> dict[str, list[str]]:
    """Words of each tag; a word of several has the first."""
    seen: set[str] = set()
    out = {}
    for name, own in LEXICON.items():
        out[name] = [w for w in own.split() if w not in seen]
        seen.update(out[name])
    return out


def tag(word: Column, low: Column | None = None) -> Column:
    """A Penn tag by the word alone. low: the word in lower case, if that is at hand.

    The tests are ordered so that a word meets few: one look-up tells whether it is in the lexicon at all, patterns are
    only tried on words that don't begin with a-z, and endings are compared without patterns.
    """
    low = F.lower(word) if low is None else low
    lexicon = _lexicon()
    known = None
    for name, own in lexicon.items():
        known = F.when(low.isin(own), name) if known is None else known.when(low.isin(own), name)
    out = F.when(low.isin([w for own in lexicon.values() for w in own]), known)
    out = out.when((word >= "0") & (word < ":"), "CD").when(~((word >= "a") & (word < "{")) & word.rlike(r"^\p{Lu}\p{Ll}"), "NNP")
    for name, ending in ENDINGS:
        hit = F.lit(False)
        for e in ending.split("|"):
            hit = hit | (low.endswith(e) & (low != e))
        out = out.when(hit, name)
    return out.otherwise("NN")


def tag_sql(word: str = "word") -> str:
    """The same for DuckDB."""
    parts = [f"when lower({word}) in ({', '.join(repr(w) for w in own)}) then '{name}'" for name, own in _lexicon().items()]
    parts += [f"when regexp_matches({word}, '^[0-9]') then 'CD'", f"when regexp_matches({word}, '^\\p{{Lu}}\\p{{Ll}}') then 'NNP'"]
    parts += [f"when regexp_matches(lower({word}), '.(?:{e})$') then '{n}'" for n, e in ENDINGS]
    return f"case {' '.join(parts)} else 'NN' end"


def tokens(phrase: Column) -> Column:
    """Distinct words of a phrase in order, each with its tag: a word-to-tag map whose keys keep their first place."""
    own = F.array_distinct(F.regexp_extract_all(phrase, F.lit(TOKEN), F.lit(0)))
    lowered = F.transform(own, lambda w: F.struct(w.alias("word"), F.lower(w).alias("low")))
    return F.transform(lowered, lambda t: F.struct(t["word"].alias("word"), tag(t["word"], t["low"]).alias("tag")))
