import random
from collections import Counter

import pytest

from quillgraph.operators import patterns

G = "s string, p string, o string"


def brute(triples, wanted, optional=()):
    """Solutions as dicts, one triple after the other."""

    def extend(known, pattern):
        for t in triples:
            new = dict(known)
            if None not in t and all(new.setdefault(x[1:], v) == v if x[0] == "?" else x == v for x, v in zip(pattern, t, strict=True)):
                yield new

    def all_of(known, block):
        out = [known]
        for p in block:
            out = [new for k in out for new in extend(k, p)]
        return out

    out = all_of({}, wanted)
    for block in optional:
        out = [new for k in out for new in (all_of(k, block) or [k])]
    return out


def test_solutions_equal_brute_force(spark):
    rng = random.Random(2)
    triples = [(f"n{rng.randrange(12)}", f"p{rng.randrange(3)}", f"n{rng.randrange(12)}") for _ in range(70)] + [("n1", "p0", None), (None, "p0", "n1"), ("n2", "p1", "n2")]
    graph = spark.createDataFrame(triples, G).cache()
    asked = [
        ([("?a", "p0", "?b"), ("?b", "p1", "?c")], []),
        ([("?a", "p1", "?a")], []),
        ([("?a", "?p", "n3")], [[("?a", "p2", "?x")]]),
        ([("?c", "p2", "?d"), ("?a", "p0", "?b"), ("?b", "p1", "?c")], [[("?d", "p0", "?x"), ("?x", "p1", "?y")], [("?a", "p2", "?z")]]),
        ([("n1", "p9", "?a")], []),
    ]
    for wanted, optional in asked:
        got = patterns.match(graph, wanted, optional)
        want = Counter(tuple(k.get(c) for c in got.columns) for k in brute(triples, wanted, optional))
        assert Counter(map(tuple, got.collect())) == want, (wanted, optional)


def test_limits_filters_and_refusals(spark):
    graph = spark.createDataFrame([("a", "p", "x"), ("a", "p", "y"), ("b", "p", "x"), ("b", "p", "x")], G)
    rows = lambda *a, **k: [tuple(r) for r in patterns.match(graph, *a, **k).collect()]
    assert rows([("?s", "p", "?o")], limit=2) == [("a", "x"), ("a", "y")]
    assert len(rows([("?s", "p", "?o")])) == 4 and sorted(rows([("?s", "p", "?o")], select=["s"], distinct=True)) == [("a",), ("b",)]
    assert sorted(rows([("?s", "p", "?o")], where="o <> 'x'")) == [("a", "y")]
    assert rows([("?s", "p", "?o")], limit=0) == [] and patterns.match(graph.limit(0), [("?s", "p", "?o")]).count() == 0
    for wanted, optional in ([("?a", "p", "?b"), ("?c", "p", "?d")], []), ([("a", "p", "x")], []), ([], []), ([("?a", "p", "?b")], [[("?c", "p", "?d")]]), ([("?a", "p", "?b")], [[("?a", "q", "?c")], [("?b", "q", "?c")]]):
        with pytest.raises(ValueError):
            patterns.match(graph, wanted, optional)
    plan = patterns.match(graph, [("?a", "p", "?b"), ("?b", "p", "?c")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_terms_by_two_ontologies(spark):
    first = spark.createDataFrame([("A", "rdfs:label", "Cat"), ("A", "rdfs:subClassOf", "B"), ("C", "rdfs:subClassOf", "A"), ("C", "rdf:type", "owl:Class"), ("D", "rdfs:subClassOf", "A"), ("A", "q", "v"), ("q", "rdfs:range", "R"), ("q", "rdfs:range", "S")], G)
    second = spark.createDataFrame([("Z", "rdfs:label", "cat"), ("Y", "rdfs:label", "DOG"), ("Y", "rdf:type", "x:Living_Thing")], G)
    terms = spark.createDataFrame([("CAT",), ("dog",), ("dog",), ("cow",), (None,)], "term string")
    remote = spark.createDataFrame([("A", "far:Type"), ("Y", "far:Other")], "uri string, type string")
    got = {(r.term, r.ontology, r.concept, r.kind, r.property, r.value, r.normalised, r.range) for r in patterns.semantics(terms, [first, second], remote).collect()}
    assert got == {
        ("CAT", 0, "A", "type", None, "far:Type", "far type", None), ("CAT", 0, "A", "narrower", None, "C", None, None), ("CAT", 0, "A", "broader", None, "B", None, None),
        ("CAT", 0, "A", "relation", "q", "v", None, "R"), ("CAT", 0, "A", "relation", "q", "v", None, "S"), ("CAT", 0, "A", "relation", "rdfs:subClassOf", "B", None, None),
        ("dog", 1, "Y", "type", None, "x:Living_Thing", "x living thing", None),
    }
