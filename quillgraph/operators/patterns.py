"""Basic graph patterns over a table of triples (s, p, o), as joins, and what an ontology says of terms.

A pattern is three strings; one that begins with ? is a variable, any other a value that must stand there. A solution is a row with
a column for each variable. Solutions are a bag: a triple that stands twice in the table counts twice.
Patterns are joined in an order in which each shares a variable with those before; there is no cross join, patterns without any
shared variable are refused. Triples with a null part match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

Pattern = tuple[str, str, str]

#: Predicates of the record of a term.
TYPE, LABEL, SUBCLASS, CLASS = "rdf:type", "rdfs:label", "rdfs:subClassOf", "owl:Class"
NOT_RELATIONS = [TYPE, LABEL]
ABOUT_PROPERTY = ["comment", "label", "range", "domain"]
#: Rows about properties that are broadcast.
FEW_SAID = 10_000


def variables(patterns: Sequence[Pattern]) -> list[str]:
    """Names of the variables in order of their first place."""
    return list(dict.fromkeys(x[1:] for p in patterns for x in p if x.startswith("?")))


def _one(graph: DataFrame, pattern: Pattern) -> DataFrame:
    rows, places = graph, {}
    for column, x in zip("spo", pattern, strict=True):
        rows = rows.where(F.col(column).isNotNull())
        if not x.startswith("?"):
            rows = rows.where(F.col(column) == x)
        elif x[1:] in places:
            rows = rows.where(F.col(column) == F.col(places[x[1:]]))
        else:
            places[x[1:]] = column
    return rows.select(*[F.col(c).alias(name) for name, c in places.items()])


def _connected(patterns: Sequence[Pattern]) -> list[Pattern]:
    """Those with most fixed values first, each with a variable of the ones before."""
    left = sorted(patterns, key=lambda p: sum(x.startswith("?") for x in p))
    order = [left.pop(0)]
    while left:
        known = set(variables(order))
        step = next((p for p in left if known & set(variables([p]))), None)
        if step is None:
            raise ValueError(f"patterns {order} and {left} share no variable")
        left.remove(step)
        order.append(step)
    return order


def match(graph: DataFrame, patterns: Sequence[Pattern], optional: Sequence[Sequence[Pattern]] = (), where: str | None = None, select: Sequence[str] | None = None, distinct: bool = False, limit: int | None = None) -> DataFrame:
    """Solutions of all patterns; each optional block adds its variables where it has solutions, else null; where is SQL over variables, before the optional blocks.

    A block must share a variable with the patterns, and none with a block before it that the patterns haven't. limit takes the first in
    order of the selected columns.
    """
    if not patterns or not variables(patterns):
        raise ValueError("a pattern with a variable is needed")
    order = _connected(patterns)
    rows = reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]), [_one(graph, p) for p in order])
    rows = rows.where(where) if where else rows
    sure = set(rows.columns)
    for block in optional:
        found = match(graph, block)
        shared = [c for c in found.columns if c in sure]
        if not shared or set(found.columns) & set(rows.columns) - sure:
            raise ValueError(f"the optional block {block} must share variables with the patterns, and with them alone")
        rows = rows.join(found, shared, "left")
    rows = rows.select(*(select or variables([*patterns, *[p for b in optional for p in b]])))
    rows = rows.distinct() if distinct else rows
    return rows if limit is None else rows.orderBy(*rows.columns).limit(limit)


def concepts(terms: DataFrame, ontologies: Sequence[DataFrame]) -> DataFrame:
    """term, ontology, concept: the first ontology with a label equal to the term but for case, and the first concept in order that has it there. Terms without any are left out."""
    every = [match(g, [("?concept", LABEL, "?name")]).select(F.lower("name").alias("name"), F.lit(i).alias("ontology"), "concept") for i, g in enumerate(ontologies)]
    first = reduce(DataFrame.unionByName, every).groupBy("name").agg(F.min(F.struct("ontology", "concept")).alias("c"))
    own = terms.select("term").where(F.col("term").isNotNull()).distinct()
    return own.join(first, F.lower("term") == F.col("name")).select("term", "c.ontology", "c.concept")


def _with_said(relations: DataFrame, g: DataFrame) -> DataFrame:
    """relations with what g says of their properties.

    A property stands in any number of relations, so a shuffle by it would put all of them into one task. What is said of the properties that g uses
    is counted first and broadcast if it is short; where it isn't, there are many properties to spread over tasks.
    """
    used = stored(g.where("p is not null").select(F.col("p").alias("property")).distinct())
    for name in ABOUT_PROPERTY:
        said = stored(match(g, [("?property", f"rdfs:{name}", f"?{name}")], distinct=True).join(used, "property", "left_semi"))
        relations = relations.join(F.broadcast(said) if said.count() <= FEW_SAID else said, "property", "left")
    return relations


def semantics(terms: DataFrame, ontologies: Sequence[DataFrame], remote_types: DataFrame | None = None) -> DataFrame:
    """What is known of each term, a row a fact: term, ontology, concept, kind, property, value, normalised, comment, label, range, domain.

    kind is type (value; normalised: its parts as words; from remote_types (uri, type) for concepts that their ontology gives none), narrower (classes
    below), broader (classes above) or relation (any other property but types and labels, with what the ontology says of the property). Rows and not one record
    a term, because a concept may have any number of classes below it.
    """
    asked = concepts(terms, ontologies)
    facts = []
    for i, g in enumerate(ontologies):
        mine = asked.where(F.col("ontology") == i)
        types = match(g, [("?concept", TYPE, "?value")], distinct=True)
        facts.append(mine.join(types, "concept").withColumn("kind", F.lit("type")))
        if remote_types is not None:
            other = remote_types.select(F.col("uri").alias("concept"), F.col("type").alias("value")).distinct()
            facts.append(mine.join(types, "concept", "left_anti").join(other, "concept").withColumn("kind", F.lit("type")))
        facts.append(mine.join(match(g, [("?value", TYPE, CLASS), ("?value", SUBCLASS, "?concept")]), "concept").withColumn("kind", F.lit("narrower")))
        facts.append(mine.join(match(g, [("?concept", SUBCLASS, "?value")]), "concept").withColumn("kind", F.lit("broader")))
        known = ", ".join(f"'{p}'" for p in NOT_RELATIONS)
        relations = mine.join(match(g, [("?concept", "?property", "?value")], where=f"property not in ({known})", distinct=True), "concept")
        facts.append(_with_said(relations, g).withColumn("kind", F.lit("relation")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    words = F.trim(F.lower(F.regexp_replace("value", r"[:/#_\s]+", " ")))
    return out.select("term", "ontology", "concept", "kind", "property", "value", F.when(F.col("kind") == "type", words).alias("normalised"), *ABOUT_PROPERTY)
