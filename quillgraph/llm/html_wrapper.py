"""HTML extraction with wrappers: union-free regular expressions inferred for each host.

Each task aligns the token streams (trees) of the pages it reads, host by host: mismatches become optional items,
repeated items or text slots. The wrappers of all tasks are aligned again by host, ``FAN`` at a time until one is left, so
that a host with a third of all pages meets as few small summaries in a task, not as its pages.

A wrapper tells a page's article from the rest by what pages of the host do: which element holds the text that varies
from page to page (its slots, links counted less), and which text in it is the same on every page and so part of the
template. A page is matched to its wrapper level by level, elements in order, so the article is found where the host has
it, even on a page where something else is larger and elements have no telling names.

Wrappers reach the pages by broadcast if together they keep to ``BROADCAST_BYTES``, else they meet the pages of their
host in groups of about ``GROUP`` pages.

Defined cases: null or empty html gives the empty text; a page that its wrapper doesn't fit, or without a host, is
read by its own tree; text repeated on all pages is only taken as template on hosts with ``TEMPLATE_PAGES`` pages or
more (with fewer, it may as well be text of the article), where other text of the article varies; repeated rows each give
a row; an empty table gives an empty one; columns other than page_id, url and html are not taken. br is white space, hr
ends a block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import html_tree as ht
from .common import slices, table

BROADCAST_BYTES = 32 << 20
TEMPLATE_PAGES = 8
#: A child with this share of its parent's text takes its place as the article.
SHARE = 0.7
#: Hosts whose wrappers a task holds before it hands them on. Wrappers of a host that are aligned in one task, and pages of a group.
HELD, FAN, GROUP = 5_000, 32, 256
#: Hosts that may be broadcast by name and number.
BROADCAST_HOSTS = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_HOST = re.compile(HOST)
CONTAINERS = ht.SCOPE | {"center", "content"}


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])

    for batch in slices(batches):
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            if host and source:
                items = ht.items_of(ht.parse(source))
                page = ["html", 0, items, sum(i[3] for i in items), 1]
                held[host] = ht.merge_item(held[host], page) if host in held else page
        if len(held) > HELD:
            yield out()
            held.clear()
    yield out()


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for text in sorted(pdf["wrapper"]):
        own = json.loads(text)
        wrapper = ht.merge_item(wrapper, own) if wrapper else own
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) from all rows of pages (url, html), written."""
    parts = stored(pages.select("url", "html").mapInArrow(_infer, "host string, wrapper string"))
    while True:
        sizes = parts.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
        many = sizes.where("groups > 1").agg(F.count("*")).first()[0]
        if not many:
            return stored(parts.groupBy("host").applyInPandas(_merge, "host string, wrapper string"))
        groups = F.broadcast(sizes.where("groups > 1")) if many <= BROADCAST_HOSTS else sizes.where("groups > 1")
        dealt = parts.join(groups, "host", "left").withColumn("dealt", F.pmod(F.xxhash64("wrapper"), F.coalesce("groups", F.lit(1))))
        parts = stored(dealt.groupBy("host", "dealt").applyInPandas(_merge, "host string, wrapper string"))


def _mass(item: list, varied: bool) -> float:
    """Text of an item that may be part of an article; of its slots alone if asked. Links count a quarter."""
    if item[0] == "#":
        return 0 if varied and not item[1] & ht.SLOT else item[3]
    if item[0][0] == "!":
        return 0
    return sum(_mass(i, varied) for i in item[2])


class Rule:
    """What a wrapper says: the steps down to the article, and template texts within it."""

    def __init__(self, wrapper: list) -> None:
        self.path: list[Step] = []
        varied = wrapper[4] > 1 and _mass(wrapper, True) > 0
        found = self._best(wrapper, ("article",), varied) or self._best(wrapper, ("main",), varied)
        node = wrapper
        if found:
            self.path, node = found
        else:
            while True:
                inner = [(_mass(i, varied), -k) for k, i in enumerate(node[2]) if ht.base(i[0]) in CONTAINERS]
                most, k = max(inner, default=(0, 0))
                if not most or most < SHARE * _mass(node, varied) or node[2][-k][1] & (ht.REPEATED | ht.OPTIONAL):
                    break
                self.path.append(_step(node, -k))
                node = node[2][-k]
        slots = list(self._slots(node, []))
        varies = any(item[1] & ht.SLOT for _, item, _ in slots)
        # on every page, in the same place
        self.template = {(tuple(path), text) for path, item, flags in slots for text in item[2] if varies and not flags & ht.OPTIONAL and wrapper[4] >= TEMPLATE_PAGES and item[4] == wrapper[4]}

    def _best(self, node: list, names: tuple[str, ...], varied: bool, path: tuple = ()) -> tuple[list, list] | None:
        """The element of that name with most text, outside what isn't article."""
        best = None
        for k, item in enumerate(node[2]):
            if item[0] == "#" or item[0][0] == "!":
                continue
            here = (*path, _step(node, k))
            got = (list(here), item) if ht.base(item[0]) in names and _mass(item, varied) else self._best(item, names, varied, here)
            if got and (best is None or _mass(got[1], varied) > _mass(best[1], varied)):
                best = got
        return best

    def _slots(self, node: list, path: list[str], flags: int = 0) -> Iterator[tuple[list[str], list, int]]:
        """(names down to it, item, flags of it and what holds it) of each text."""
        for item in node[2]:
            if item[0] == "#":
                yield path, item, flags | item[1]
            elif item[0][0] != "!":
                yield from self._slots(item, [*path, ht.base(item[0])], flags | item[1])


#: A label, and if it alone doesn't tell: labels with child labels, what is repeated, and the place among them.
Step = tuple[str, tuple[list[tuple[str, frozenset[str]]], list[bool], int] | None]


def _step(node: list, k: int) -> Step:
    """The way to the k-th item of a wrapper node."""
    items = [i for i in node[2] if i[0] != "#"]
    own = node[2][k][0]
    if sum(i[0] == own for i in items) == 1:
        return own, None
    return own, ([(i[0], ht.shape(i)) for i in items], [bool(i[1] & ht.REPEATED) for i in items], sum(i[0] != "#" for i in node[2][:k]))


def _down(node: list, path: list[Step]) -> list[list]:
    """Elements that the steps lead to."""
    found = [node]
    for name, among in path:
        further = []
        for n in found:
            inner = list(_children(n))
            own = [c for c in inner if ht.label(c) == name]
            if among and len(own) > 1:
                items, repeated, k = among
                labels = [(ht.label(c), frozenset(map(ht.label, _children(c)))) for c in inner]
                own = [c for c, j in zip(inner, ht.matched(labels, items, repeated), strict=True) if j == k] or own
            further += own
        found = further
    return found


def _children(node: list) -> Iterator[list]:
    for child in node[1]:
        if not isinstance(child, str):
            if child[0] in ht.INLINE:
                yield from _children(child)
            else:
                yield child


def _by_itself(node: list) -> list:
    """The article of a tree without a wrapper."""
    for name in ("article", "main"):
        own = [n for n in _all(node) if n[0] == name]
        if own:
            return max(own, key=ht.mass)
    while True:
        total = ht.mass(node)
        inner = [(ht.mass(c), i, c) for i, c in enumerate(_children(node)) if c[0] in CONTAINERS]
        if not inner or not total:
            return node
        most, _, largest = max(inner, key=lambda x: (x[0], -x[1]))
        if most < SHARE * total:
            return node
        node = largest


def _all(node: list) -> Iterator[list]:
    for child in node[1]:
        if not isinstance(child, str) and child[0][0] != "!":
            yield child
            yield from _all(child)


def article(source: str | None, rule: Rule | None) -> str:
    """The main text: blocks in page order, joined by line ends."""
    if not source:
        return ""
    tree = ht.parse(source)
    own = _down(tree, rule.path) if rule and rule.path else []
    own = [n for n in own if ht.mass(n)]
    template = rule.template if rule and own else set()
    node = max(own, key=ht.mass) if own else _by_itself(tree)
    return "\n".join(text for text, path in ht.block_texts(node) if not template or (tuple(path), ht.constant(text)) not in template)


def extract(pages: DataFrame) -> DataFrame:
    """Every row of pages (page_id, url, html) with its main text."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    inferred = wrappers(pages)
    size = inferred.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string"

    def rows(batch: pa.RecordBatch, rules: dict[str, Rule]) -> pa.RecordBatch:
        urls = batch.column("url").to_pylist()
        out = [article(s, rules.get(host_of(u))) for u, s in zip(urls, batch.column("html").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.host: Rule(json.loads(r.wrapper)) for r in inferred.collect()})

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield rows(batch, shared.value)

        return pages.mapInArrow(step, schema)

    host = F.lower(F.regexp_extract("url", HOST, 1))
    hosted = pages.withColumn("host", F.coalesce(host, F.lit("")))
    # a host's pages in groups, each with one copy of its wrapper
    sizes = hosted.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    many = sizes.where("groups > 1")
    dealt = hosted.join(F.broadcast(many) if many.count() <= BROADCAST_HOSTS else many, "host", "left")
    dealt = dealt.withColumn("dealt", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("groups", F.lit(1)))).drop("groups")
    copies = inferred.join(sizes, "host").withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("host", "dealt", "wrapper")

    def group(own: pa.Table, wrapper: pa.Table) -> pa.Table:
        rules = {h: Rule(json.loads(w)) for h, w in zip(wrapper.column("host").to_pylist(), wrapper.column("wrapper").to_pylist(), strict=True)}
        own = own.combine_chunks()
        return pa.Table.from_batches([rows(b, rules) for b in own.to_batches()], schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]))

    return dealt.groupBy("host", "dealt").cogroup(copies.groupBy("host", "dealt")).applyInArrow(group, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one row per page."""
    found = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLE_SQL = None
