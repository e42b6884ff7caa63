"""Prefix trie of conversations, families first.

A conversation is rebuilt from the first turns of its family's base conversation and its own later turns. Families (a
base conversation and the up to 39 whose ids truncate to it; 20 where ids are not negative) are cogrouped with their
base, and each family's small trie is built by itself. Only its nodes are shuffled, by their key, and merged by sums and
minima that Spark combines before the shuffle. Turns are digests from the first step on, so texts are never shuffled.

What a family counts of a node that other families have too is counted more than once: subtree sums of such nodes
are put right by a second cogroup. Each shared node belongs to the family of its smallest member, which has the whole
path to the root, so that family adds the node's correction to all its ancestors.

Defined cases: rows without conv_id take no part; null role and text are empty; turns are ordered with null first, equal
turns of a conversation by their digest, and repeated rows are turns of their own; a conversation without turns left is
a member of the root, where it ends; families below zero are those that truncation gives (-39 to -20 belong to -20); an
empty table has no nodes, not even the root; other columns, whatever their names, are not read. A task holds one family,
with about 200 bytes a turn however long its text is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import table

FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
#: Children of a node are dealt to so many parts where the node's own values are joined to them.
SALTS = 512
#: Families whose ended members are joined into one row before the rows of a node are hashed in order.
ENDS_FAMILIES = 64

TURNS = "conv_id long, turn long, digest binary, n_words long, family long"
NODES = "family long, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, words long, n_children long, n_leaves long, saved long, ends string"


def family_of(conv: Column) -> Column:
    return conv - conv % F.lit(FAMILY)


def turns(conversations: DataFrame) -> DataFrame:
    """A digest, a word count and a family for each turn. The role's length stands first, so role and text can't run into each other."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    conv = F.col("conv_id").cast("long")
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    return conversations.where("conv_id is not null").select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), family_of(conv).alias("family"))


def heads_of(conv: int) -> int:
    """How many turns of the base conversation stand first."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _conversations(own: pa.Table) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """(conv_id, its turns in order as digest and words), by conv_id."""
    order = pc.sort_indices(own.select(["conv_id", "turn", "digest"]), sort_keys=[("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start")
    own = own.take(order)
    convs = own["conv_id"].to_pylist()
    rows = list(zip(own["digest"].to_pylist(), own["n_words"].to_pylist(), strict=True))
    low = 0
    for at in range(1, len(convs) + 1):
        if at == len(convs) or convs[at] != convs[low]:
            yield convs[low], rows[low:at]
            low = at


def family_trie(base: pa.Table, others: pa.Table) -> pa.Table:
    """The trie of one family: rebuilt conversations as paths, with counts and subtree sums as far as the family knows them."""
    known = dict(_conversations(base)) | dict(_conversations(others))
    family = (base if len(base) else others)["family"][0].as_py()
    head = known.get(family, [])
    ids: dict[tuple[int, bytes], int] = {}
    keys, parents, depths, counts, least, words, ends = [ROOT], [0], [0], [0], [None], [0], [[]]
    for conv in sorted(known):
        h = heads_of(conv)
        at = 0
        path = [0]
        for digest, n in (*head[:h], *known[conv][h:]):
            child = ids.get((at, digest))
            if child is None:
                child = ids[at, digest] = len(keys)
                keys.append(hashlib.sha256(keys[at] + digest).digest()[:16])
                parents.append(at)
                depths.append(depths[at] + 1)
                counts.append(0)
                least.append(None)
                words.append(n)
                ends.append([])
            at = child
            path.append(at)
        for node in path:
            counts[node] += 1
            if least[node] is None:
                least[node] = conv
        ends[at].append(conv)
    children, leaves = [0] * len(keys), [0] * len(keys)
    saved = [(n - 1) * w for n, w in zip(counts, words, strict=True)]
    for node in range(len(keys) - 1, -1, -1):  # children come after their parents
        if not children[node]:
            leaves[node] = 1
        if node:
            up = parents[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    n = len(keys)
    out = {
        "family": pa.array([family] * n, pa.int64()), "key": pa.array(keys, pa.binary()), "parent": pa.array([keys[p] for p in parents], pa.binary()),
        "depth": pa.array(depths, pa.int64()), "conv_id": pa.array(least, pa.int64()), "parent_conv_id": pa.array([least[p] for p in parents], pa.int64()),
        "n_convs": pa.array(counts, pa.int64()), "words": pa.array(words, pa.int64()), "n_children": pa.array(children, pa.int64()),
        "n_leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64()),
        "ends": pa.array([",".join(map(str, e)) if e else None for e in ends], pa.string()),
    }
    return pa.table(out)


def family_nodes(own: DataFrame) -> DataFrame:
    """NODES of every family: base conversations and the others, cogrouped by base id."""
    is_base = F.col("conv_id") == F.col("family")
    side = lambda df: df.select("family", "conv_id", "turn", "digest", "n_words").groupBy("family")
    return side(own.where(is_base)).cogroup(side(own.where(~is_base))).applyInArrow(family_trie, NODES)


def _upwards(nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """The corrections of the shared nodes that this family owns, added up at each of their ancestors."""
    fix = {k: (c, n, s) for k, c, n, s in zip(*(owned[c].to_pylist() for c in ("key", "children", "leaves", "saved")), strict=True)}
    rows = sorted(zip(*(nodes[c].to_pylist() for c in ("depth", "key", "parent")), strict=True), reverse=True)
    sums: dict[bytes, list[int]] = {}
    for depth, key, parent in rows:
        own = fix.get(key)
        if own:
            total = sums.setdefault(key, [0, 0, 0])
            total[1] += own[1]
            total[2] += own[2]
            if depth:
                sums.setdefault(parent, [0, 0, 0])[0] += own[0]
        total = sums.get(key)
        if total and depth:
            up = sums.setdefault(parent, [0, 0, 0])
            up[1] += total[1]
            up[2] += total[2]
    return pa.table({"key": pa.array(list(sums), pa.binary()), **{n: pa.array([s[i] for s in sums.values()], pa.int64()) for i, n in enumerate(("less_children", "less_leaves", "more_saved"))}})


def merged(nodes: DataFrame) -> DataFrame:
    """One row a node over all families, sums still as the families have them."""
    total = lambda c: F.sum(c).alias(c)
    least = lambda c: F.min(c).alias(c)
    return nodes.groupBy("key").agg(
        F.any_value("parent").alias("parent"), least("depth"), least("conv_id"), least("parent_conv_id"), F.max("words").alias("words"),
        *map(total, ("n_convs", "n_children", "n_leaves", "saved")), F.count("*").alias("families"), F.count_if(F.col("n_children") == 0).alias("childless"),
    )


def corrections(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """key with what its subtree, and its children, were counted too often."""
    again = F.col("families") - 1
    owned = shared.select(family_of(F.col("conv_id")).alias("family"), "key", again.alias("children"), (F.col("childless") - (F.col("childless") == F.col("families")).cast("long")).alias("leaves"), (again * F.col("words")).alias("saved"))
    paths = nodes.select("family", "key", "parent", "depth").join(owned.select("family").distinct(), "family", "left_semi")
    parts = paths.groupBy("family").cogroup(owned.groupBy("family")).applyInArrow(_upwards, "key binary, less_children long, less_leaves long, more_saved long")
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("less_children", "less_leaves", "more_saved")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sha256 of its rows' ids, which come in order: rows of a key are next to each other, and none is kept."""
    key, state = None, None
    for batch in batches:
        keys, out = [], []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                out.append(state.hexdigest())
            key, state = own, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(nodes: DataFrame) -> DataFrame:
    """key, sha256 of the ids of conversations that end there, ascending. Families are disjoint ranges of ids, so their lists are joined in order."""
    bucket = F.floor(F.col("family") / (FAMILY * ENDS_FAMILIES))
    lists = F.array_sort(F.collect_list(F.struct("family", "ends")))
    joined = nodes.where("ends is not null").groupBy("key", bucket.alias("bucket")).agg(F.array_join(F.transform(lists, lambda x: x["ends"]), ",").alias("ids"))
    return joined.repartition("key").sortWithinPartitions("key", "bucket").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: node and parent (hex keys), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Intermediate tables are written to the shared folder, so an executor that is lost costs a re-read.
    """
    nodes = stored(family_nodes(stored(turns(conversations))))
    every = stored(merged(nodes))
    shared = every.where("families > 1")
    # The smallest member of a shared parent may belong to another family; children of one parent are dealt out by a salt.
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")
    wanted = every.where("depth > 0").select("parent", salt).distinct()
    above = wanted.join(shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("shared_parent")), "parent")
    out = every.withColumn("salt", salt).join(above, ["parent", "salt"], "left").join(corrections(nodes, shared), "key", "left").join(ends(nodes), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.lower(F.hex("key")).alias("node"), F.when(F.col("depth") > 0, F.lower(F.hex("parent"))).alias("parent"), "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("shared_parent", "parent_conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("n_children") - zero("less_children")).alias("n_children"), (F.col("n_leaves") - zero("less_leaves")).alias("n_leaves"),
        (F.col("saved") + zero("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text of every rebuilt conversation, in DataFrame operations."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    own = turns(conversations.withColumns({"role": role, "text": text}))  # the order of equal turns is that of their digests
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    rows = rows.withColumn("digest", digest).withColumn("place", F.row_number().over(w) - 1).drop("digest", "turn")
    heads = rows.where((F.col("place") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    convs = own.select("conv_id", "family").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    sizes = heads.groupBy("family").agg(F.count("*").alias("size"))
    convs = convs.join(sizes, "family", "left").withColumn("size", F.least("h", F.coalesce("size", F.lit(0))))
    first = convs.join(heads, "family").where("place < h").select("conv_id", F.col("place").cast("long").alias("position"), "role", "text")
    later = rows.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("size")).cast("long").alias("position"), "role", "text")
    return first.unionByName(later)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of trie() with role and text of their last turn, null for the root."""
    last = rebuilt(conversations).withColumn("depth", F.col("position") + 1).drop("position")
    return nodes.join(last, ["conv_id", "depth"], "left")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: one row per node."""
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).select(*COLUMNS)


ORACLE_SQL = r"""
with t as (select conv_id as c, role, text, sha256(length(role) || ':' || role || text) as g, turn from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
o as (select c, row_number() over (partition by c order by turn nulls first, g) - 1 as p, g, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) as w from t),
v as (select c, xor(list_reduce([4294967295::ubigint] || list_transform(range(8 * strlen(c::varchar)), lambda i: case when i % 8 = 0 then ascii(substr(c::varchar, (i // 8 + 1)::int, 1)) else 0 end::ubigint),
    lambda a, x: case when xor(a, x) & 1 = 1 then xor(xor(a, x) >> 1, 3988292384::ubigint) else xor(a, x) >> 1 end), 4294967295::ubigint) % 4 as h from (select distinct c from o)),
n as (select v.c, v.h, least(v.h, (select count(*) from o where o.c = v.c - v.c % 20)) as m from v),
r as (select n.c, o.p as q, o.g, o.w from n join o on o.c = n.c - n.c % 20 and o.p < n.h union all select n.c, o.p - n.h + n.m, o.g, o.w from n join o on o.c = n.c and o.p >= n.h),
k as (select c, q + 1 as d, w, sha256(string_agg(g, '' order by q) over (partition by c order by q)) as k from r),
a as (select c, d, w, k, coalesce(lag(k) over (partition by c order by d), 'root') as up from k union all select c, 0, 0, 'root', null from n),
u as (select k, min(c) as c, any_value(d) as d, any_value(up) as up, count(*) as m, any_value(w) as w from a group by k),
b as (select up, count(*) as n from u where up is not null group by up),
e as (select k, string_agg(c::varchar, ',' order by c) as ids from (select c, k, d = max(d) over (partition by c) as last from a) where last group by k),
s as (select x.k, count(*) filter (where b.n is null) as leaves, sum((u.m - 1) * u.w) as saved from u left join b on b.up = u.k join a x on x.c = u.c and x.d <= u.d group by x.k)
select u.c::bigint as conv_id, u.d::bigint as depth, y.c::bigint as parent_conv_id, u.m::bigint as n_convs, coalesce(b.n, 0)::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from u left join u y on y.k = u.up left join b on b.up = u.k join s on s.k = u.k left join e on e.k = u.k
"""
