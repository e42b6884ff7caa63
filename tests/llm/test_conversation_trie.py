import hashlib
import random
import zlib
from collections import defaultdict

from compare import connect, difference

from quillgraph.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    """conv_id -> its rebuilt turns, spelled out."""
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def brute(rows):
    paths = rebuild(rows)
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ended[tuple(paths[c])].append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(m[:-1] == n for m in members if m)
        saved = sum((len(members[n]) - 1) * len(words(n[-1][1])) for n in below if n)
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(m) == len(node) + 1 for m in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ended[node])).encode()).hexdigest()))
    return out


def words(text):
    return [w for w in text.translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]


def got(spark, rows):
    made = ct.trie(spark.createDataFrame(rows, SCHEMA)).select(*ct.COLUMNS).collect()
    assert len({tuple(r) for r in made}) == len(made)
    return {tuple(r) for r in made}


def test_matches_brute_force_across_families(spark):
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 130, 3), 20, 40, 2001, 2000, 4005]:
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "system"]), rng.choice(["a b", "a  c\n", "d"])))
    rows += [(500 + 20 * i, t, "user", f"same {t}") for i in range(12) for t in range(6)]  # copies over families
    rows += [(900, None, None, None), (900, 1, None, "x"), (900, 1, "user", "x"), (900, 1, "user", "x"), (None, 0, "user", "lost")]
    assert got(spark, rows) == brute(rows)


def test_turnless_long_and_empty(spark):
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent
    long = [(60, t, "user", "w " * 3) for t in range(700)] + [(61, t, "assistant", "w " * 3) for t in range(700)] + [(80, t, "user", "w " * 3) for t in range(699)] + [(100, 0, "user", "z " * 300_000)]
    rows = [(turnless, 0, "user", "a"), *long]
    made = {r.conv_id: r for r in ct.trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 0").collect()}
    assert list(made) == [turnless] and made[turnless].n_convs == 5
    paths = rebuild(rows)
    assert paths[turnless] == []
    nodes = ct.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(nodes) == len({tuple(p[:d]) for p in paths.values() for d in range(len(p) + 1)})
    assert made[turnless].ends_sha256 == hashlib.sha256(str(turnless).encode()).hexdigest()
    assert ct.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark, [(None, 1, "user", "x")]) == set()


def test_negative_ids_are_in_order(spark):
    rows = [(c, 0, "user", "a") for c in (-1300, -45, -21, -20, -1, 0, 19, 1280)]
    first = got(spark, rows)
    root = next(r for r in first if r[1] == 0)
    assert root[0] == -1300 and root[3] == 8
    kept = [c for c, ts in ((c, rebuild_sql(rows, c)) for c in sorted(r[0] for r in rows)) if not ts]
    assert root[7] == hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest()


def rebuild_sql(rows, c):
    """The rebuilt turns of c where ids truncate to their base."""
    own = {r[0]: [r[2:]] for r in rows}
    base = int(c / 20) * 20
    h = zlib.crc32(str(c).encode()) % 4
    return own.get(base, [])[:h] + own[c][h:]


def test_turns_of_nodes_and_clashing_columns(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "u"), (3, 0, "user", "x"), (3, 1, "user", "y"), (3, 2, None, None), (3, 3, "user", "z")]
    wide = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", family long, KEY string, n_words long")
    nodes = ct.with_turns(ct.trie(wide), wide).collect()
    paths = {c: p for c, p in rebuild(rows).items()}
    assert {(r.conv_id, r.depth): (r.role, r.text) for r in nodes if r.depth} == {(r.conv_id, r.depth): paths[r.conv_id][r.depth - 1] for r in nodes if r.depth}
    assert [(r.role, r.text) for r in nodes if not r.depth] == [(None, None)]
    got = defaultdict(list)
    for r in sorted(ct.rebuilt(wide).collect(), key=lambda r: r.position):
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == {c: p for c, p in paths.items() if p}


def test_matches_sql(spark, sf_dir):
    assert difference(ct.query(spark, sf_dir), connect(sf_dir), ct.ORACLE_SQL) is None
