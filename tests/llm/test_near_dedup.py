import random
import time

import numpy as np

from quillgraph.llm import minhash, near_dedup
from quillgraph.llm.components import components
from quillgraph.session import DROP_SHUFFLES, checkpoint_folder


def brute(rows):
    """Components of the contract, by comparing all pairs; rows that share a doc_id are one document."""
    sets = []
    for _, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (100 * shared >= 75 * len(sets[i] | sets[j]) or rows[i][0] is not None and rows[i][0] == rows[j][0]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def corpus(n=260, hot=70):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], rng.choices(vocabulary, k=160)
    for d in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(1, 200))
        if d < hot:
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(160)] = rng.choice(vocabulary)
        elif rows and rng.random() < 0.4:
            words = rng.choice(rows)[1].split() or ["x"]
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((d * 7 % 1009, " ".join(words)))
    return rows + [(5001, None), (5002, ""), (5003, " \n"), (None, None), (None, rows[0][1]), (None, "only here"), (rows[3][0], rows[3][1]), (5004, "A B"), (5005, "a  b")]


def test_matches_all_pairs(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    want = sorted(brute(rows), key=str)
    for small, block in ((32, 512), (3, 5)):
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = near_dedup.near_duplicates(docs).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_estimates_are_close():
    rng = random.Random(2)
    a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    b = list(a)
    for i in range(0, 400, 40):
        b[i] = "new"
    x, y = (minhash.shingles(" ".join(w).encode()) for w in (a, b))
    shared = len(set(x.tolist()) & set(y.tolist()))
    bits = [np.frombuffer(minhash.odd_sketch(minhash.samples(s)), np.uint8) for s in (x, y)]
    assert abs(minhash.estimate(minhash.population(*bits)) - shared / (len(x) + len(y) - shared)) < 0.12
    assert near_dedup.intersections([x, y], 1, slab=64)[0, 1] == shared


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 0


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f", 3), (1, "a b c d e f", 3), (2, "A b c d e f", 4), (3, None, 5), (None, "q", 6)], "doc_id long, text string, kept long")
    got = near_dedup.stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, None]


def files(spark, kind):
    """Names of the shuffle blocks on this machine, or of the folders in the shared one."""
    if kind == "shuffles":
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")}
    at = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_folder(spark))
    there = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = set()
    for top in (at, spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())):
        out |= {x.getPath().getName() for x in there.listStatus(top)}
    return out


def test_disk_is_given_back(spark, sf_dir):
    """Only the result's own tables and no shuffle stay on disk, however many rounds there were."""
    rows = corpus(40, 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, shuffles = files(spark, "shared"), files(spark, "shuffles")
    left = near_dedup.near_duplicates(docs)
    until = time.time() + 10
    while files(spark, "shuffles") - shuffles and time.time() < until:
        time.sleep(0.2)
    assert not files(spark, "shuffles") - shuffles
    assert len(files(spark, "shared") - before) == 1 and left.count() == len(rows)
    assert spark.conf.get(DROP_SHUFFLES) == "false"
    before = files(spark, "shared")
    near_dedup.stage(spark, docs, sf_dir)
    assert len(files(spark, "shared") - before) == 2


def test_stars_take_no_rounds_and_chains_some(spark):
    """Edges that are stars already are handed on at once; other graphs get the least node reachable."""
    rng = random.Random(4)
    for name, edges in (("stars", [(10 * i + k, 10 * i) for i in range(40) for k in range(1, 6)]), ("chain", [(i + 1, i) for i in range(60)]), ("ring", [(i, (i + 1) % 9) for i in range(9)]), ("mixed", [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]), ("none", [])):
        least = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in least:
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        spark.sparkContext.setJobGroup(f"components-{name}", name)
        got = components(spark.createDataFrame(edges, "a long, b long"))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{name}"))
        assert {tuple(r) for r in got.collect()} == set(least.items())
        assert got.count() == len(least)
        assert name != "stars" or jobs <= 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(25):
        same = rng.random((4000, minhash.SAMPLES)) < near_dedup.PERCENT / 100
        at = rng.integers(0, minhash.SKETCH_BITS, (4000, 2, minhash.SAMPLES))
        row = np.repeat(np.arange(4000), minhash.SAMPLES).reshape(4000, -1)
        flips = np.zeros((4000, minhash.SKETCH_BITS), np.int32)
        for side in (0, 1):
            np.add.at(flips, (row[~same], at[:, side][~same]), 1)
        lost += (minhash.estimate((flips & 1).sum(axis=1)) < near_dedup.PERCENT / 100 - near_dedup.MARGIN).sum()
    assert lost <= 1  # of 100 000
