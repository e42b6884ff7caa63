import random

from quillgraph.operators import quota


def greedy(rows, size):
    full, out = {}, set()
    for doc in sorted({r[0] for r in rows if r[0] is not None}):
        for _, c in sorted((p, c) for d, p, c in rows if d == doc and c is not None):
            if full.get(c, 0) < size:
                full[c] = full.get(c, 0) + 1
                out.add((doc, c))
                break
    return out


def test_equals_the_greedy_loop(spark):
    rng = random.Random(2)
    rows = [(d, p, c) for d in range(120) for p, c in enumerate(rng.sample("abcdefg", rng.randrange(1, 5)))]
    rows += [(5, 9, "a"), (None, 0, "a"), (7, 8, None), (3, 7, "z"), (3, 7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, place int, category string").repartition(5)
    for size in (1, 4, 30, 500):
        assert {tuple(r) for r in quota.fill(df, size).collect()} == greedy(rows, size), size
    assert quota.fill(df, 0).count() == 0 and quota.fill(df.limit(0), 3).count() == 0


def test_one_category_for_all(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "0 as place", "'x' as category").union(spark.range(3000).selectExpr("id", "1", "'y'"))
    got = quota.fill(df, 1000).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in got} == {"x": 1000, "y": 1000}
