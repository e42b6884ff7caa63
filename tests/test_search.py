"""Model search: draws, boosted trees, failures as rows, measures against SQL and plain sums."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import search
from quillgraph.plans import flows

SMALL = {"n_estimators": 3, "max_depth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [(i, i % 3, [float(i % 3) + rng.gauss(0, 0.2), rng.random()]) for i in range(150)]
    return spark.createDataFrame(made, "key long, label int, features array<double>").cache()


def test_draws():
    own = search.draws(search.SPACE, 20)
    assert len({str(d) for d in own}) == 20 and own == search.draws(search.SPACE, 20) and own != search.draws(search.SPACE, 20, 1)
    two = {"a": [1, 2], "b": [3, 4, 5]}
    assert sorted(map(str, search.draws(two, 99))) == sorted(map(str, search.grid(two))) and len(search.grid(two)) == 6


def test_boosted_one_against_rest(spark, rows):
    got = search.boosted(rows.where("key < 120"), rows.where("key >= 120"), SMALL).select("key", "label", "probabilities", "pred").collect()
    assert len(got) == 30 and sum(r.pred == r.label for r in got) > 24
    assert all(sum(r.probabilities) == pytest.approx(1) and r.pred == r.probabilities.index(max(r.probabilities)) for r in got)
    two = rows.where("label < 2")
    got = search.boosted(two, two, SMALL).collect()
    assert all(len(r.probabilities) == 2 for r in got) and sum(r.pred == r.label for r in got) > 90
    with pytest.raises(ValueError):
        search.boosted(rows.where("label = 1"), rows, SMALL)


def test_auc_equals_sql(rows):
    got = search.boosted(rows.where("key < 90"), rows.where("key >= 90"), SMALL).select("key", "label", "probabilities", "pred")
    predicted = got.toPandas()  # noqa: F841  read by name
    pairs = """with s as (select label, unnest(range(3)) as c, unnest(probabilities) as p from predicted)
        select avg(a) from (select x.c, avg(case when x.p > y.p then 1.0 when x.p = y.p then 0.5 else 0 end) as a from s x join s y on x.c = y.c and x.label = x.c and y.label <> y.c group by x.c)"""
    assert search.macro_auc(got).first()["auc"] == pytest.approx(duckdb.sql(pairs).fetchall()[0][0])
    assert search.measured(got)["accuracy"] == pytest.approx((predicted["label"] == predicted["pred"]).mean())


def test_search_keeps_failures_as_rows(rows):
    found = search.search(rows, "key", [SMALL, SMALL | {"max_depth": 99}, SMALL | {"n_estimators": 1}], k=2, parallel=2)
    got = {r.draw: r for r in found.collect()}
    assert len(got) == 3 and got[1].log_loss is None and "maxDepth" in got[1].error and not got[1].best
    assert sum(r.best for r in got.values()) == 1
    best = min((r for r in got.values() if r.error is None), key=lambda r: r.log_loss)
    assert best.best and search.winner(found) == (SMALL if best.draw == 0 else SMALL | {"n_estimators": 1})
    with pytest.raises(ValueError):
        search.winner(found.where("draw = 1"))


def test_embedding_by_auc(rows):
    blind = rows.withColumn("features", F.array(F.lit(0.0), F.get("features", F.lit(1))))
    got = {r.config: r for r in search.by_auc({0: blind, 1: rows, 2: rows.select("key", "label", F.lit(None).cast("array<double>").alias("features"))}, "key", SMALL).collect()}
    assert got[1].best and got[1].downstream_auc > 0.8 > got[0].downstream_auc and got[2].error and not got[2].best


def test_final_report(rows):
    got = search.final(rows, "key", SMALL, k=4)
    test, predicted = got["test"].first(), got["predictions"].collect()
    assert len(predicted) == 30 and test.accuracy == pytest.approx(sum(r.pred == r.label for r in predicted) / 30)
    assert sum(r.n for r in got["confusion"].collect()) == 30 and got["folds"].count() == 4 and got["report"].count() == 3
    assert {r.measure: 0 < r.mean <= 1 for r in got["summary"].collect()} == {"accuracy": True, "auc": True}


def test_flow_by_auc(spark):
    triples = spark.createDataFrame([(f"s{i % 8}", "r" if i % 2 else "q", f"o{i % 10}", i % 2) for i in range(80)], "subject string, relation string, object string, label int")
    configs = [{"config": i, "model": m, "dim": 4, "rate": 0.1, "epochs": 1} for i, m in enumerate(("distmult", "transe"))]
    out = flows.classify_by_auc(triples, configs, draws=[SMALL], k=2, judge=SMALL)
    assert out["choice"].count() == 2 and out["choice"].where("best").count() == 1 and out["scaling_summary"].first().n == 2
    assert out["test"].count() == 1 and out["search"].where("best").count() == 1
