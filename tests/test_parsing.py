"""The trained tagger and parser on rows left out, and triples over heads against SQL."""

import duckdb
from compare import rows_of
from pyspark.sql import functions as F

from quillgraph.operators import parsing
from quillgraph.operators import triples as tr
from quillgraph.plans import flows


def test_trees_of_the_table_are_reached():
    for s in parsing.sentences():
        gold, n = [0, *(h for _, _, h in s), -2], len(s)
        stack, at, heads, kids = [0], 1, [-1] * (n + 2), {}
        while at <= n:
            move = parsing.right_move(gold, stack, at, heads)
            assert move in parsing.moves(stack, at, n, heads), s
            at = parsing.apply(move, stack, at, heads, kids)
        assert [max(h, 0) for h in heads[1 : n + 1]] == gold[1 : n + 1], s


def test_accuracy_on_sentences_left_out():
    own = parsing.sentences()
    tags = heads = total = 0
    for k in range(5):
        model = parsing.train([s for i, s in enumerate(own) if i % 5 != k])
        for s in own[k::5]:
            words = [w for w, _, _ in s]
            found = model.tag(words)
            tags += sum(a == t for a, (_, t, _) in zip(found, s, strict=True))
            heads += sum(a == h for a, (_, _, h) in zip(model.heads(words, found), s, strict=True))
            total += len(s)
    print("tags", tags / total, "heads", heads / total)
    assert tags / total > 0.75 and heads / total > 0.7
    assert parsing.train().tag([]) == [] and parsing.train().heads([], []) == []


def test_triples_over_heads(spark):
    rows = [(1, "A small dog chased the black cat in London."), (2, "Mary gave the boy an apple"), (3, None), (4, ""), (5, "the old bridge"), (6, "word " * 20_000)]
    parsed = parsing.parse(spark.createDataFrame(rows, "id long, phrase string")).cache()
    got = {r.id: [tuple(x) for x in r.t] for r in parsed.select("id", parsing.svo(F.col("parsed")).alias("t")).where("id <> 6").collect()}
    assert ("small dog", "chased", "black cat") in got[1] and ("Mary", "gave", "apple") in got[2]
    assert got[3] == got[4] == got[5] == [] and parsed.where("id = 6").first().parsed[0].word == "word"


def test_triples_equal_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    own = spark.createDataFrame([(i + 10**6, " ".join(w for w, _, _ in s)) for i, s in enumerate(parsing.sentences())], "id long, phrase string")
    phrases = tr.phrases_of(docs).select(F.xxhash64("doc_id", "phrase_id").alias("id"), "phrase").unionByName(own)
    parsed = parsing.parse(phrases).cache()
    got = parsed.select("id", F.explode(parsing.svo(F.col("parsed"))).alias("t")).select("id", "t.*")
    parsed_rows = parsed.select("id", F.posexplode("parsed").alias("i", "t")).select("id", (F.col("i") + 1).alias("place"), "t.*").toPandas()
    con = duckdb.connect()
    con.register("parsed", parsed_rows)
    cur = con.execute(parsing.SVO_SQL)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(got.columns, got.collect()) == want and len(want) > 50


def test_provider(spark):
    docs = spark.createDataFrame([(1, "The company builds electric cars.")], "doc_id long, text string")
    own = flows.Providers(tagger=flows.trained_tags, parser=flows.trained_parser)  # the validator goes by the tagger's tags
    assert ("company", "builds", "electric cars") in {tuple(t) for t in flows.triples_only(docs, own).first().triples}
    assert flows.triples_only(docs, flows.Providers(tagger=flows.trained_tags)).count() == 1


def test_many_phrases_at_a_time_read_as_one_by_one():
    model = parsing.train(rounds=3)
    lines = [" ".join(w for w, _, _ in s) for s in parsing.sentences()] + ["", "...", "Zorb", "7 of 9", "^ $", "the Flarn quibbled " * 40, "Él no vio nada — nunca más"]
    words = [parsing.WORD.findall(x) for x in lines]
    reader = parsing.Reader(model.tagger, model.parser)
    reader.MOST = 20  # memories are emptied on the way
    for low in range(0, len(words), 16):
        for own, path in zip(words[low : low + 16], reader.tags(words[low : low + 16]), strict=True):
            tags = [model.tagger.tags[t] for t in path]
            assert tags == model.tag(own) and reader.heads(own, tags) == model.heads(own, tags)
