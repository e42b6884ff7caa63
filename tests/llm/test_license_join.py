import random
import re

import duckdb

from quillgraph.llm import license_join as lj


def brute(text):
    words = re.findall(lj.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in lj.PHRASES.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        starts += at
        labels |= {label} if at else set()
    every, best = set(labels), 0.0
    for label, template in lj.TEMPLATES:
        t, span = set(template.split()), len(template.split())
        for i in range(len(words)):
            own = set(words[i : i + span])
            if 100 * len(own & t) >= lj.THRESHOLD * len(t):
                every.add(label)
                best = max(best, len(own & t) / len(t))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if starts else best


def texts():
    rng = random.Random(6)
    vocabulary = sorted({w for _, t in lj.TEMPLATES for w in t.split()}) + ["x", "é", "licenses", "MIT", "GENERAL"]
    out = [None, "", " ".join(t for _, t in lj.TEMPLATES).replace(" ", "\n"), "\n\n", "mit license mit license", "MIT\nLicense; general public-license", "mit licensee", "the the license", "general general public license license"]
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice(lj.TEMPLATES)[1].split()
            rng.shuffle(own)
            own = own[: max(1, int(len(own) * rng.choice([0.5, 0.75, 0.8, 0.9, 1])))] + rng.choices(vocabulary, k=rng.randrange(0, 6))
            lines.append(rng.choice([" ", ", ", "-"]).join(own if rng.random() < 0.8 else rng.choices(vocabulary, k=12)))
        out.append(rng.choice(["\n", "\n\n"]).join(lines))
    return out


def test_matches_brute_force(spark):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts())]
    rows.append(rows[40])
    got = lj.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, *brute(t)) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_notices_over_several_lines_and_in_long_texts(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\n * conditions are met:"
    long = "the of in " * 100_000
    rows = [(1, bsd), (2, long + bsd), (3, bsd.replace("\n", " x\n")), (4, long)]
    got = {r.doc_id: (r.labels, r.score) for r in lj.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == ("bsd", 1.0) and got[3][0] == "bsd" and 0.8 <= got[3][1] < 1 and got[4] == ("", 0.0)


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(lj.ORACLE_SQL).fetchall()
    got = lj.query(spark, sf_dir)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(bool(r[6]) for r in want) > 0


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, row string, label string")
    assert lj.scan(docs).count() == 0
    plan = lj.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
