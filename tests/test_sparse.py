from quillgraph.sources import sparse

NAMES = {"C": "corporate", "E": "economics", "E1": "output"}


def test_rows_and_codes_of_lines(spark, tmp_path):
    (tmp_path / "rows.dat").write_text("1  3:0.5 9:-1e-2 7:2\n\nx 1:1\n2\n3 4:x 5 6:.25 8:0\n")
    got = {r.doc_id: [tuple(t) for t in r.terms] for r in sparse.read_rows(spark, f"{tmp_path}/rows.dat").collect()}
    assert got == {1: [(3, 0.5), (9, -0.01), (7, 2.0)], 2: [], 3: [(6, 0.25), (8, 0.0)]}
    rows = sparse.read_rows(spark, f"{tmp_path}/rows.dat")
    sparse.write_rows(rows, f"{tmp_path}/again")
    assert sorted(map(str, sparse.read_rows(spark, f"{tmp_path}/again").collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "codes").write_text("C11 1 1\nE12 1 1\nE12 2 1\nbad\nE21 3 1\nC15 99 1\nZ 3 1\n")
    codes = sparse.read_codes(spark, f"{tmp_path}/codes")
    assert sorted(map(tuple, codes.collect())) == [("C11", 1), ("C15", 99), ("E12", 1), ("E12", 2), ("E21", 3), ("Z", 3)]
    found = sparse.corpus(rows, codes, NAMES, 10).collect()
    assert {(r.original_index, r.category, r.feature_count, tuple(r.top_terms)) for r in found} == {
        (1, "corporate", 3, (7, 3, 9)), (1, "economics", 3, (7, 3, 9)), (1, "output", 3, (7, 3, 9)), (2, "economics", 0, ()), (2, "output", 0, ()), (3, "economics", 1, (6, 8)),
    }
    assert {(r.doc_id, r.text) for r in found} == {(f"doc_{i}", f"doc_document_{i}") for i in (1, 2, 3)}
    assert sparse.corpus(rows, codes, NAMES, 1).groupBy("category").count().where("count > 1").isEmpty()
    assert sparse.corpus(rows.limit(0), codes, NAMES, 10).count() == 0 and sparse.corpus(rows, codes.limit(0), NAMES, 10).count() == 0


def test_ties_and_long_rows(spark):
    rows = spark.createDataFrame([(1, [(t, float(t % 3)) for t in range(200)]), (2, None)], f"doc_id long, terms {sparse.TERMS}")
    top = {r.doc_id: r.top for r in rows.select("doc_id", sparse.top_terms("terms").alias("top")).collect()}
    assert top == {1: [t for t in range(200) if t % 3 == 2][:50], 2: None}
    codes = spark.createDataFrame([("C", 2), ("C", 2), (None, 1)], "code string, doc_id long")
    assert [(r.original_index, r.feature_count) for r in sparse.corpus(rows, codes, NAMES, 5).collect()] == [(2, 0)]
