"""Each stage of the pipeline against the contract of its operator, read literally, on a small table."""

import public_tokenizers
import pytest
from test_decontaminate import brute_force
from test_near_dedup import brute
from tokenizers import Tokenizer

import corpus_pipeline
from quillgraph.llm import pii_crf
from quillgraph.llm.common import BATCH_ROWS, alnum_words, short_batches


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows after each stage, by name, and the folder."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    odd = spark.createDataFrame([(900, None, "en", "s", None), (901, "12 34 !!", None, "s", 8), (902, "mail me: a.b@c.de or 1.2.3.4", "en", None, 28)], docs.schema)
    docs.unionByName(odd).unionByName(docs.where("doc_id = 3")).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = {"start": spark.read.parquet(f"{folder}/documents.parquet")}
    now = out["start"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{i}")
        now = out[name] = spark.read.parquet(f"{folder}/{i}")
    return {k: v.collect() for k, v in out.items()}, str(folder)


def test_columns_and_order(stages):
    rows, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    for name in ("language_id", "near_dedup", "decontamination", "pii"):
        assert rows[name][0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_id_rejects_only_what_has_no_letters(stages):
    rows, _ = stages
    gone = {r.doc_id for r in rows["start"]} - {r.doc_id for r in rows["language_id"]}
    assert gone == {r.doc_id for r in rows["start"] if not any(c.isalpha() for c in r.text or "")} >= {900, 901}


def test_near_dedup_keeps_one_of_each_group(stages):
    rows, _ = stages
    want = sorted({c if c is not None else d for d, _, c in brute([(r.doc_id, r.text) for r in rows["language_id"]])})
    assert sorted(r.doc_id for r in rows["near_dedup"]) == want


def test_decontamination_leaves_no_window_and_other_words_alone(stages, spark):
    rows, folder = stages
    items = [(r.item_id, alnum_words((r.text or "").encode())) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    after = {r.doc_id: r.text for r in rows["decontamination"]}
    for r in rows["near_dedup"]:
        words = alnum_words(r.text.encode())
        hit, _ = brute_force(words, items)
        if 2 * hit > len(words):
            assert r.doc_id not in after
        elif not hit:
            assert after[r.doc_id] == r.text
        else:
            left = alnum_words(after[r.doc_id].encode())
            assert len(left) == len(words) - hit and brute_force(left, items)[0] == 0


def test_pii_is_masked_and_all_documents_stay(stages):
    rows, _ = stages
    before = {r.doc_id: r.text for r in rows["decontamination"]}
    assert {r.doc_id for r in rows["pii"]} == set(before)
    for r in rows["pii"]:
        assert pii_crf.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not any(c.isdigit() or c == "@" for c in before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_ids_are_those_of_the_library(stages):
    rows, _ = stages
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(rows["bpe"]) == len(rows["pii"])
    for r in rows["bpe"]:
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert t.decode(r.ids, skip_special_tokens=False) == r.text


def test_run(spark, stages):
    rows, folder = stages
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(r.doc_id for r in rows["bpe"])


def test_batches_are_short_unless_the_session_says_otherwise(spark):
    """short_batches sets the rows of an Arrow batch only where none are set."""
    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.unset(BATCH_ROWS)
        short_batches(spark)
        assert spark.conf.get(BATCH_ROWS) == "1000"
        short_batches(spark, 7)
        assert spark.conf.get(BATCH_ROWS) == "1000"
    finally:
        spark.conf.set(BATCH_ROWS, before)
