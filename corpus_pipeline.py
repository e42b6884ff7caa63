"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Language ID drops what it rejects, near-dedup keeps one document of each group, decontamination cuts benchmark
windows out of texts (and drops texts that are mostly such), PII spans are replaced by their kind, and the last stage
adds token ids.

Defined cases: documents with null, empty or letterless text go in the first stage; rows of one doc_id count once, rows
without doc_id stay; an empty table goes through empty; other columns, whatever their names, pass all stages, but that
n_tokens, ids and n_ids are replaced in the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe_stream, decontaminate, lang_rank, near_dedup, pii_crf
from quillgraph.llm.common import BATCH_ROWS
from quillgraph.session import forget_stored, stored, stored_so_far

STAGES = [
    ("language_id", lang_rank.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii_crf.stage),
    ("bpe", bpe_stream.stage),
]

#: Not expressible in SQL (rank distances, shingle components, a trained tagger, merges); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents. Once a stage's result is written, what it was made from is deleted;
    the session's batch size, which stages set where it is unset, is as before at the end."""
    docs, mark, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_so_far(), spark.conf.get(BATCH_ROWS, None)
    try:
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
            forget_stored(spark, mark, but=1)
    finally:
        if own is None:
            spark.conf.unset(BATCH_ROWS)
        else:
            spark.conf.set(BATCH_ROWS, own)
    return docs
