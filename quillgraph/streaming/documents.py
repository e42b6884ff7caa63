"""Streams: documents to triples as they arrive, and counts by event time. An extension; batch results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import triples as tr


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def triples_to(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the valid triples of arriving documents. Extraction keeps no state, so each batch is a plain append of its own."""
    return tr.extract(docs).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def entity_counts(triples: DataFrame) -> DataFrame:
    """Running entity frequencies, for update or complete output."""
    return triples.select(F.explode(F.array("subject", "object")).alias("entity")).groupBy("entity").agg(F.count("*").alias("freq"))
