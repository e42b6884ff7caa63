"""Readers and writers of corpora, triples, vectors, ontologies and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names by what they hold, in order of preference.
TEXT_COLUMNS = ["text_coref", "coref_text", "text", "news"]
LABEL_COLUMNS = ["type", "category", "target"]
TOPIC_COLUMNS = ["topic", "new_topic", "new_target", "target"]


def resolve(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the names that the table has, in order."""
    return [n for n in names if n in df.columns]


def with_text(df: DataFrame) -> DataFrame:
    """df with ``text``: for each row the first text column that isn't blank."""
    own = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in resolve(df, TEXT_COLUMNS)]
    return df.withColumn("text", F.coalesce(*own) if own else F.lit(None).cast("string"))


def with_topic(df: DataFrame) -> DataFrame:
    """df with ``topic`` from the first topic column it has."""
    own = resolve(df, TOPIC_COLUMNS)
    return df.withColumn("topic", F.coalesce(*map(F.col, own)) if own else F.lit(None).cast("string"))


def read_corpus(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited text with quoted fields over several lines; bad lines are left out; null text is empty."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', encoding=encoding, multiLine=True, mode="DROPMALFORMED")
    return df.na.fill("", [c for c in TEXT_COLUMNS if c in df.columns])


def write_corpus(df: DataFrame, path: str, sep: str = ";") -> None:
    """Delimited text with every field in quotes."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quoteAll=True, escape='"')


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """text, category from JSON lines of papers; lines without text or versions are left out; the category is the first part of the first one."""
    raw = spark.read.schema("abstract string, categories string, versions array<map<string,string>>").json(path, mode="DROPMALFORMED")
    kept = raw.where((F.col("abstract") != "") & (F.size("versions") > 0))
    return kept.select(F.trim("abstract").alias("text"), F.split(F.split("categories", " ")[0], r"\.")[0].alias("category"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, relation, object, topic, triple_id from comma-separated text, whatever the topic column is called."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    out = with_topic(df)
    key = F.col("old_index").cast("long") if "old_index" in df.columns else F.monotonically_increasing_id()
    return out.select("subject", "relation", "object", "topic", key.alias("triple_id")).where("subject is not null and object is not null")


def write_triples(df: DataFrame, path: str, topics: bool = True) -> None:
    names = ["subject", "relation", "object", *(["topic"] if topics else []), "triple_id"]
    df.select(*[c for c in names if c in df.columns]).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def parse_triple_list(column: str):
    """A list of triples written as text, in single or double quotes: never evaluated."""
    value = F.regexp_replace(column, r"'(subject|relation|object)'\s*:\s*'([^']*)'", '"$1": "$2"')
    return F.from_json(value, "array<struct<subject:string,relation:string,object:string>>")


def write_vectors(df: DataFrame, path: str, model: str) -> DataFrame:
    """Parquet of id, entity, vec, and one row of statistics, which is returned too."""
    df.select("id", "entity", "vec").write.mode("overwrite").parquet(f"{path}/vectors")
    stats = df.agg(F.count("*").alias("num_entities"), F.max(F.size("vec")).alias("embedding_dim")).withColumn("model_type", F.lit(model))
    stats.write.mode("overwrite").json(f"{path}/stats")
    return stats


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, entity string, vec array<float>").parquet(f"{path}/vectors")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o from N-Triples; well-known prefixes are shortened; other lines are left out."""
    line = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"[^.]*)\s*\.\s*$'
    raw = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)

    def short(c):
        for prefix, uri in (("rdf:", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("rdfs:", "http://www.w3.org/2000/01/rdf-schema#")):
            c = F.replace(c, F.lit(uri), F.lit(prefix))
        return c

    return raw.select(part(1).alias("s"), short(part(2)).alias("p"), F.when(part(3) != "", short(part(3))).otherwise(part(4)).alias("o"))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written before; none yet is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)
