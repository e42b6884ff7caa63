"""Session settings shared by every entry point."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []
#: Rows of a few longs that fill a file of stored_few(), and its fewest files.
ROWS_A_FILE, FEWEST_FILES = 100_000, 8
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, one of our own in local mode (tests); a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillgraph-checkpoint-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint: lineage ends at files in the shared folder, so a lost executor costs a re-read only."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager)


def stored(df: DataFrame, *parts: str, **options: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: columnar, splittable and prunable, unlike a checkpoint. parts: columns that become folders, so that a read of some values opens no others."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/quillgraph-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*parts).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_wide(df: DataFrame) -> DataFrame:
    """stored() for rows of large values: in small groups of rows, as writers and readers hold a whole one, and by checks that come before a hundred rows."""
    return stored(df, **{"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.enable.dictionary": "false"})


def stored_few(df: DataFrame, rows: int) -> DataFrame:
    """stored() for narrow rows of which there are at most about so many: in as many files as they fill, not one for each shuffle partition."""
    return stored(df.coalesce(max(FEWEST_FILES, -(-rows // ROWS_A_FILE))))


def stored_twice(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df written once and read by two plans: a cogroup of a table with itself loses columns where both sides have the same ones."""
    first = stored(df)
    return first, df.sparkSession.read.schema(df.schema).parquet(_written[-1])


def stored_so_far() -> int:
    """How many tables stored() has written in this process: a mark for forget_stored()."""
    return len(_written)


def forget_stored(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes what stored() has written after that mark, but for the last few. For a caller that is done with them."""
    done = _written[since : len(_written) - but]
    for path in done:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since : len(_written) - but]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go as it ends; else those of all rounds stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
