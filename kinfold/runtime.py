"""Session helpers shared by every module: table access, scratch tables, partition sizing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task of the custom operators should hold at most, when rows are narrow.
ROWS_PER_TASK = 500_000


#: Rows of one or two numbers that may be broadcast at most; the relation that executors build of them stays below 64 MB.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; one of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows of an Arrow batch where rows hold whole texts.
TEXT_ROWS = 2_000


def materialize(df: DataFrame, name: str = "step", batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it again.

    ``batch_rows`` bounds the Arrow batches of this write: batches of whole texts are large, and both the executor and its
    Python worker hold some at a time. This cuts the lineage: a lost executor costs the tasks that were running, and each later use reads
    the table instead of computing it once more. The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch_rows:
            spark.conf.set(key, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        if jvm is not None and spark.sparkContext._jsc is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Shuffle partitions for ``rows`` narrow rows: the session's number, or more where rows ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized narrow table, marked for broadcast if it has ``most`` rows at most; else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan gives fewer partitions (a small table in one file); as it is otherwise, so that
    large tables are not shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
