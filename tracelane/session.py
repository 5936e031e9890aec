"""Session set-up shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on. Skew handling stays on even where it costs one more shuffle.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session made elsewhere."""
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, partitions: int = 8, app: str = "tracelane", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the setting is
    an error, because its executors share no local disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Even out rows ahead of a step that costs far more per row than a shuffle.

    The count is fixed, because AQE judges partitions by bytes and would merge them again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join by sorting and merging, never by a broadcast.

    For joins with what is read off parsed records: Spark takes a VARIANT column for 2 KB a row, so that the narrow columns
    beside it seem to be next to nothing, and the driver would gather all rows of them.
    """
    return df.hint("merge")


def staged(df: DataFrame, *partitions: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For data that several later steps read: it is computed once, survives lost executors, and
    as parquet each step reads only the columns (and partitions) it needs.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
