"""Session helpers: a local session for tests, and lineage cuts on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "driftloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Plans have hundreds of expressions; recording the call site of each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the checkpoint folder and read it back.

    Unlike a cached DataFrame the result survives lost executors, and its file sizes give
    the optimizer true statistics, so small control tables are broadcast by a checked size.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_root(spark), "driftloom", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


#: Spark removes the shuffle files of a query that has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_tidily(df: DataFrame, name: str) -> DataFrame:
    """As `cut`, and the shuffle files that the table took go as soon as it is written, not when the driver's JVM happens to
    collect its garbage. `release` takes the table away."""
    spark = df.sparkSession
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        return cut(df, name)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written, once nothing reads them any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
