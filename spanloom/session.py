"""Session helpers shared by tests, the bench and operators that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Wide attribute projections make methods the JVM refuses to compile; over this
    # size Spark falls back to split projections, which do get compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC, last key wins in maps, AQE)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", name: str = "spanloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and stops lineage growth."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def landed(df: DataFrame, *by: str) -> DataFrame:
    """Write a table beside the checkpoints and read it back: like :func:`cut`, for use in rounds.

    A checkpoint keeps the size estimate of the plan it replaces, and a join multiplies estimates; over rounds they
    grow without bound.  Files have a size of their own.  Order and partitions are not kept; rows chosen by the
    columns ``by`` are read without the others.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/landed-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def sorted_join(df: DataFrame) -> DataFrame:
    """For a join with a written table of many rows: it is sorted and merged, never sent through the driver.

    Spark takes the size of the files for the size of the table, and row numbers pack to a tenth of theirs and less:
    ten million rows can seem small enough to broadcast.
    """
    return df.hint("merge")
