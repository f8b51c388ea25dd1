"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that the operators rely on for right results or for skew handling.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Joins with one row per key on one side are left to AQE: it splits hot partitions,
    # also where that costs a later shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Small shuffles still use all cores; parsing is costly per row, not per byte.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # The JVM never compiles methods above 8000 bytes; with this limit Spark splits
    # the code of wide projections into methods that are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Settings of the fare queries alone.
RANGE_SETTINGS = {
    # A join with the runs of a time range drops the other rows before their shuffle, whatever
    # the size of both tables; Spark's own bounds are 10 MB of runs and 10 GB of rows.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64GB",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtimeFilter.number.threshold": "50",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def prepare_fares(spark: SparkSession) -> SparkSession:
    """The same with the settings of the fare queries."""
    for key, value in RANGE_SETTINGS.items():
        spark.conf.set(key, value)
    return prepare(spark)


def local_session(app: str = "skyledger", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("SKYLEDGER_DRIVER_MEMORY", "12g"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    The folder named in ``spark.checkpoint.dir`` is used. Only a local master
    may fall back to a temporary folder; elsewhere executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="skyledger-")
    return f"{base.rstrip('/')}/skyledger/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, spark: SparkSession | None = None, codec: str = "snappy"):
    """Write ``df`` once to reliable storage and go on from the written copy.

    The copy is Parquet: columns are compressed by ``codec``, and a reader loads only those that it needs.
    """
    spark = spark or df.sparkSession
    path = work_dir(spark, "written")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
