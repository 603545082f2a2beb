"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marketloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on (UTC clock, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session clock to UTC; every stored stamp is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Zone-less stamps in files are UTC: read them as such, without a cast that
    # would keep time filters from reaching the scan.
    if spark.conf.get("spark.sql.parquet.inferTimestampNTZ.enabled", "true") != "false":
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    # Window stages are bound by CPU, not bytes: do not merge their partitions
    # below the parallelism of the cluster just because the rows are narrow.
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1MB") in ("1MB", "1048576b", "1048576"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    # HotSpot interprets methods over 8000 bytes of code; such stages run faster without whole-stage code.
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder named by the cluster.

    Only a session without any checkpoint folder (a local test) gets a
    temporary one; a cluster must name its shared folder itself, because a
    machine-local folder would not survive a lost executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="marketloom-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
