"""Session helpers: settings, shared scratch space and input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "codonlake", **conf) -> SparkSession:
    """Session for tests and benchmarks; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in the cluster's shared folder.

    The folder is the one ``spark.checkpoint.dir`` names. Only a local master
    may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and return it as read back.

    For inputs that a job reads more than once: the work above it is done one
    time, and a lost executor repeats only reads of the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_by(df: DataFrame, key: str, path: str) -> DataFrame:
    """Write a table below ``path`` in buckets of ``key`` and return it as read back: groups of ``key`` need no shuffle.

    Rows are written where they are, so those of a key should lie together already. The files are Parquet like any
    other; only the returned table knows of the buckets.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str, waves: int = 4) -> DataFrame:
    """Repartition a scan that has too few splits for the cores at hand.

    The sequence operators cost far more CPU than the scan, so one small file
    in one split would leave the cluster idle. A scan with enough splits is
    returned as it is: at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * waves, *keys)
