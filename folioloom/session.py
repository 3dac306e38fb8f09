"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "folioloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Partition sizes are left to AQE: a generous number of shuffle partitions is
    coalesced at run time, and skewed join partitions are split.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # States of streams may outgrow the memory of an executor.
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the input has fewer partitions than there are cores.

    A large table has far more and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores, key) if df.rdd.getNumPartitions() < cores else df


def gathered(files: DataFrame, per_core: int = 32) -> DataFrame:
    """Rows of small files in fewer tasks, where a scan of them has very many.

    Spark counts every file as 4 MB, so it would make a task of some thirty small ones.
    """
    most = per_core * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(most) if files.rdd.getNumPartitions() > most else files


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a job writes and reads back.

    It lies under the shared folder the cluster names in ``spark.checkpoint.dir``.  Only a
    local session without that setting gets a temporary folder; on a cluster the setting is
    required, since executors could not read a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="folioloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
