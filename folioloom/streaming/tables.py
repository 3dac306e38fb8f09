"""Tables that micro-batches write.

Every batch owns the folder ``batch_id=N`` of a table and overwrites it, so a batch that is
run again after a failure leaves the same rows once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from folioloom.session import ROCKSDB


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """Rows of all batches, or of those before a given one; empty where there are none yet."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("basePath", path).parquet(path)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written."""
    try:
        spark.read.format("text").load(path).schema  # noqa: B018
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def keep_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep their states on disk, whatever the session was built with.

    A batch then writes what it changed, not a snapshot of every partition, and all stores of an
    executor share half a gigabyte for cached blocks and writes.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


def start(writer: DataStreamWriter, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Start a stream: over what there is now, or every so many seconds."""
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream of its files.

    The name is given as a pattern: a plain path would have to be a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}")


def landed(spark: SparkSession, path: str, landing: str, batches: int = 5) -> tuple[str, int]:
    """Where to read a parquet table as a stream of several batches, and its number of files.

    Files are read where they lie; a table of fewer files than batches is small, and is written
    to ``landing`` in as many.
    """
    table = spark.read.parquet(path)
    n_files = len(table.inputFiles())
    if n_files >= batches:
        return path, n_files
    table.repartition(batches).write.parquet(landing)
    return landing, batches


def arrivals(spark: SparkSession, path: str, landing: str, batches: int = 5, most: int = 1000) -> DataFrame:
    """A parquet table as a stream of several batches, of ``most`` files each at most."""
    place, n_files = landed(spark, path, landing, batches)
    return read_stream(spark, place, min(most, -(-n_files // batches)))
