"""A finished table as a stream of files that arrive in order, and stateful streaming queries over it run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lay_out(rows: DataFrame, batch: str, folder: str) -> list:
    """Write rows into folder/_all by `batch`, then batch after batch into folder/feed, so that a stream meets them in that order.

    A batch is a file, written by one task and read by one micro-batch, so its size is the caller's bound for both. The batches' numbers
    come to the driver, which has the same loop to do as the stream; a batch is read from its own folder only."""
    spark = rows.sparkSession
    rows.withColumn("_batch", F.col(batch)).repartition("_batch").write.partitionBy("_batch").parquet(f"{folder}/_all")
    kept = spark.read.parquet(f"{folder}/_all")
    every = [r[0] for r in kept.select("_batch").distinct().orderBy("_batch").collect()]
    for b in every:
        kept.filter(F.col("_batch") == b).drop("_batch").write.mode("append").parquet(f"{folder}/feed")
    return every


def stream_of(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/feed")


def run_to_end(stream: DataFrame, folder: str, name: str) -> None:
    """Append what the stream gives, until its source has no more, to folder/name; its checkpoint is beside it, so a query that was
    stopped goes on where it was."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # states with several variables need it
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def new_folder(spark: SparkSession, label: str) -> str:
    return shared_folder(spark, label)
