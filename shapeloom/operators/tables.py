"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Folders of written() that this process made and hasn't removed; the driver removes them at its end.
_MADE: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under spark.checkpoint.dir; a local session that has none gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shapeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def _located(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _located(spark, folder)
    fs.delete(path, True)
    _MADE.pop(folder, None)


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _located(spark, folder)
    return fs.exists(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table that is read again: it cuts the lineage, is computed once, and outlives lost executors.

    Column names may repeat. discard() removes the table, or else the driver at its end."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, label)
    _MADE[folder] = spark
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.parquet(folder)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(df.schema)])
    out = spark.read.schema(schema).parquet(folder).toDF(*df.columns)
    out._folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    for t in tables:
        if t._folder in _MADE:
            remove(t.sparkSession, t._folder)


@atexit.register
def _at_exit() -> None:
    for folder, spark in list(_MADE.items()):
        try:
            remove(spark, folder)
        except Exception:  # the session's JVM may be gone by now
            _MADE.pop(folder, None)
