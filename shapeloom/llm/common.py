"""Shared folder, lineage cuts and Arrow helpers for the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of all operators here: space and \t \n \v \f \r.
SPACE = "[\\x20\\x09-\\x0D]"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders that this process made and has not removed; the driver removes them at its end.
_MADE: dict[str, SparkSession] = {}
_LOCK, _WRITING, _OWN = threading.Lock(), [0, "false"], threading.local()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; removed when the driver ends, if not by release().

    Only where that setting is missing (a local session, as in tests) a temporary folder is set in its place."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shapeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/shapeloom/{label}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    if getattr(_OWN, "made", None) is not None:
        _OWN.made.append(path)
    return path


def table_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir for files that a query leaves there."""
    path = shared_dir(spark, label)
    _MADE.pop(path)
    if getattr(_OWN, "made", None) is not None:
        _OWN.made.remove(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors.

    The shuffle files behind df are of no more use then, and are removed with the write. release() removes the table."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    with _LOCK:  # the setting is the session's; it stays on while any thread writes
        if not _WRITING[0]:
            _WRITING[1] = spark.conf.get(_CLEAN, "false")
            spark.conf.set(_CLEAN, "true")
        _WRITING[0] += 1
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        with _LOCK:
            _WRITING[0] -= 1
            if not _WRITING[0]:
                spark.conf.set(_CLEAN, _WRITING[1])
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
    out._folder = path
    return out


def release(*tables: DataFrame | str) -> None:
    """Remove materialized tables, or folders by path, that nothing will read again."""
    for t in tables:
        path = t if isinstance(t, str) else t._folder
        spark = _MADE.pop(path, None)
        if spark is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class scratch:
    """At the end of `with scratch() as made:` the folders made within, by this thread, are removed but for those of made.keep()."""

    def __enter__(self):
        self.of, self.kept, self.outer = [], set(), getattr(_OWN, "made", None)
        _OWN.made = self.of
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._folder)
        return table

    def __exit__(self, *_):
        _OWN.made = self.outer
        release(*[p for p in self.of if p not in self.kept])
        if self.outer is not None:
            self.outer.extend(self.kept)


@atexit.register
def _at_exit() -> None:
    for path in list(_MADE):
        try:
            release(path)
        except Exception:  # the session's JVM may be gone by now
            _MADE.pop(path, None)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI (file, hdfs, s3, gs ...) and the path within it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit_file(uri: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a task that is run again or twice leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, renamed to _id and _text, so that other columns can't clash; a null text is empty."""
    return docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))


def slices(batches, most: int = 16 << 20):
    """Arrow batches cut so that each holds about `most` bytes (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, min(b.num_rows, int(b.num_rows * most / max(b.nbytes, 1)) or 1))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def replace_spaces(text, by: str = "") -> F.Column:
    """text with each character of SPACE replaced, by plain replacements, which are several times cheaper than a pattern."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(by)) if c != by else text
    return text


def word_count(text) -> F.Column:
    """Number of runs of other than white space, without Python; only texts with runs of white space need a pattern."""
    t = replace_spaces(F.coalesce(text, F.lit("")), " ")
    gaps = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    single = gaps(t) + 1 - F.startswith(t, F.lit(" ")).cast("int") - F.endswith(t, F.lit(" ")).cast("int")
    trimmed = F.trim(F.regexp_replace(t, " +", " "))
    return F.when(t == "", 0).when(~t.contains("  ") & (t != " "), single).when(trimmed == "", 0).otherwise(gaps(trimmed) + 1).cast("long")


class Recent(dict):
    """A dict that computes missing values and forgets the older half of its keys; both halves together hold about `room` bytes.

    Keys of more than `widest` characters are computed each time and not held."""

    def __init__(self, make, room: int, widest: int = 256):
        super().__init__()
        self.make, self.room, self.left, self.widest, self.old = make, room // 2, room // 2, widest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = 0 if isinstance(key, int) else len(key)
        if size > self.widest:
            return value
        size += 160 + (0 if isinstance(value, int) else len(value))
        if self.left < size:
            self.old = dict(self)
            self.clear()
            self.left = self.room
        self.left -= size
        self[key] = value
        return value
