"""Rewrite of files whose schemas have drifted, and the external merge sort that lays such files out.

External merge sort: each task writes its rows, sorted, as a run; the keys of all runs are ranked exactly, which cuts every run where a file
begins; a file is then the heap-merge of one slice of each run, written by one task as a stream. Runs beyond FAN_IN are merged in
passes first, file by file, so that no task has more open.

Drifted files keep the Parquet field ids of the evolved schema while names, order, types and columns differ. Rewrite tasks follow the
file manifest: each reads a file, finds its columns by id, and puts a file of the evolved schema in its place. A file gets its
name by a move at the end, under a name that depends on its number only, so tasks that are run again or twice leave one whole file.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranges
from ..operators import tables as core_tables
from .common import arrow_type, filesystem, materialize, release, shared_dir, table_folder

#: Rows of a batch of a run (what a slice reads at a time), of a row group, and runs that a task merges at once.
RUN_ROWS, GROUP_ROWS, FAN_IN = 256, 1 << 16, 256
FIELD_ID = b"PARQUET:field_id"
KEY = "_key"


# ---- runs -----------------------------------------------------------------------------------------------------------------------------


def sort_key(rows: DataFrame, id_col: str, columns: list[str]):
    """A string that sorts as (unsigned crc32 of the decimal id, the id as a number, a hash of the whole row); null ids come first."""
    own = rows[id_col].cast("long")
    number = F.lpad(F.hex(own.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    crc = F.lpad(F.hex(F.crc32(own.cast("string").cast("binary"))), 8, "0")
    tie = F.lpad(F.hex(F.xxhash64(*[rows[c] for c in columns])), 16, "0")
    return F.concat(F.when(own.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), crc, number)), tie)


def _even(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in batches of just `size` rows, but for the last: so a row's place tells its batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            whole = n // size * size
            for k in range(0, whole, size):
                yield t.slice(k, size)
            held, n = [t.slice(whole)], n - whole
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write_runs(rows: DataFrame, folder: str) -> DataFrame:
    """uri, pos and _key of every row of the sorted runs, one for each partition of rows, which has the column _key."""
    schema = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in rows.schema])
    at = schema.get_field_index(KEY)

    def run(batches):
        fs, base = filesystem(folder)
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"  # only names that reach the manifest count
        fs.create_dir(base, recursive=True)
        done, out = 0, None
        for b in _even(batches, RUN_ROWS):
            if out is None:
                sink = fs.open_output_stream(filesystem(uri)[1], compression=None)
                out = pa.ipc.new_file(sink, schema)
            out.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, schema.types)], schema=schema))
            yield pa.RecordBatch.from_arrays([pa.array([uri] * b.num_rows), pa.array(np.arange(done, done + b.num_rows)), b.column(at)], names=["uri", "pos", KEY])
            done += b.num_rows
        if out is not None:
            out.close()
            sink.close()

    return materialize(rows.sortWithinPartitions(KEY).mapInArrow(run, f"uri string, pos long, {KEY} string"), "runs")


def cut_runs(keys: DataFrame, file_rows: int) -> DataFrame:
    """file_no, uri, lo, hi: the places in each run between which its rows belong to a file, by the exact ranks of all keys.

    A run is sorted as the ranking is, so that its rows of a file lie together; equal keys are ranked by run and place."""
    placed = ranges.ranked(keys, KEY, "uri", "pos", name="_rank")
    return placed.groupBy(F.floor(F.col("_rank") / file_rows).alias("file_no"), "uri").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"))


def _slice_rows(uri: str, lo: int, hi: int) -> Iterator[tuple[str, pa.RecordBatch, int]]:
    """key, batch and place in it of the rows lo to hi of a run, one batch in memory at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        run = pa.ipc.open_file(f)
        size = run.get_batch(0).num_rows  # of every batch but the last
        for k in range(lo // size, -(-hi // size)):
            b = run.get_batch(k)
            keys = b.column(run.schema.get_field_index(KEY)).to_pylist()
            for i in range(max(lo - k * size, 0), min(hi - k * size, b.num_rows)):
                yield keys[i], b, i


def merged(slices: list[tuple[str, int, int]], most: int = 8192) -> Iterator[pa.Table]:
    """The rows of slices (uri, lo, hi) of runs in the order of their keys, in tables of at most `most` rows."""
    parts = [((key, r, n, b, i) for n, (key, b, i) in enumerate(_slice_rows(*s))) for r, s in enumerate(sorted(slices))]
    pool: dict[int, tuple[int, pa.RecordBatch]] = {}
    order: list[int] = []
    size = 0

    def flush() -> pa.Table:
        return pa.Table.from_batches([b for _, b in pool.values()]).take(pa.array(order))

    for _, _, _, b, i in heapq.merge(*parts, key=lambda x: x[:3]):
        if id(b) not in pool:
            pool[id(b)] = (size, b)
            size += b.num_rows
        order.append(pool[id(b)][0] + i)
        if len(order) == most:
            yield flush()
            pool, order, size = {}, [], 0
    if order:
        yield flush()


def _tasks(rows: DataFrame) -> DataFrame:
    """A row for each file, dealt so that a task has a few."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(8 * n, 1), "file_no")


def merge_passes(slices: DataFrame, folder: str, schema: pa.Schema, fan_in: int = FAN_IN) -> DataFrame:
    """slices (file_no, uri, lo, hi) with at most fan_in for a file: groups of so many are merged into longer runs, again and again."""
    while (slices.groupBy("file_no").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        places = F.row_number().over(Window.partitionBy("file_no").orderBy("uri")) - 1  # of the runs of a file
        group = F.floor(places / fan_in)
        grouped = slices.withColumn("g", group).groupBy("file_no", "g").agg(F.collect_list(F.struct("uri", "lo", "hi")).alias("slices"))

        def run(batches):
            fs, base = filesystem(folder)
            fs.create_dir(base, recursive=True)
            for b in batches:
                for no, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    uri, n = f"{folder}/{uuid.uuid4().hex}.arrow", 0
                    with fs.open_output_stream(filesystem(uri)[1], compression=None) as sink, pa.ipc.new_file(sink, schema) as out:
                        for t in merged([(s["uri"], s["lo"], s["hi"]) for s in parts], RUN_ROWS):
                            out.write_batch(t.combine_chunks().to_batches()[0])
                            n += t.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([uri]), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["file_no", "uri", "lo", "hi"])

        slices = materialize(grouped.select("file_no", "slices", "g").repartition(4 * grouped.sparkSession.sparkContext.defaultParallelism, "file_no", "g").drop("g").mapInArrow(run, "file_no long, uri string, lo long, hi long"), "merged-runs")
    return slices


# ---- files ----------------------------------------------------------------------------------------------------------------------------


def evolved_schema(names_and_types: list[tuple[str, pa.DataType]]) -> pa.Schema:
    """Nullable fields whose Parquet field ids are their places from 1."""
    return pa.schema([pa.field(n, t, True, {FIELD_ID: str(k + 1).encode()}) for k, (n, t) in enumerate(names_and_types)])


def field_id(field: pa.Field) -> int:
    return int((field.metadata or {})[FIELD_ID])


def version_of(file_no: int) -> int:
    """The planted version of a starting file."""
    v = zlib.crc32(f"7:{file_no}".encode()) % 24
    return v if v < 16 else 0


def drifted(evolved: pa.Schema, version: int, swap=("name", "email"), missing=("nation_id", "city"), narrow=(("balance", pa.float32()), ("nation_id", pa.int32()))) -> pa.Schema:
    """The schema of a starting file by the bits of its version: 1 swaps two names, 2 reverses the columns after the first, 4 leaves
    columns out, 8 narrows types. Field ids stay with the data."""
    fields = list(evolved)
    if version & 8:
        fields = [f.with_type(dict(narrow)[f.name]) if f.name in dict(narrow) else f for f in fields]
    if version & 4:
        fields = [f for f in fields if f.name not in missing]
    if version & 2:
        fields = fields[:1] + fields[:0:-1]
    if version & 1:
        other = {swap[0]: swap[1], swap[1]: swap[0]}
        fields = [f.with_name(other.get(f.name, f.name)) for f in fields]
    return pa.schema(fields)


def cast_by_id(t: pa.Table, to: pa.Schema, fill: dict[int, object] | None = None) -> pa.Table:
    """t with the columns of `to`, matched by field id whatever their names, order and types; those that t lacks have their fill value."""
    at = {field_id(f): k for k, f in enumerate(t.schema)}
    out = []
    for f in to:
        k = at.get(field_id(f))
        if k is None:
            out.append(pa.repeat(pa.scalar((fill or {}).get(field_id(f)), f.type), t.num_rows))
        else:
            out.append(t.column(k).cast(f.type, safe=False))
    return pa.Table.from_arrays(out, schema=to)


def put_file(folder: str, name: str, schema: pa.Schema, parts: Iterator[pa.Table]) -> str:
    """Stream tables into folder/name: written under a name of this attempt in the folder beside it, then moved."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    fs.create_dir(f"{base}-attempts", recursive=True)
    part = f"{base}-attempts/{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as sink, pq.ParquetWriter(sink, schema, store_schema=False) as out:
        for t in parts:
            out.write_table(t, row_group_size=GROUP_ROWS)
    fs.move(part, f"{base}/{name}")
    return f"{folder}/{name}"


def write_files(slices: DataFrame, folder: str, evolved: pa.Schema, version: Callable[[int], int] = version_of) -> DataFrame:
    """The starting files, one task for each, as a stream: file_no, version, uri, start_columns."""
    plan = slices.groupBy("file_no").agg(F.collect_list(F.struct("uri", "lo", "hi")).alias("slices"))

    def run(batches):
        for b in batches:
            for no, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = version(no)
                schema = drifted(evolved, v)
                # rows of runs have the evolved schema's columns in its order, and the key behind them
                rows = (pa.Table.from_arrays([c.cast(f.type, safe=False) for c, f in zip(t.columns, evolved)], schema=evolved) for t in merged([(s["uri"], s["lo"], s["hi"]) for s in parts]))
                uri = put_file(folder, f"file-{no:06d}.parquet", schema, (cast_by_id(t, schema) for t in rows))
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([v], pa.int64()), pa.array([uri]), pa.array([",".join(schema.names)])], names=["file_no", "version", "uri", "start_columns"])

    return materialize(_tasks(plan).mapInArrow(run, "file_no long, version long, uri string, start_columns string"), "start-manifest")


def _tables(uri: str) -> tuple[pa.Schema, Iterator[pa.Table]]:
    """A file's schema and its rows, a row group at a time."""
    fs, path = filesystem(uri)
    f = pq.ParquetFile(fs.open_input_file(path))
    return f.schema_arrow, (pa.Table.from_batches([b]) for b in f.iter_batches(8192))


def rewrite_files(manifest: DataFrame, folder: str, evolved: pa.Schema, fill: dict[int, object], keep_version: int = 0) -> DataFrame:
    """Bring every file of the manifest to the evolved schema, in the same folder, rows and order kept: the manifest with path and rewritten.

    A file of keep_version isn't touched. The new files are all written before an old one is removed, so a lost executor costs work only; both
    passes may be repeated in part or whole. At the end the folder holds the files of the result and no others."""

    def rewrite(batches):
        for b in batches:
            for no, v, uri, start in zip(*[c.to_pylist() for c in b.columns]):
                path = uri
                if v != keep_version:
                    _, parts = _tables(uri)
                    path = put_file(folder, f"file-{no:06d}-evolved.parquet", evolved, (cast_by_id(t, evolved, fill) for t in parts))
                cols = [pa.array([no], pa.int64()), pa.array([v], pa.int64()), pa.array([uri]), pa.array([start]), pa.array([path]), pa.array([path != uri])]
                yield pa.RecordBatch.from_arrays(cols, names=["file_no", "version", "uri", "start_columns", "path", "rewritten"])

    made = materialize(_tasks(manifest).mapInArrow(rewrite, "file_no long, version long, uri string, start_columns string, path string, rewritten boolean"), "rewritten-manifest")

    def clear(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = filesystem(uri)
                if fs.get_file_info(path).type.name != "NotFound":
                    fs.delete_file(path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    made.filter("rewritten").select("uri").mapInArrow(clear, "n long").agg(F.sum("n")).collect()
    core_tables.remove(manifest.sparkSession, f"{folder}-attempts")
    return made.drop("uri")


def _rendered(t: pa.Table) -> Iterator[str]:
    """Rows as fields joined by |: null is ?, times are microseconds since 1970, floats floor(1048576 * value) if they are finite."""
    cols = []
    for c in t.columns:
        if pa.types.is_timestamp(c.type):
            c = c.cast(pa.timestamp("us"), safe=False).cast(pa.int64())
        values = c.to_pylist()
        if pa.types.is_floating(c.type):
            values = [v if v is None or not math.isfinite(v) else math.floor(1048576 * v) for v in values]
        cols.append(["?" if v is None else str(v) for v in values])
    return map("|".join, zip(*cols))


def digest_files(final: DataFrame, id_name: str) -> DataFrame:
    """final with n_rows, n_nulls, ids_sha256, rows_sha256 and columns, from the files as they are; a file is read as a stream."""
    names = [f.name for f in final.schema]
    out = T.StructType([*final.schema.fields, *[T.StructField(n, T.LongType()) for n in ("n_rows", "n_nulls")], *[T.StructField(n, T.StringType()) for n in ("ids_sha256", "rows_sha256", "columns")]])

    def run(batches):
        for b in batches:
            for k, uri in enumerate(b.column(names.index("path")).to_pylist()):
                schema, parts = _tables(uri)
                ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
                for t in parts:
                    if t.num_rows:
                        lead = "" if n == 0 else "\n"
                        rows.update((lead + "\n".join(_rendered(t))).encode())
                        ids.update((("" if n == 0 else ",") + ",".join("?" if v is None else str(v) for v in t.column(id_name).to_pylist())).encode())
                    n += t.num_rows
                    nulls += sum(c.null_count for c in t.columns)
                more = [pa.array([n], pa.int64()), pa.array([nulls], pa.int64()), pa.array([ids.hexdigest()]), pa.array([rows.hexdigest()]), pa.array([",".join(schema.names)])]
                yield pa.RecordBatch.from_arrays([*[c.slice(k, 1) for c in b.columns], *more], names=out.names)

    return _tasks(final).mapInArrow(run, out)


def lay_out(rows: DataFrame, id_col: str, folder: str, evolved: pa.Schema, file_rows: int | None = None, version: Callable[[int], int] = version_of, fan_in: int = FAN_IN) -> DataFrame:
    """Sort rows externally by sort_key and write them into files of file_rows (1 + N // 1000 if None); the manifest of write_files.

    rows has the evolved schema's columns, by name; others are ignored. Rows that are equal in everything may stand in any order, which no
    reader can tell; rows that repeat an id only are ordered by a hash of the whole row. Null ids come first. Without rows there
    is no file."""
    names = list(evolved.names)
    keyed = rows.select(*[rows[c] for c in names], sort_key(rows, id_col, names).alias(KEY))
    top = shared_dir(rows.sparkSession, "merge-sort")
    keys = write_runs(keyed, f"{top}/runs")
    n = keys.count()
    slices = merge_passes(materialize(cut_runs(keys, file_rows or 1 + n // 1000), "slices"), f"{top}/merged", _run_schema(keyed), fan_in)
    made = write_files(slices, folder, evolved, version)
    release(top, keys)
    return made


def _run_schema(rows: DataFrame) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in rows.schema])


def op13_schema_rewrite(spark, sf_dir: str) -> DataFrame:
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    types = {f.name: arrow_type(f.dataType) for f in clients.schema} | {"nation_id": pa.int64()}
    evolved = evolved_schema([(n, types[n]) for n in clients.columns])
    folder = f"{table_folder(spark, 'clients-evolved')}/files"
    manifest = lay_out(clients, "client_id", folder, evolved)
    fill = {field_id(evolved.field("nation_id")): -1, field_id(evolved.field("city")): "none"}
    return digest_files(rewrite_files(manifest, folder, evolved, fill), "client_id").select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
