"""MATLAB MAT-files of version 5 as a data source: numeric two-dimensional arrays, a row of an array for each row.

spark.dataSource.register(MatSource), then spark.read.format("mat").load(path) gives file, row and values; options: variable (the first
array if it isn't set), rows (of a partition, 65,536 if it isn't set). df.write.format("mat").save(path) writes rows (values) of a partition as one
file, option compressed: true or false. A file is a header of 128 bytes and elements of type, size and data; an array is an element of
elements: flags, dimensions, name and values by columns. Rows of a plain array are read from their places in each column, by as many
partitions as it has stretches of rows; a compressed one has to be inflated from its start, by one.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format: numpy types of element types, and element types and classes that are used here.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
INT8, INT32, UINT32, DOUBLE, MATRIX, COMPRESSED, DOUBLE_CLASS = 1, 5, 6, 9, 14, 15, 6
NUMERIC_CLASSES, COMPLEX_FLAG = range(6, 16), 0x0800
ROWS = 65_536


def _located(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class Array:
    """A numeric array in a file: where its values begin (in the inflated element if compressed is a place), their type and its shape."""

    name: str
    shape: tuple[int, int]
    kind: str
    at: int
    compressed: tuple[int, int] | None = None


def _tag(data: bytes, order: str) -> tuple[int, int, int]:
    """Type, size and length of the tag of an element; small elements have their data in the tag's second half."""
    first, size = struct.unpack(order + "II", data[:8])
    return (first & 0xFFFF, first >> 16, 4) if first >> 16 else (first, size, 8)


def _array(f, at: int, order: str) -> Array | None:
    """The array whose elements begin at `at`, or None if it isn't numeric, real and two-dimensional."""

    def element():
        nonlocal at
        f.seek(at)
        kind, size, head = _tag(f.read(8), order)
        begin = at + head
        at = begin + size + (-size % 8 if head == 8 else 4 - size)
        return kind, size, begin

    def data(size, begin):
        f.seek(begin)
        return f.read(size)

    _, size, begin = element()
    flags = struct.unpack(order + "I", data(size, begin)[:4])[0]
    _, size, begin = element()
    shape = struct.unpack(order + f"{size // 4}i", data(size, begin))
    _, size, begin = element()
    name = data(size, begin).decode()
    if flags & 0xFF not in NUMERIC_CLASSES or flags & COMPLEX_FLAG or len(shape) != 2:
        return None
    kind, size, begin = element()
    if size != shape[0] * shape[1] * np.dtype(TYPES[kind]).itemsize:
        raise ValueError(f"array {name!r} has {size} bytes, which is not its shape {shape}")
    return Array(name, shape, order + TYPES[kind], begin)


def _inflated(f, at: int, size: int) -> bytes:
    f.seek(at)
    z = zlib.decompressobj()
    out = z.decompress(f.read(size)) + z.flush()
    if not z.eof:
        raise ValueError("a compressed array is cut short")
    return out


def arrays(f, length: int):
    """The numeric arrays of an open file."""
    f.seek(0)
    head = f.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT-file of version 5")
    order, at = "<" if head[126:128] == b"IM" else ">", 128
    while at + 8 <= length:
        f.seek(at)
        kind, size, start = _tag(f.read(8), order)
        if at + start + size > length:
            raise ValueError("the file ends within an array")
        if kind == COMPRESSED:
            got = io.BytesIO(_inflated(f, at + start, size))
            if _tag(got.read(8), order)[0] == MATRIX and (found := _array(got, 8, order)):
                found.compressed = at + start, size
                yield found
        elif kind == MATRIX and (found := _array(f, at + start, order)):
            yield found
        at += start + size + (0 if kind == COMPRESSED else -size % 8)


def rows_of(f, a: Array, first: int, last: int) -> np.ndarray:
    """Rows first to last of an array, from their place in each of its columns."""
    source = io.BytesIO(_inflated(f, *a.compressed)) if a.compressed else f
    n, width = a.shape
    out, item = np.empty((last - first, width)), np.dtype(a.kind).itemsize
    for c in range(width):
        source.seek(a.at + (c * n + first) * item)
        out[:, c] = np.frombuffer(source.read((last - first) * item), dtype=a.kind)
    return out


def packed(name: str, values: np.ndarray, compressed: bool) -> bytes:
    """A MAT-file with one array of doubles."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    parts = element(UINT32, struct.pack("<II", DOUBLE_CLASS, 0)) + element(INT32, struct.pack("<ii", *values.shape)) + element(INT8, name.encode()) + element(DOUBLE, np.asfortranarray(values, dtype="<f8").tobytes("F"))
    whole = struct.pack("<II", MATRIX, len(parts)) + parts
    if compressed:
        squeezed = zlib.compress(whole)
        whole = struct.pack("<II", COMPRESSED, len(squeezed)) + squeezed
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + whole


@dataclass
class _Rows(InputPartition):
    uri: str
    array: Array
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable, self.rows = options["path"], options.get("variable"), int(options.get("rows", ROWS))

    def partitions(self):
        fs, path = _located(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(".mat")]
        out = []
        for i in sorted(found, key=lambda i: i.path):
            with fs.open_input_file(i.path) as f:
                own = [a for a in arrays(f, i.size) if self.variable in (None, a.name)]
            if not own and self.variable:
                raise ValueError(f"{i.path} has no array {self.variable!r}")
            uri = self.path if info.is_file else self.path.rstrip("/") + i.path[len(path.rstrip("/")) :]
            for a in own[:1]:
                step = max(1, a.shape[0] if a.compressed else self.rows)
                out += [_Rows(uri, a, k, min(k + step, a.shape[0])) for k in range(0, a.shape[0], step)]
        return out

    def read(self, partition):
        fs, path = _located(partition.uri)
        with fs.open_input_file(path) as f:
            values = rows_of(f, partition.array, partition.first, partition.last)
        name = path.rsplit("/", 1)[-1]
        for k, row in enumerate(values.tolist()):
            yield name, partition.first + k, row


@dataclass
class _Written(WriterCommitMessage):
    part: str | None


class _Writer(DataSourceWriter):
    """Files get their names when all tasks are done; what failed attempts left is removed then."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.name, self.compressed, self.overwrite = options["path"], options.get("variable", "x"), options.get("compressed", "true") == "true", overwrite
        self.attempts = f"{self.path.rstrip('/')}/_attempts-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        values = np.array([list(r["values"]) for r in iterator], dtype=float)
        if not len(values):
            return _Written(None)
        fs, folder = _located(self.attempts)
        fs.create_dir(folder, recursive=True)
        part = f"{uuid.uuid4().hex}.mat"
        with fs.open_output_stream(f"{folder}/{part}", compression=None) as out:
            out.write(packed(self.name, values, self.compressed))
        return _Written(part)

    def commit(self, messages) -> None:
        fs, base = _located(self.path)
        if self.overwrite and fs.get_file_info(base).type == pafs.FileType.Directory:
            for i in fs.get_file_info(pafs.FileSelector(base)):
                if i.is_file and i.path.endswith(".mat"):
                    fs.delete_file(i.path)
        fs.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.part:
                fs.move(f"{_located(self.attempts)[1]}/{m.part}", f"{base}/part-{m.part}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, folder = _located(self.attempts)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class MatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatSource)
