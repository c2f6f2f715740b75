"""Token-ID output: ids ranked by frequency in byte-aligned variable-length coding with separate control bytes.

A file holds whole documents in order. Its ids are replaced by their rank in the corpus (the most frequent id is 0), each rank takes
1 to 4 bytes, and its length less one goes as two bits into a control stream apart from the data, so that a reader looks up the
lengths of four values per control byte in a table and gathers all values with numpy.

Layout (little-endian): b"SLTK2\\0\\0\\0", uint32 length of a JSON header and the header; then the sections it lists in this order:
table (uint32 id of each rank), document ids (an Arrow stream of one column), n_tokens (uint32 for each document), control bytes,
data bytes.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, arrow_type, commit_file, materialize, read_file, release, shared_dir, slices

MAGIC = b"SLTK2\0\0\0"
#: Lengths of the four values of a control byte.
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros((len(v) + 3) // 4 * 4, dtype=np.uint8)
    padded[: len(v)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    raw = np.zeros((n, 4), dtype=np.uint8)
    raw[np.arange(4, dtype=np.uint8)[None, :] < sizes[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return raw.view("<u4").reshape(-1)


def write_shard(table: np.ndarray, ids: pa.Array, docs: list[np.ndarray]) -> bytes:
    """table: the token id of each rank, over all that docs hold; ids: of the documents."""
    rank = np.zeros(int(table.max(initial=0)) + 1, dtype=np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data = pack(rank[np.concatenate(docs)] if docs else np.zeros(0, dtype=np.uint32))
    batch, sink = pa.RecordBatch.from_arrays([ids], names=["id"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    parts = [np.ascontiguousarray(table, dtype="<u4").tobytes(), sink.getvalue().to_pybytes(), np.array([len(d) for d in docs], dtype="<u4").tobytes(), control, data]
    head = json.dumps({"sections": [len(p) for p in parts], "documents": len(docs)}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts])


def read_shard(blob: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    """The ids of a file's documents, and the token ids of each."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 12 + int.from_bytes(blob[8:12], "little")
    parts = []
    for size in json.loads(blob[12:at])["sections"]:
        parts.append(blob[at : at + size])
        at += size
    table, lengths = np.frombuffer(parts[0], dtype="<u4"), np.frombuffer(parts[2], dtype="<u4").astype(np.int64)
    own = pa.ipc.open_stream(parts[1]).read_all().column(0).combine_chunks()
    ids = table[unpack(parts[3], parts[4], int(lengths.sum()))] if lengths.sum() else np.zeros(0, dtype="<u4")
    return own, np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


#: The split pattern of the vocabulary file's pre-tokenizer, on lower-case text below U+0180, where Python's classes agree with it.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿĀ-ſªµº]+|[0-9²³¹¼-¾]|[^\sa-zß-öø-ÿĀ-ſªµº0-9²³¹¼-¾]+").findall
#: Texts with any of these go to the library whole: higher characters, a lower-casing that adds one, and separators that only Python
#: takes for white space.
_OTHER = re.compile("[^\x00-ſ]|İ|[\x1c-\x1f]").search


class WordTokenizer:
    """The tokenizers library over a store of words: a text is cut at white space, a new word as the library's own pre-tokenizer does,
    and each part that the store lacks is encoded by the library's model."""

    def __init__(self, path: str, room: int = 112 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.size = self.tok.get_vocab_size()
        self.code, self.kind = ("H", "<u2") if self.size <= 1 << 16 else ("I", "<u4")
        self.words = Recent(self._word, room)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)").search
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: these stand for themselves, the rest follow 255
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(shown))}

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalpha()):  # letters a to z are one part, and stand for themselves in the byte alphabet
            parts = WORDS(word)
            if len(parts) != 1:
                return b"".join(map(self.words.__getitem__, parts))
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _plain(self, text: str) -> bool:
        if text.isascii():
            odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        else:
            odd = _OTHER(text) or not unicodedata.is_normalized("NFC", text)
        return not odd and not ("<|" in text and self.special(text))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text in the least of two or four bytes that holds the vocabulary."""
        if not text:
            return np.zeros(0, dtype=self.kind)
        if not self._plain(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.kind)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), dtype=self.kind)


_MADE: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _MADE:
        _MADE[path] = WordTokenizer(path)
    return _MADE[path]


def write_tokens(docs: DataFrame, path: str, out_dir: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the files into out_dir, and return their manifest: shard, no, uri, documents, tokens.

    Documents are in ascending id order, across files too (null ids first; rows that repeat an id stand in order of their coded ids).
    A null or empty text is the end id alone; a text of any length is one entry. An empty table writes no file. Other columns
    aren't looked at."""
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType
    id_type = arrow_type(kind)
    schema = T.StructType([T.StructField("_id", kind), T.StructField("_ids", T.BinaryType()), T.StructField("_counts", T.BinaryType())])

    def encode(batches):
        tok = tokenizer(path)
        end = np.array([end_id], dtype=tok.kind).tobytes()
        total = np.zeros(max(tok.size, end_id + 1), dtype=np.int64)
        for b in slices(batches, 8 << 20):
            made = []
            for t in b.column(1):
                ids = tok.encode(t.as_py())
                total += np.bincount(ids, minlength=len(total)) if len(ids) > 1 << 20 else 0
                made.append(ids.tobytes() + end)
            short = b"".join([m for m in made if len(m) <= len(end) << 20])
            total += np.bincount(np.frombuffer(short, dtype=tok.kind), minlength=len(total))
            total[end_id] += len(made) - sum(len(m) <= len(end) << 20 for m in made)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(made, pa.binary()), pa.nulls(len(made), pa.binary())], names=schema.names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=schema.names)

    coded = materialize(rows.mapInArrow(encode, schema), "token-ids")

    def count(batches):
        total = sum(np.frombuffer(x, dtype=np.int64) for b in batches for x in b.column(0).to_pylist())
        if not isinstance(total, int):
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["i", "n"])

    counted = coded.select("_counts").filter("_counts is not null").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "i")
    table = np.array([r.i for r in counted.collect()], dtype=np.uint32)  # at most the vocabulary
    held = docs.sparkSession.sparkContext.broadcast(table)

    def write(batches):
        raw = tokenizer(path).kind
        shard, part, size, no = TaskContext.get().partitionId(), [], 0, 0
        ids: list = []

        def flush():
            uri = f"{out_dir}/{shard:06d}-{no:06d}.sltk"
            commit_file(uri, write_shard(held.value, pa.array(ids, id_type), part))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([no], pa.int64()), pa.array([uri]), pa.array([len(part)], pa.int64()), pa.array([size], pa.int64())], names=["shard", "no", "uri", "documents", "tokens"])

        for b in slices(batches, 8 << 20):
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part.append(np.frombuffer(x, dtype=raw))
                ids.append(i)
                size += len(part[-1])
                if size >= 4 << 20:
                    yield flush()
                    part, ids, size, no = [], [], 0, no + 1
        if part:
            yield flush()

    ordered = coded.filter("_ids is not null").select("_id", "_ids").repartitionByRange("_id").sortWithinPartitions("_id", "_ids")
    manifest = materialize(ordered.mapInArrow(write, "shard long, no long, uri string, documents long, tokens long"), "token-manifest")
    release(coded)
    return manifest


def read_tokens(manifest: DataFrame, id_type: T.DataType = T.LongType()) -> DataFrame:
    """_id, _start, _n_tokens, _ids_crc32 of every document, from the files of a manifest alone; id_type: of the documents' ids.

    A document's start counts the ids of all files and documents before it. An empty manifest gives an empty result."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard", "no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(manifest.select("uri", before.alias("base")), "token-bases")  # a row per file
    files = files.repartition(max(1, min(files.count() // 4, 100_000)), "uri")
    out = T.StructType([T.StructField("_id", id_type), T.StructField("_start", T.LongType()), T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_crc32", T.LongType())])
    own_type = arrow_type(id_type)

    def read(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, got = read_shard(read_file(b.column(0)[k].as_py()))
                n = np.array([len(x) for x in got], dtype=np.int64)
                start = b.column(1)[k].as_py() + np.cumsum(n) - n
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in got]
                yield pa.RecordBatch.from_arrays([ids.cast(own_type), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=out.names)

    return files.mapInArrow(read, out)


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "tokens"), end_id=2)
    got = read_tokens(manifest, docs.schema["doc_id"].dataType)
    return got.select(F.col("_id").alias("doc_id"), F.col("_start").alias("start"), F.col("_n_tokens").alias("n_tokens"), F.col("_ids_crc32").alias("ids_crc32"))
