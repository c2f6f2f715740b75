"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items, scanning texts once.

Texts are compared by words: A to Z in lower case, every other ASCII character that is neither a letter nor a digit between words, and
all beyond ASCII within them. These rules work on UTF-8 bytes without changing their number, so a word's place in the normalised text
is its place in the original. The pattern of a window is its words between single spaces, so that a hit begins and ends at words.

The windows are put into parts of bounded size by their hash; a benchmark of a usual size is one part and so one automaton. Each
worker builds the automaton of a part once and holds it; with more parts, a block of texts is scanned for one part after the other.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, filesystem, id_and_text, materialize, release, slices

WINDOW = 10
#: Bytes of the patterns of a part (each becomes a few tens of bytes of automaton), and of the texts that are held while parts take turns.
PART_BYTES, BLOCK_BYTES = 4 << 20, 32 << 20
#: Normalised bytes that the automaton gets at a time; its state goes on from piece to piece.
PIECE = 1 << 20
#: A space for every ASCII character that ends a word, lower case for A to Z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """_pattern, _n (its words) and _items (ids of the items that have it, as strings, sorted) of every different window.

    An item of fewer words is one window, one of none (or null) has no window; ids that repeat are one item, a null id is ''."""

    def run(batches):
        for b in slices(batches, 4 << 20):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text)
                made = {b" " + b" ".join(w[k : k + size]) + b" " for k in range(max(1, len(w) - size + 1))} if w else ()
                made = sorted(made)
                for k in range(0, len(made), 10_000):
                    some = made[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([min(len(w), size)] * len(some), pa.int64()), pa.array([i] * len(some))], names=["_pattern", "_n", "_item"])

    rows = id_and_text(items, id_col, text_col).select(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text")
    got = rows.mapInArrow(run, "_pattern binary, _n long, _item string")
    return got.groupBy("_pattern", "_n").agg(F.array_sort(F.collect_set("_item")).alias("_items"))


def parts_of(windows: DataFrame, part_bytes: int = PART_BYTES) -> tuple[list[str], DataFrame]:
    """Files of the parts, each of about part_bytes at most, and the table that holds them."""
    windows = materialize(windows, "leak-windows")
    size = windows.agg(F.sum(F.octet_length("_pattern") + 16 * F.size("_items"))).first()[0] or 0
    parts = materialize(windows.repartition(max(1, -(-size // part_bytes)), F.xxhash64("_pattern")), "leak-parts")
    release(windows)
    return sorted(parts.inputFiles()), parts


class Part:
    """The automaton of a part, and words and items of each of its patterns."""

    def __init__(self, uri: str):
        import ahocorasick

        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            t = pq.read_table(f)
        self.n = np.array(t.column("_n").to_pylist(), dtype=np.int64)
        self.items = t.column("_items").to_pylist()
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(t.column("_pattern").to_pylist()):
            self.automaton.add_word(p.decode("latin-1"), k)
        if len(self.n):
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Where in the words, joined and enclosed by single spaces, a pattern ends, and which."""
        if not len(self.n) or not words:
            return [], []
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ends, which, found = [], [], None
        for k in range(0, len(text), PIECE):
            if found is None:
                found = self.automaton.iter(text[:PIECE])
            else:
                found.set(text[k : k + PIECE], False)
            for end, p in found:
                ends.append(end)
                which.append(p)
        return ends, which


_HELD: OrderedDict[str, Part] = OrderedDict()


def part(uri: str) -> Part:
    """Of the parts, a worker holds the last one used."""
    if uri not in _HELD:
        _HELD.clear()
        _HELD[uri] = Part(uri)
    return _HELD[uri]


def covered(words: list[bytes], ends: list[int], sizes: np.ndarray) -> np.ndarray:
    """Which words lie within an occurrence, from the places where patterns of so many words end."""
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)  # of the space after each word
    last = np.searchsorted(stops, np.array(ends))
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, last - sizes + 1, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step)[:-1] > 0


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """The runs of hit words as code points of the original text: start, end (behind the last)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate([[False], np.frombuffer(raw.tobytes().translate(TABLE), dtype=np.uint8) != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # starts and ends of words, in turn
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(chars[edges[2 * a]]), "end": int(chars[edges[2 * z - 1]])} for a, z in zip(runs[::2], runs[1::2])]


def _blocks(batches):
    """Lists of Arrow batches of about BLOCK_BYTES."""
    held, size = [], 0
    for b in slices(batches, 8 << 20):
        held.append(b)
        size += b.nbytes
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(texts: list, uris: list[str]) -> list[tuple[int, np.ndarray | None, list[str]]]:
    """Of each text its words, which are hit (None: not one) and the items found."""
    words = [words_of(t) for t in texts] if len(uris) == 1 else None
    found: list[list] = [[0, None, set()] for _ in texts]
    for uri in uris:
        p = part(uri)
        for k, t in enumerate(texts):
            w = words[k] if words is not None else words_of(t)
            found[k][0] = len(w)
            ends, which = p.hits(w)
            if ends:
                hit = covered(w, ends, p.n[np.array(which)])
                found[k][1] = hit if found[k][1] is None else found[k][1] | hit
                found[k][2].update(*[p.items[x] for x in set(which)])
    return [(n, hit, sorted(items)) for n, hit, items in found]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of docs: _id, _n_words, _n_hit (words inside an occurrence of a window), _items (ids as strings, sorted) and _spans (start
    and end of the runs of hit words, in code points of the original text).

    A null or empty text has no words. Texts of any length are scanned whole; rows are neither shuffled nor joined. Rows that repeat
    are reported each, null ids too; other columns of both tables aren't looked at, so their names may clash. Empty tables give an
    empty result, or rows without hits."""
    uris, _ = parts_of(item_windows(items, item_col, item_text, size), part_bytes)
    id_type = docs.schema[id_col].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_spans", T.ArrayType(span))])
    own = [arrow_type(f.dataType) for f in schema]

    def run(batches):
        for block in _blocks(batches):
            for b in block if len(uris) == 1 else [pa.Table.from_batches(block).combine_chunks().to_batches()[0]]:
                texts = b.column(1).to_pylist()
                got = _scan(texts, uris)
                spans = [spans_of(t, hit) if hit is not None else [] for t, (_, hit, _) in zip(texts, got)]
                cols = [b.column(0).cast(own[0]), [g[0] for g in got], [0 if g[1] is None else int(g[1].sum()) for g in got], [g[2] for g in got], spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(cols, own)], names=schema.names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit word, with all their columns of whatever names; cases as find_leaks."""
    uris, _ = parts_of(item_windows(items, item_col, item_text, size))
    at, names = docs.columns.index(text_col), docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches):
        for block in _blocks(batches):
            for b in block:
                yield b.filter(pa.array([hit is None for _, hit, _ in _scan(b.column(at).to_pylist(), uris)]))

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    got = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select(F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM p),
     x AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
           FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, sizes WHERE len(w) >= n)),
     h AS (SELECT x.doc_id, x.n, x.s, p.item_id FROM x JOIN p ON x.win = p.win AND x.n = p.n),
     hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, n, s FROM h)) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
