"""Removal of repeated byte strings with a run-length suffix index.

Every string of `length` bytes is sent to where its copies are by its minimizer: of its k-byte substrings, the one with the least hash.
Neighbouring strings with one minimizer occurrence travel together as a segment. Steps, each over the whole corpus:

1. find segments; by minimizer, keep those whose minimizer occurs again;
2. cut the kept segments out of the texts; equal ones are merged before and after they travel, and all but the first are repeats;
3. of a minimizer's different segments, build a run-compressed Burrows-Wheeler transform with the suffix positions at its run
   ends, stream the matching statistics off these samples (within a run they follow from the position before), and link
   every string of `length` bytes with the suffix before it if they match that far; all but the first of a class are repeats;
4. merge the repeats of each document and cut them out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, materialize, slices

LENGTH = 100
KMER = 24
#: Bytes of text a bucket of documents or of minimizers holds, about; there are as many buckets as the corpus needs.
BUCKET_BYTES = 8 << 20
#: Symbols in one index. A minimizer whose segments hold more takes several (repeated_in_parts).
INDEX_SYMBOLS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ENTRY = np.dtype([("anchor", "<u8"), ("key", "<i8"), ("start", "<u4"), ("n", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("n", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<u4"), ("end", "<u4")])


class RunLengthIndex:
    """Run-compressed BWT of an array of symbols (0 separates, and no 0 is equal to another), with samples at the run ends.

    heads: text positions of the suffixes that begin a run, ascending; before: the position of the suffix sorted just before each (the
    end of the run before); match: how far the two agree."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        order = suffix_array(text)
        prior = np.where(order > 0, text[order - 1].astype(np.int32), -1)  # the transform; -1 at the whole text
        starts = np.flatnonzero(np.r_[True, (prior[1:] != prior[:-1]) | (prior[1:] == 0)]) if n else np.zeros(0, dtype=np.int64)
        self.symbols, self.lengths = prior[starts], np.diff(np.r_[starts, n])
        head = order[starts]
        prev = np.where(starts > 0, order[np.maximum(starts - 1, 0)], -1)
        by = np.argsort(head)
        self.heads, self.before = head[by], prev[by]
        self.match = common_prefix(text, self.heads, self.before)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position: the position of the suffix sorted before it, and the length of their match."""
        at = np.arange(self.n)
        s = np.searchsorted(self.heads, at, side="right") - 1
        ahead = at - self.heads[s]
        known = self.before[s] >= 0
        return np.where(known, self.before[s] + ahead, -1), np.where(known, np.maximum(self.match[s] - ahead, 0), 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of symbols below 511, where 0 separates: each 0 is a symbol of its own, in order of place and below all others. Sorted by seven
    symbols packed in a word, then by prefix doubling within the suffixes that still are equal."""
    n = len(text)
    wide = np.zeros(n + 7, dtype=np.uint64)
    wide[:n] = text.astype(np.uint64) + np.uint64(1)
    key, whole = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(7):
        symbol = wide[k : n + k]
        key = key << np.uint64(9) | np.where(whole, symbol, np.uint64(0))
        whole &= symbol != 1
    order = np.argsort(key)
    key_of = key[order]
    start = np.flatnonzero(np.r_[True, key_of[1:] != key_of[:-1]][:n])
    size = np.diff(np.r_[start, n])
    rank = np.empty(n, dtype=np.int64)  # the place of the first suffix that is equal so far
    rank[order] = np.repeat(start, size)
    cut = np.flatnonzero(~whole)  # what has a separator is equal to nothing: it takes its place by order in the text
    by = cut[np.argsort(rank[cut], kind="stable")]
    edge = np.r_[True, rank[by][1:] != rank[by][:-1]][: len(by)]
    rank[by] += np.arange(len(by)) - np.flatnonzero(edge)[np.cumsum(edge) - 1] if len(by) else 0
    tied = np.zeros(n, dtype=bool)
    tied[order] = np.repeat(size > 1, size)
    tied[cut] = False
    live, reach = np.flatnonzero(tied), 7
    while len(live):
        ahead = live + reach
        key = rank[live] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        live, key, base = live[by], key[by], rank[live[by]]
        here = np.arange(len(live))
        first = np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], here, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        rank[live] = base + np.maximum.accumulate(np.where(new, here, 0)) - first
        live = live[~(new & np.r_[new[1:], True])]
        reach *= 2
    order[rank] = np.arange(n)
    return order


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match at each pair of different positions (b < 0: none); a separator matches nothing."""
    n, step = len(text), 16
    out, live = np.zeros(len(a), dtype=np.int64), np.flatnonzero(b >= 0)
    one = np.r_[text.astype(np.int32), np.full(step, -1)]
    one[one == 0] = -1
    other = np.where(one < 0, -2, one)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        fits = (x < n) & (y < n)
        live, x, y = live[fits], x[fits], y[fits]
        same = one[x[:, None] + np.arange(step)] == other[y[:, None] + np.arange(step)]
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[live] += run
        live = live[run == step]
    return out


def repeated_strings(segments: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """segments in corpus order; the first counts[k] places of each begin strings of `length` bytes. For each segment, which of these
    strings begins earlier too."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), dtype=np.uint16)
    body = np.frombuffer(b"".join(segments), dtype=np.uint8)
    where = np.arange(len(body)) + np.repeat(np.arange(len(sizes)), sizes)
    text[where] = body.astype(np.uint16) + 1
    before, match = RunLengthIndex(text).matching_statistics()
    up = np.where(match >= length, before, np.arange(len(text)))
    while True:  # to the first suffix of each class
        top = up[up]
        if np.array_equal(top, up):
            break
        up = top
    own = np.zeros(len(text) + 1, dtype=np.int64)
    own[begin] += 1
    own[begin + counts] -= 1
    own = np.cumsum(own[:-1]) > 0
    first = np.full(len(text), len(text), dtype=np.int64)
    at = np.flatnonzero(own)
    np.minimum.at(first, up[at], at)
    late = np.zeros(len(text), dtype=bool)
    late[at] = first[up[at]] < at
    return [late[b : b + c] for b, c in zip(begin, counts)]


def repeated_in_parts(segments: list[bytes], counts: np.ndarray, length: int, kmer: int = KMER, most: int = INDEX_SYMBOLS, level: int = 1) -> list[np.ndarray]:
    """The same for any amount of segments of one minimizer, with indexes of about `most` symbols. One index for each stretch of segments
    leaves the strings that are first there; those are cut by another minimizer, from level 5 on string by string, and each group of
    them, which holds all copies of its strings, is indexed in turn, or cut again while it is too large."""
    late: list[np.ndarray] = []
    most = max(most, 16 * length)  # a stretch holds some strings, so that of copies of one only few are left
    stretch = np.cumsum([len(s) + 1 for s in segments]) // (most // 2)
    edge = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]]).tolist()
    for a, z in zip(edge, [*edge[1:], len(segments)]):
        late += repeated_strings(segments[a:z], counts[a:z], length)
    if len(edge) == 1:
        return late
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for k, hit in enumerate(late):
        for a, z in _runs(~hit):
            body = segments[k][a : z + length - 1]
            if level < 5:
                h, start, n = find_segments(body, length, kmer, level)
                cuts = zip(h.tolist(), start.tolist(), n.tolist())
            else:
                salt = level.to_bytes(8, "little")
                cuts = ((int.from_bytes(hashlib.blake2b(body[i : i + length], digest_size=8, salt=salt).digest(), "little") % (4 * len(edge)), i, 1) for i in range(z - a))
            for h, start, n in cuts:
                groups.setdefault(h, []).append((k, a + start, n))

    def decide(group, how, *more):
        bodies = [segments[k][a : a + n + length - 1] for k, a, n in group]
        for (k, a, n), hit in zip(group, how(bodies, np.array([n for _, _, n in group], dtype=np.int64), length, *more)):
            late[k][a : a + n] |= hit

    batch, size = [], 0
    for group in groups.values():
        own = sum(n + length for _, _, n in group)
        if len(group) < 2:
            continue
        if own > most:
            decide(group, repeated_in_parts, kmer, most, level + 1)
            continue
        if size + own > most:
            decide(batch, repeated_strings)
            batch, size = [], 0
        batch, size = batch + group, size + own
    if batch:
        decide(batch, repeated_strings)
    return late


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.r_[0, on.astype(np.int8), 0])
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def find_segments(raw: bytes, length: int = LENGTH, kmer: int = KMER, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: minimizer hash, first start and number of the strings of each segment. Documents are cut apart by the caller; each salt
    has minimizers of its own."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    n, w = len(buf), length - kmer + 1
    if n < length:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    power, back = _powers(n)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=run[1:])
    h = (run[kmer:] - run[:-kmer]) * back[: n - kmer + 1]
    h += np.uint64(salt * int(_BASE) & (1 << 64) - 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - length + 1], least[w - span : w - span + n - length + 1])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[at[start]], start, np.diff(np.r_[start, len(at)])


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (_BASE, _BACK)]
    return _POWERS


def _pieces(texts, most: int = 1 << 20, length: int = LENGTH):
    """(number of the text, offset, bytes): long texts in pieces that share length - 1 bytes."""
    for k, t in enumerate(texts):
        step = most - length + 1
        for at in range(0, max(len(t) - length + 1, 0), step):
            yield k, at, t[at : at + most]


def _by_bucket(values: np.ndarray, bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    values, bucket = values[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        yield int(bucket[a]), values[a:b], order[a:b]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


def repeated_spans(keyed: DataFrame, buckets: int, length: int = LENGTH, kmer: int = KMER, index_symbols: int = INDEX_SYMBOLS) -> DataFrame:
    """keyed: _doc, _key, _text (distinct keys count once). Returns _kb (bucket of the key) and _spans (packed byte spans to remove)."""

    def segments(batches):
        for b in slices(batches, 4 << 20):
            keys = b.column(0).to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            found = []
            for k, at, raw in _pieces(texts, length=length):
                h, start, n = find_segments(raw, length, kmer)
                e = np.zeros(len(h), dtype=_ENTRY)
                e["anchor"], e["key"], e["start"], e["n"] = h, keys[k], start + at, n
                found.append(e)
            if not found:
                continue
            e = np.concatenate(found)
            e = e[np.argsort(e["anchor"], kind="stable")]
            again = np.r_[False, e["anchor"][1:] == e["anchor"][:-1]]
            known = np.r_[again[1:], False] & ~again  # the first of a minimizer that this batch has more often
            rows = []
            # A minimizer sends one entry of a batch to its bucket; the rest are known to occur again and only travel on.
            for kind, some, bucket in ((0, e[~again & ~known], None), (1, e[known], None), (2, e[again], "key")):
                to = (some["key"].view(np.uint64) if bucket else some["anchor"]) % np.uint64(buckets)
                rows += [(k, kind, v.tobytes()) for k, v, _ in _by_bucket(some, to.astype(np.int64))]
            yield from _table(first, rows).to_batches()

    first = pa.schema([("b", pa.int32()), ("kind", pa.int32()), ("entries", pa.binary())])

    def probe(batches):
        single, known, more = [], [], []
        for b in batches:
            for kind, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                (single, known, more)[kind].append(np.frombuffer(x, dtype=_ENTRY))
        e = np.concatenate([*single, *known, np.zeros(0, dtype=_ENTRY)])
        sure = np.zeros(len(e), dtype=bool)
        sure[len(e) - sum(map(len, known)) :] = True
        order = np.argsort(e["anchor"], kind="stable")
        e, sure = e[order], sure[order]
        same = np.r_[False, e["anchor"][1:] == e["anchor"][:-1]]
        e = np.concatenate([e[same | np.r_[same[1:], False][: len(e)] | sure], *more])
        rows = [(k, v.tobytes()) for k, v, _ in _by_bucket(e, (e["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int64))]
        yield from _table(second, rows).to_batches()

    second = pa.schema([("_kb", pa.int32()), ("entries", pa.binary())])

    def cut(docs: pa.Table, entries: pa.Table) -> pa.Table:
        if not entries.num_rows or not docs.num_rows:
            return third.empty_table()
        e = np.concatenate([np.frombuffer(x, dtype=_ENTRY) for x in entries.column("entries").to_pylist()])
        e = e[np.lexsort((e["start"], e["key"]))]
        e = e[np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["start"][1:] != e["start"][:-1])]]  # repeated rows send theirs twice
        edge = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]])
        of = dict(zip(e["key"][edge].tolist(), zip(edge.tolist(), [*edge[1:].tolist(), len(e)])))
        seen: dict[bytes, int] = {}
        places, anchors, bodies, late = [], [], [], []
        done = set()
        doc, key, text = docs.column("_doc").to_numpy(), docs.column("_key").to_numpy(), docs.column("_text")
        for i in np.lexsort((key, doc)).tolist():  # in corpus order: of equal segments the first goes on
            k = int(key[i])
            if k in done or k not in of:
                continue
            done.add(k)
            raw = text[i].as_py().encode("utf-8", "surrogatepass")
            a, b = of[k]
            for s, n, h in zip(e["start"][a:b].tolist(), e["n"][a:b].tolist(), e["anchor"][a:b].tolist()):
                body = raw[s : s + n + length - 1]
                if body in seen:
                    late.append((int(doc[i]), k, s, n))
                else:
                    seen[body] = 1
                    places.append((int(doc[i]), k, s, n))
                    anchors.append(h)
                    bodies.append(body)
        rows = []
        place, anchor = np.array(places, dtype=_PLACE), np.array(anchors, dtype=np.uint64)
        for k, v, which in _by_bucket(place, (anchor % np.uint64(buckets)).astype(np.int64)):
            rows.append((k, anchor[which].tobytes(), v.tobytes(), b"".join([bodies[j] for j in which.tolist()])))
        late_at = np.array(late, dtype=_PLACE)
        for k, v, _ in _by_bucket(late_at, (late_at["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)):
            rows.append((k, b"", v.tobytes(), b""))
        return _table(third, rows)

    third = pa.schema([("b", pa.int32()), ("anchors", pa.binary()), ("places", pa.binary()), ("bodies", pa.binary())])

    def index(batches):
        places, anchors, bodies, late = [np.zeros(0, dtype=_PLACE)], [np.zeros(0, dtype=np.uint64)], [], [np.zeros(0, dtype=_PLACE)]
        for b in batches:
            for h, p, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                p = np.frombuffer(p, dtype=_PLACE)
                if not h:
                    late.append(p)
                    continue
                places.append(p)
                anchors.append(np.frombuffer(h, dtype=np.uint64))
                ends = np.cumsum(p["n"].astype(np.int64) + length - 1)
                bodies += [body[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        place, anchor = np.concatenate(places), np.concatenate(anchors)
        first_of: set[bytes] = set()
        keep = np.zeros(len(place), dtype=bool)
        for i in np.lexsort((place["start"], place["key"], place["doc"])).tolist():
            if bodies[i] not in first_of:
                first_of.add(bodies[i])
                keep[i] = True
        late = np.concatenate([*late, place[~keep]])
        spans = np.zeros(len(late), dtype=_SPAN)
        spans["doc"], spans["key"], spans["start"], spans["end"] = late["doc"], late["key"], late["start"], late["start"] + late["n"] + np.uint32(length - 1)
        found = [spans]
        left = np.lexsort((place["start"], place["key"], place["doc"], anchor))
        left = left[keep[left]]
        edge = np.flatnonzero(np.r_[True, anchor[left][1:] != anchor[left][:-1]]) if len(left) else []
        batch, size = [], 0

        def flush(how, *more):
            some = np.concatenate(batch)
            for i, hit in zip(some.tolist(), how([bodies[j] for j in some.tolist()], place["n"][some].astype(np.int64), length, *more)):
                runs = _runs(hit)
                if runs:
                    s = np.zeros(len(runs), dtype=_SPAN)
                    a, z = np.array(runs).T
                    s["doc"], s["key"], s["start"], s["end"] = place["doc"][i], place["key"][i], place["start"][i] + a, place["start"][i] + z + length - 1
                    found.append(s)

        for a, z in zip(edge, [*edge[1:], len(left)]):
            if z - a < 2:
                continue  # all its occurrences are equal: repeats already, but for the first
            group = left[a:z]
            own = sum(len(bodies[j]) + 1 for j in group.tolist())
            if own > index_symbols:
                kept_batch, batch = batch, [group]
                flush(repeated_in_parts, kmer, index_symbols)
                batch = kept_batch
                continue
            if size + own > index_symbols:
                flush(repeated_strings)
                batch, size = [], 0
            batch.append(group)
            size += own
        if batch:
            flush(repeated_strings)
        spans = np.concatenate(found)
        rows = [(k, v.tobytes()) for k, v, _ in _by_bucket(spans, (spans["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int64))]
        yield from _table(fourth, rows).to_batches()

    fourth = pa.schema([("_kb", pa.int32()), ("_spans", pa.binary())])
    entries = keyed.select("_key", "_text").mapInArrow(segments, "b int, kind int, entries binary").repartition(buckets, "b").mapInArrow(probe, "_kb int, entries binary")
    cuts = keyed.select("_kb", "_doc", "_key", "_text").groupBy("_kb").cogroup(entries.groupBy("_kb")).applyInArrow(cut, "b int, anchors binary, places binary, bodies binary")
    return materialize(cuts.repartition(buckets, "b").mapInArrow(index, "_kb int, _spans binary"), "repeats")


def merge_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(spans["start"].tolist(), spans["end"].tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER, keep: bool = True, bucket_bytes: int = BUCKET_BYTES, index_symbols: int = INDEX_SYMBOLS) -> DataFrame:
    """_id, _n_bytes, _n_removed, _n_spans, _kept_sha256 of every row; with keep also _spans (array of start, end) and _kept (binary).

    The corpus order is by id (a long; null ids come first), and within a document by place. Rows with equal id and text are one
    document and get the same result; different texts under one id go in the order of a hash of their text. A null or short text has
    nothing to remove; an empty table gives an empty result. Matches never cross documents."""
    if not 8 <= kmer <= length or length - kmer + 1 > 255:
        raise ValueError("kmer must be at least 8 and within 254 of length")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    whole = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(16, int(whole // bucket_bytes) + 1)
    key = F.xxhash64(docs[id_col], text)
    keyed = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("_doc"), key.alias("_key"), text.alias("_text"), docs[id_col].alias("_id"))
    # The bucket of a key as numpy has it: its remainder as an unsigned number.
    high, low = F.shiftrightunsigned("_key", 32), F.col("_key").bitwiseAND(0xFFFFFFFF)
    keyed = keyed.withColumn("_kb", (((high % buckets) * ((1 << 32) % buckets) + low) % buckets).cast("int"))
    spans = repeated_spans(keyed, buckets, length, kmer, index_symbols)
    kind = keyed.schema["_id"].dataType
    fields = [("_id", arrow_type(kind)), ("_n_bytes", pa.int64()), ("_n_removed", pa.int64()), ("_n_spans", pa.int64()), ("_kept_sha256", pa.string())]
    fields += [("_spans", pa.list_(pa.list_(pa.int64()))), ("_kept", pa.binary())] if keep else []
    schema = pa.schema(fields)
    ddl = f"_id {kind.simpleString()}, _n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string" + (", _spans array<array<long>>, _kept binary" if keep else "")

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        s = np.concatenate([np.zeros(0, dtype=_SPAN), *[np.frombuffer(x, dtype=_SPAN) for x in found.column("_spans").to_pylist()]])
        s = s[np.lexsort((s["key"], s["doc"]))]
        edge = np.flatnonzero(np.r_[True, (s["key"][1:] != s["key"][:-1]) | (s["doc"][1:] != s["doc"][:-1])]) if len(s) else np.zeros(0, dtype=np.int64)
        of = {(int(s["doc"][a]), int(s["key"][a])): s[a:z] for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(s)])}
        rows = []
        for doc, k, text, own in zip(texts.column("_doc").to_pylist(), texts.column("_key").to_pylist(), texts.column("_text"), texts.column("_id").to_pylist()):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            gone = merge_spans(of[doc, k]) if (doc, k) in of else []
            left = b"".join([raw[a:b] for a, b in zip([0, *[z for _, z in gone]], [*[a for a, _ in gone], len(raw)])]) if gone else raw
            rows.append((own, len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *(([list(g) for g in gone], left) if keep else ())))
        return _table(schema, rows)

    return keyed.select("_kb", "_doc", "_key", "_text", "_id").groupBy("_kb").cogroup(spans.groupBy("_kb")).applyInArrow(finish, ddl)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
    return got.select(F.col("_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))
