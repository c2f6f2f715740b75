"""SentencePiece BPE encoding by backtracking, and decoding.

A piece sequence is the merge encoding of a text exactly if each two neighbours, joined and merged again, come out as these two. The
encoder takes the longest piece that an Aho-Corasick automaton finds at a place, checks it against the piece before by
re-merging (remembered per pair), tries shorter ones, and steps back when none fits; a bitfield marks places that failed, so none is
tried twice. A text is first cut where no piece of the vocabulary reaches across, and encodings of these parts are kept in
a bounded store per Python worker.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, arrow_type, slices

MARK = "▁"
#: Above all piece ids; the number of a character that has no piece.
UNKNOWN = 1 << 20
NEVER = float("inf")
#: Bytes of the stores of one Python worker.
ROOM = 112 << 20


#: Characters of a text whose words are held at once.
LOT = 1 << 20


def _lots(text: str):
    """A text in lots of about LOT characters, cut at single spaces."""
    at = 0
    while (end := text.find(" ", at + LOT)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


class PieceBpe:
    """Encoder for a SentencePiece model of type BPE with identity normalisation and a dummy prefix."""

    def __init__(self, model_file: str, room: int = ROOM):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids, self.names = {}, {}
        for k in range(sp.get_piece_size()):
            if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)):
                self.ids[sp.id_to_piece(k)] = k
                self.names[k] = sp.id_to_piece(k)
        self.rank = {p: -sp.get_score(k) for p, k in self.ids.items()}
        #: The longest shorter piece that a piece begins with; at the end of the chain a first character that is no piece, or -1.
        self.shorter = {k: next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), UNKNOWN + ord(p[0]) if len(p) > 1 else -1) for k, p in self.names.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{k:02X}>") for k in range(256)]
        self.eos = sp.eos_id()
        self.machine = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.machine.add_word(p, (len(p), k))
        self.machine.make_automaton()
        self.widest = max(map(len, self.ids), default=1)
        self.compatible = Recent(self._compatible, room // 4)
        self.words = Recent(self._word, room // 2)
        self.parts = Recent(self._part, room // 4)  # only what isn't a word
        pattern = self._cut_pattern()
        self.cut, self.cuts, self.by_word = re.compile(pattern).findall, re.compile(pattern).finditer, MARK in pattern  # with MARK: no piece reaches over a space after something else

    def _cut_pattern(self) -> str:
        """Cuts between characters that are neighbours in no piece: before a space that follows something else, and, if the vocabulary
        agrees, between letters and others."""
        joins = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        if any(x[0] != MARK and x[1] == MARK for x in joins):
            return r"(?s).+"
        plain = {chr(k) for k in range(128) if not chr(k).isalpha()}
        across = lambda: {c for x in joins if MARK not in x and (x[0] in plain) != (x[1] in plain) for c in x if c not in plain}
        if len(odd := across()) > 64:
            return rf"(?s){MARK}+[^{MARK}]*|[^{MARK}]+"
        plain |= odd
        if across():
            return rf"(?s){MARK}+[^{MARK}]*|[^{MARK}]+"
        c = "".join(map(re.escape, sorted(plain)))
        return rf"(?s){MARK}+(?:[^{MARK}{c}]+|[{c}]*)|[^{MARK}{c}]+|[{c}]+"

    def merge(self, text: str) -> list[str]:
        """The merges themselves, best score first and then leftmost, on a short text."""
        parts, rank = list(text), self.rank.get
        order = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) < NEVER:
            i = order.index(best)
            parts[i] += parts.pop(i + 1)
            order.pop(i)
            if i:
                order[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(order):
                order[i] = rank(parts[i] + parts[i + 1], NEVER)
        return parts

    def _compatible(self, pair: int) -> bool:
        a, b = self.names[pair >> 21], self.names[pair & (1 << 21) - 1]
        return self.merge(a + b) == [a, b]

    def backtrack(self, text: str) -> list[int]:
        """Numbers of the pieces of a text (with marks for spaces); a character without a piece has the number UNKNOWN + its code."""
        out, at, compatible, last = [], 0, self.compatible, -1
        for end, (size, k) in self.machine.iter_long(text):  # the longest matches alone are mostly right
            start = end - size + 1
            while at < start:
                out.append(UNKNOWN + ord(text[at]))
                at += 1
                last = -1
            if last >= 0 and not compatible[last << 21 | k]:
                return self._search(text, out, start, k)
            out.append(k)
            at, last = end + 1, k
        out.extend(UNKNOWN + ord(c) for c in text[at:])
        return out

    def _search(self, text: str, out: list[int], at: int, k: int) -> list[int]:
        """Goes on where the longest matches stop being compatible: after `out`, at place `at`, with piece k as the next to try."""
        n, failed, compatible, longest, shorter, names, widest = len(text), bytearray(len(text) + 1), self.compatible, self.machine.iter_long, self.shorter, self.names, self.widest
        while at < n:
            if k is None:  # the longest match, of as many characters as a piece may have
                end, (size, k) = next(longest(text[at : at + widest]), (n, (0, -1)))
                if end - size + 1:
                    k = UNKNOWN + ord(text[at])  # alone, compatible with everything
            before = out[-1] if out else UNKNOWN
            while k >= 0 and k < UNKNOWN and (failed[at + len(names[k])] or before < UNKNOWN and not compatible[before << 21 | k]):
                k = shorter[k]
            if k < 0:  # nothing fits here
                failed[at] = 1
                k = out.pop()
                at -= len(names[k]) if k < UNKNOWN else 1
                k = shorter[k] if k < UNKNOWN else -1
                continue
            out.append(k)
            at += len(names[k]) if k < UNKNOWN else 1
            k = None
        return out

    def _part(self, part: str) -> bytes:
        ids = self.backtrack(part)
        if max(ids) >= UNKNOWN:
            whole: list[int] = []
            for k in ids:
                whole.extend([k] if k < UNKNOWN else [self.byte_ids[b] for b in chr(k - UNKNOWN).encode("utf-8", "surrogatepass")])
            ids = whole
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        first, *rest = self.cut(MARK + word)
        return b"".join([self.words[first[1:]], *map(self.parts.__getitem__, rest)]) if rest else self._part(first)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as the library's encode() gives them, without an end id."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if not (text[0] == " " or text[-1] == " " or "  " in text or MARK in text) and self.by_word:
            return np.frombuffer(b"".join([b"".join(map(self.words.__getitem__, t.split(" "))) for t in _lots(text)]), dtype="<u4")
        marked = MARK + text.replace(" ", MARK)
        if len(marked) < LOT:
            return np.frombuffer(b"".join(map(self.parts.__getitem__, self.cut(marked))), dtype="<u4")
        out = bytearray()
        for m in self.cuts(marked):
            out += self.parts[m[0]]
        return np.frombuffer(out, dtype="<u4")

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_MADE: dict[tuple[str, int], PieceBpe] = {}


def encoder(model_file: str, room: int = ROOM) -> PieceBpe:
    """One encoder per model and Python process, so that its store, of bounded size, outlives a task."""
    if (model_file, room) not in _MADE:
        _MADE.clear()
        _MADE[model_file, room] = PieceBpe(model_file, room)
    return _MADE[model_file, room]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, room: int = ROOM) -> DataFrame:
    """_id, _n_tokens, _ids_sha256, _decoded_sha256 of every row, the end id included; on request also _ids and _decoded.

    A null or empty text has the end id alone. Texts of any length are encoded whole, in time that grows with it, repeated rows alike; other columns aren't looked at and an
    empty table gives an empty result. model_file must be readable at the same path on every executor."""
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType
    id_type = arrow_type(kind)
    out = T.StructType([T.StructField("_id", kind), T.StructField("_n_tokens", T.LongType()), T.StructField("_ids_sha256", T.StringType()), T.StructField("_decoded_sha256", T.StringType())])
    out = out.add("_ids", T.ArrayType(T.IntegerType())) if ids else out
    out = out.add("_decoded", T.StringType()) if decoded else out

    def run(batches):
        bpe = encoder(model_file, room)
        names = np.array([str(k) for k in range(bpe.sp.get_piece_size())], dtype=object)
        for b in slices(batches, 8 << 20):
            coded, texts = [], []
            for text in b.column(1).to_pylist():
                coded.append(np.append(bpe.encode(text), np.uint32(bpe.eos)))
                texts.append(bpe.decode(coded[-1].tolist()))
            digests = [hashlib.sha256(" ".join(names[c].tolist()).encode()).hexdigest() for c in coded]
            made = [pa.array([len(c) for c in coded], pa.int64()), pa.array(digests, pa.string()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())]
            made += [pa.array([c.astype(np.int32) for c in coded], pa.list_(pa.int32()))] if ids else []
            made += [pa.array(texts, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), *made], names=out.names)

    return rows.mapInArrow(run, out)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ids=False, decoded=False)
    return got.select(F.col("_id").alias("doc_id"), F.col("_n_tokens").alias("n_tokens"), F.col("_ids_sha256").alias("ids_sha256"), F.col("_decoded_sha256").alias("decoded_sha256"))
