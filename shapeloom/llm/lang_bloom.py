"""Language ID with bit-sliced Bloom filters over character n-grams.

A table of `slots` words holds one bit per language: a language's n-grams set its bit at `HASHES` slots each, so one lookup, the AND
of a few words, returns all languages that contain an n-gram. A document's n-grams are looked up at once with numpy; each language's
popcount is corrected for the false positives that its filter's fill predicts, and the largest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UND = "und"
SIZES = (3, 4)  # of n-grams, in UTF-8 bytes of lower-case letters with single spaces between words
HASHES = 3
SLOTS_LOG2 = 20
_NO_LETTER = re.compile(r"[\W\d_]+")
#: Bytes of letters whose n-grams are looked up at once: what a lookup holds is about 60 times as much, for any text and batch.
PIECE = 1 << 16
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _letters(text: str) -> bytes:
    """Lower-case letters, every run of anything else one space; a space at both ends."""
    return b" " + _NO_LETTER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") + b" "


def _grams(buf: np.ndarray, size: int) -> np.ndarray:
    """The n-grams of a byte array as numbers below 2**40, with their size in the top byte."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        g = (g << np.uint64(8)) | buf[k : k + n]
    return g | np.uint64(size << 32)


@dataclass
class LanguageFilter:
    langs: list[str]
    planes: np.ndarray  # uint64 words of language bits, (planes, slots)
    false_rate: np.ndarray  # by language

    def _slots(self, grams: np.ndarray):
        h = grams * _STEP[0]
        h ^= h >> np.uint64(29)
        h *= _STEP[1]
        low, high, mask = h >> np.uint64(32), h | np.uint64(1), np.uint64(self.planes.shape[1] - 1)
        for k in range(HASHES):
            yield ((low + np.uint64(k) * high) >> np.uint64(5)) & mask

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that contain it (by plane)."""
        out = np.full((len(self.planes), len(grams)), ~np.uint64(0))
        for s in self._slots(grams):
            out &= self.planes[:, s.astype(np.intp)]
        return out

    @classmethod
    def fit(cls, grams_by_lang: dict[str, tuple[np.ndarray, np.ndarray]], slots_log2: int = SLOTS_LOG2, least: int = 2, share: float = 0.25) -> LanguageFilter:
        """grams_by_lang: different n-grams and their counts. A language contains an n-gram seen `least` times in it, at a rate of at
        least `share` of the highest rate in any language."""
        langs = sorted(grams_by_lang)
        self = cls(langs, np.zeros(((len(langs) + 63) // 64 or 1, 1 << slots_log2), dtype=np.uint64), np.zeros(len(langs)))
        if not langs:
            return self
        rates = [grams_by_lang[lang][1] / max(1, int(grams_by_lang[lang][1].sum())) for lang in langs]
        grams, at = np.unique(np.concatenate([grams_by_lang[lang][0] for lang in langs]), return_inverse=True)
        top = np.zeros(len(grams))
        np.maximum.at(top, at, np.concatenate(rates))
        end = 0
        for k, lang in enumerate(langs):
            own, n = grams_by_lang[lang]
            begin, end = end, end + len(own)
            for s in self._slots(own[(n >= least) & (rates[k] >= share * top[at[begin:end]])]):
                self.planes[k // 64][s.astype(np.intp)] |= np.uint64(1 << k % 64)
        for k in range(len(langs)):
            fill = float(np.mean((self.planes[k // 64] >> np.uint64(k % 64)) & np.uint64(1)))
            self.false_rate[k] = fill**HASHES
        return self

    def _count(self, pieces: list[tuple[int, int, bytes, int]], hits: np.ndarray, seen: np.ndarray) -> None:
        """Adds the n-grams of pieces (text, letters before, bytes, letters of the whole text), of each PIECE starts at most."""
        buf = np.frombuffer(b"".join([p[2] for p in pieces]), dtype=np.uint8)
        of, ahead, whole = (np.array([p[k] for p in pieces]) for k in (0, 1, 3))
        ends = np.cumsum([len(p[2]) for p in pieces])
        starts = ends - [len(p[2]) for p in pieces]
        for size in SIZES:
            own = np.clip(whole - size + 1 - ahead, 0, PIECE)
            np.add.at(seen, of, own)
            found = self.masks(_grams(buf, size))
            last = found.shape[1]
            a, z = np.minimum(starts, last), np.minimum(starts + own, last)
            for k in range(len(self.langs)):
                run = np.zeros(last + 1, dtype=np.int32)
                np.cumsum((found[k // 64] >> np.uint64(k % 64)).astype(np.uint8) & 1, out=run[1:])
                np.add.at(hits[k], of, run[z] - run[a])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (the winner's share of all corrected counts) of each text."""
        has = np.zeros(len(texts), dtype=bool)
        hits, seen = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts))
        pieces, size = [], 0
        for i, t in enumerate(texts):
            letters = _letters(t) if t else b"  "
            has[i] = len(letters) > 2
            for at in range(0, len(letters), PIECE):
                pieces.append((i, at, letters[at : at + PIECE + SIZES[-1] - 1], len(letters)))
                size += len(pieces[-1][2])
                if size >= PIECE:
                    self._count(pieces, hits, seen)
                    pieces, size = [], 0
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        if pieces:
            self._count(pieces, hits, seen)
        f = self.false_rate[:, None]
        right = np.maximum(0.0, (hits - seen * f) / np.maximum(1 - f, 1e-9))
        best, whole = right.argmax(axis=0), right.sum(axis=0)
        score = np.where(has & (whole > 0), right.max(axis=0) / np.maximum(whole, 1e-12), 0.0)
        return [self.langs[b] if ok else UND for b, ok in zip(best, has)], np.clip(score, 0.0, 1.0)


def in_fold(doc_id, fold: int = 1, folds: int = 3):
    """Whether crc32 of the id as text leaves that remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_lang: int = 400) -> LanguageFilter:
    """Fit on a bounded sample: of the documents outside the held-out fold that have a text and a language, the `most_per_lang` of each
    language that come first in a hash of id and text. Every language is learned. Texts are counted where they are, whole; the
    driver gets the different n-grams of each language. A table without usable rows gives a filter without languages."""
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), docs[lang_col].alias("_lang")).filter("_text is not null and _lang is not null").filter(~in_fold(F.col("_id")))
    # only about as many rows as are wanted go on to the ranking, at any size: those under a bound of the hash that leaves eight standard deviations
    sizes = own.groupBy("_lang").agg(F.count("*").alias("_all"))
    draw = F.xxhash64("_id", "_text", F.lit(5))
    place = (draw.cast("double") + 2.0**63) / 2.0**64
    own = own.join(F.broadcast(sizes), "_lang").withColumn("_under", place * F.col("_all") <= most_per_lang + 8 * most_per_lang**0.5)  # a row per language
    # where rows are repeated the bound may leave too few; all of such a language are ranked
    short = own.groupBy("_lang").agg(F.count_if("_under").alias("_got"), F.max("_all").alias("_of")).filter(F.col("_got") < F.least("_of", F.lit(most_per_lang))).select("_lang", F.lit(True).alias("_short"))
    own = own.join(F.broadcast(short), "_lang", "left").filter(F.col("_under") | F.col("_short").isNotNull()).drop("_all", "_under", "_short")
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(draw, "_id", F.xxhash64("_text")))
    drawn = own.select("_lang", "_id", F.xxhash64("_text").alias("_t"), "_text").withColumn("_n", rank).filter(F.col("_n") <= most_per_lang).select("_lang", "_text")

    def count(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                buf = np.frombuffer(_letters(text.as_py()), dtype=np.uint8)
                for size in SIZES:
                    keep, n = np.unique(_grams(buf, size), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keep), pa.string()), pa.array(keep.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    found = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    langs = found.column("lang").to_numpy()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    seen = [r[0] for r in sizes.select("_lang").collect()]
    order = np.argsort(grams, kind="stable")
    langs, grams, n = langs[order], grams[order], n[order]
    return LanguageFilter.fit({lang: (grams[at], n[at]) for lang in seen for at in [langs == lang]})


def judged(spark, text, model: LanguageFilter):
    """A column of lang (a learned language, or 'und' for a null text or one without letters) and score in [0, 1]; only the text goes to Python."""
    held = spark.sparkContext.broadcast(model)  # its size is fixed by slots and the number of languages

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            langs, scores = [], []
            step = max(1, min(len(whole), int(len(whole) * (1 << 20) / max(whole.nbytes, 1)) or 1))
            for k in range(0, len(whole), step):
                lang, score = held.value.predict(whole.slice(k, step).to_pylist())
                langs += lang
                scores += score.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return F.arrow_udf(run, "struct<lang:string,score:double>")(F.coalesce(text.cast("string"), F.lit("")))


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, _lang (a learned language, or 'und' for a null text or one without letters), _score in [0, 1], and carry, for every row.

    Each row is judged by its whole text alone, so repeated rows agree; a text with letters but no known n-gram gets a learned
    language with score 0, and ties go to the language that sorts first. Without a learned language everything is 'und'. Of a text of
    any length, letters are held once and n-grams in pieces. An empty table gives an empty result; no other column is looked at."""
    rows = docs.select(docs[id_col].alias("_id"), judged(docs.sparkSession, docs[text_col], model).alias("_v"), F.struct(*[docs[c] for c in carry]).alias("_c")) if carry else docs.select(docs[id_col].alias("_id"), judged(docs.sparkSession, docs[text_col], model).alias("_v"))
    return rows.select("_id", F.col("_v.lang").alias("_lang"), F.col("_v.score").alias("_score"), *[F.col("_c")[c].alias(c) for c in carry])


def keep_known(docs: DataFrame, model: LanguageFilter, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns of whatever names, whose text has a learned language with a score of at least `least`."""
    rows = docs.select(F.struct("*").alias("row"), judged(docs.sparkSession, docs[text_col], model).alias("v"))
    return rows.filter((F.col("v.lang") != UND) & (F.col("v.score") >= least)).select("row.*")


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = identify(docs, train(docs))
    return got.select(F.col("_id").alias("doc_id"), in_fold(F.col("_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
