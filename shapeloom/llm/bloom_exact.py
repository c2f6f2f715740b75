"""Exact dedup in two passes, the second a Bloom filter, with DataFrame functions only.

Pass one isn't a Bloom filter: it counts the rows of each 44-bit hash of the normalised text, exactly, so that it shuffles a hash for every
row (tasks count first; about 8 bytes a row, nothing of the text). A filter of bits that are set twice can't be made of DataFrame functions where
the rows are: two tasks that set the same bit can only be told by its count, not by the union of their filters, and the union is
all that there are aggregates for. Pass two puts the hashes of two rows or more, as many as there are repeated texts, into a Bloom filter and
tests every row against it: a row that isn't in it is unique and goes straight to the result, and only the others, which are possibly
repeated, are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, replace_spaces

HASHES = 2
#: Bits of the dealt table: unique rows that share a place are one in 2**44 / rows, whatever the memory.
TABLE_LOG2 = 44
#: The filter is broadcast, so its size is bound: 2**30 bits are 128 MB, for 2**26 repeated texts at 16 bits each. Beyond, it lets
#: more unique rows through to the shuffle, which costs time and never changes a result.
MAX_BITS_LOG2 = 30
BUCKET_BITS = 32768  # of Spark's bitmap functions


def normal_text(text) -> F.Column:
    return replace_spaces(F.coalesce(text.cast("string"), F.lit("")))


def _place(text):
    return F.xxhash64(text).bitwiseAND((1 << TABLE_LOG2) - 1)


def _bits(bits: int):
    return [F.pmod(F.xxhash64("_place", F.lit(k)), F.lit(bits)) for k in range(HASHES)]


def repeated_filter(rows: DataFrame, max_bits_log2: int = MAX_BITS_LOG2) -> tuple[DataFrame, int]:
    """Bitmaps (bucket, bitmap) of a Bloom filter of the places (column _place) that two rows or more reach, and its number of bits."""
    places = materialize(rows.groupBy("_place").count().filter("count > 1").select("_place"), "exact-places")
    bits = 1 << min(max(16 * places.count() - 1, BUCKET_BITS).bit_length(), max_bits_log2)
    slots = places.select(F.explode(F.array(*_bits(bits))).alias("_slot"))
    one = F.col("_slot") + 1  # Spark numbers bitmaps from one
    made = slots.groupBy(F.bitmap_bucket_number(one).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("_bits"))
    made = materialize(made, "exact-filter")
    release(places)
    return made, bits


def possibly_repeated(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """rows with a boolean _possible: every bit of the row's _place is in the filter."""
    verdict = F.lit(True)
    for k, slot in enumerate(_bits(bits)):
        side = F.broadcast(bitmaps.select(F.col("_bucket").alias(f"_bucket{k}"), F.col("_bits").alias(f"_bits{k}")))  # at most 2**max_bits_log2 / 8 bytes
        rows = rows.withColumn(f"_slot{k}", slot).withColumn(f"_bucket{k}", F.bitmap_bucket_number(F.col(f"_slot{k}") + 1)).join(side, f"_bucket{k}", "left")
        at = F.pmod(F.col(f"_slot{k}"), F.lit(BUCKET_BITS))
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{k}"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        verdict = verdict & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_possible", verdict).drop(*[f"{p}{k}" for k in range(HASHES) for p in ("_slot", "_bucket", "_bits")])


def _read(docs: DataFrame, id_col: str, text_col: str) -> dict:
    normal = normal_text(docs[text_col])
    length = F.char_length(F.coalesce(docs[text_col].cast("string"), F.lit(""))).cast("long")
    return {"_id": docs[id_col], "_digest": F.sha2(normal, 256), "_len": length, "_place": _place(normal)}


def _groups(narrow: DataFrame, bitmaps: DataFrame, bits: int, *tag: str) -> DataFrame:
    """_digest, _group_size and _best of the texts that are repeated. Rows are put together before their shuffle, so a group of any
    size is a row for each task here."""
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), *tag))
    some = possibly_repeated(narrow, bitmaps, bits).filter("_possible")
    return materialize(some.groupBy("_digest").agg(F.count("*").alias("_group_size"), best.alias("_best")).filter("_group_size > 1"), "exact-groups")


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits_log2: int = MAX_BITS_LOG2) -> DataFrame:
    """One row per row of docs: _id, _digest (SHA-256, hex, of the text without white space), _keep_id, _group_size, _kept.

    Of rows with equal normalised texts the longest original text stays, then the smallest id (null ids come last). A null text
    is empty. Rows that repeat an id and its text are told apart only by chance; exactly one of a group is marked kept. Texts of any
    length are hashed whole. Other columns of docs aren't looked at; an empty table gives an empty result."""
    own = _read(docs, id_col, text_col)
    narrow = materialize(docs.select(*[c.alias(n) for n, c in own.items()]).withColumn("_tag", F.monotonically_increasing_id()), "exact-narrow")
    bitmaps, bits = repeated_filter(narrow, max_bits_log2)
    groups = _groups(narrow, bitmaps, bits, "_tag")
    tested = possibly_repeated(narrow, bitmaps, bits)
    straight = tested.filter("not _possible").select("_id", "_digest", F.col("_id").alias("_keep_id"), F.lit(1).cast("long").alias("_group_size"), F.lit(True).alias("_kept"))
    joined = tested.filter("_possible").join(groups, "_digest", "left")
    single = F.col("_group_size").isNull()
    rest = joined.select("_id", "_digest", F.when(single, F.col("_id")).otherwise(F.col("_best.i")).alias("_keep_id"), F.coalesce("_group_size", F.lit(1).cast("long")).alias("_group_size"), (single | (F.col("_tag") == F.col("_best._tag"))).alias("_kept"))
    return straight.unionByName(rest)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits_log2: int = MAX_BITS_LOG2) -> DataFrame:
    """The rows of docs that stay by the rule of mark_exact, with all their columns of whatever names. Whole rows are shuffled only if
    their text is possibly repeated; of rows that repeat the id and text of the one that stays, one does."""
    own = _read(docs, id_col, text_col)
    narrow = materialize(docs.select(*[c.alias(n) for n, c in own.items()]), "exact-narrow")
    bitmaps, bits = repeated_filter(narrow, max_bits_log2)
    groups = _groups(narrow, bitmaps, bits)
    release(narrow)
    straight = possibly_repeated(docs.select(F.struct("*").alias("_row"), own["_place"].alias("_place")), bitmaps, bits).filter("not _possible").select("_row.*")
    whole = possibly_repeated(docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in own.items()]), bitmaps, bits).filter("_possible")
    wins = F.col("_group_size").isNull() | F.col("_id").eqNullSafe(F.col("_best.i")) & (-F.col("_len") == F.col("_best.l"))
    return straight.union(whole.join(groups, "_digest", "left").filter(wins).dropDuplicates(["_digest"]).select("_row.*"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    rows = mark_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
