"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links and their components.

A 64-bit fingerprint is split into `blocks` blocks. Two fingerprints that differ in at most d bits agree on at least blocks - d of
them, so for every choice of blocks - d blocks the fingerprints are joined on these blocks and their Hamming distance is verified.
Equal fingerprints are one row before any join. A block bucket of more than `bucket` different fingerprints isn't joined (its
pairs would grow with the square); its members are linked exactly through the points within d/2 bits of them: fingerprints at
most 2 bits apart share such a point, and all that share a point are at most 2 bits apart, so a star per point loses no link.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, id_and_text, materialize, slices
from .components import connected_components

SEED = 42
BLOCKS = 5
BUCKET = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes, repeats counted; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    runs = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    while part := [digest(s, SEED) for s in map(b" ".join, itertools.islice(runs, 1 << 16) if not isinstance(runs, list) else runs)]:
        ones += np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if isinstance(runs, list):
            break
    return int(np.packbits((ones * 2 > n).view(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """_id and _fp (the fingerprint as a signed long) of every row; a null text has fingerprint 0."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType
    out = T.StructType([T.StructField("_id", kind), T.StructField("_fp", T.LongType())])
    id_type = arrow_type(kind)

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(fps)], names=["_id", "_fp"])

    return rows.mapInArrow(run, out)


def block_masks(distance: int = 2, blocks: int = BLOCKS) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks that two close fingerprints may share."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 2, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """fps: distinct _fp. Returns u, v: links between fingerprints at most `distance` bits apart (0, 1 or 2) that keep them connected;
    all of them from buckets that are joined, a star for each shared point from the rest."""
    if distance not in (0, 1, 2) or blocks <= distance:
        raise ValueError("distance must be 0, 1 or 2, and less than the number of blocks")
    if distance == 0:
        return fps.select(F.col("_fp").alias("u"), F.col("_fp").alias("v")).limit(0)
    keys = F.array(*[F.struct(F.lit(k).alias("c"), F.col("_fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(block_masks(distance, blocks))])
    rows = materialize(fps.select("_fp", F.explode(keys).alias("_b")).select("_fp", "_b.c", "_b.k"), "simhash-blocks")
    counts = materialize(rows.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
    met = materialize(rows.join(counts, ["c", "k"]), "simhash-met")  # most blocks are alone in their bucket
    cold = met.filter(F.col("n") <= bucket)
    a, b = cold.select("c", "k", F.col("_fp").alias("u")), cold.select("c", "k", F.col("_fp").alias("v"))
    near = a.join(b, ["c", "k"]).filter((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v").distinct()
    hot = met.filter(F.col("n") > bucket).select("_fp").distinct()
    bit = [(1 << k) - (1 << 64 if k == 63 else 0) for k in range(64)]
    if distance == 2:
        points = F.array(F.struct(F.lit(64).alias("c"), F.col("_fp").alias("k")), *[F.struct(F.lit(64).alias("c"), F.col("_fp").bitwiseXOR(F.lit(m)).alias("k")) for m in bit])
    else:
        points = F.array(*[F.struct(F.lit(c).alias("c"), F.col("_fp").bitwiseAND(F.lit(~m)).alias("k")) for c, m in enumerate(bit)])
    around = hot.select("_fp", F.explode(points).alias("_p")).select("_fp", "_p.c", "_p.k")
    around = materialize(around, "simhash-points")
    stars = materialize(around.groupBy("c", "k").agg(F.min("_fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n"), "simhash-stars")
    star = around.join(stars, ["c", "k"]).filter("_fp <> v").select(F.col("_fp").alias("u"), "v")
    return near.union(star)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """_id, _fp and _component of every row; _component is the smallest id that links reach from its fingerprint.

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids get a component but never name one, unless
    all ids of it are null. Repeated rows share their component. An empty table gives an empty result."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    least = materialize(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-distinct")
    roots = connected_components(links(least.select("_fp"), distance, blocks, bucket))
    named = least.join(roots, least["_fp"] == roots["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    named = materialize(named, "simhash-roots")
    tops = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    of = materialize(named.join(tops, "_root").select("_fp", "_component"), "simhash-named")
    return rows.join(of, "_fp").select("_id", "_fp", "_component")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group, the first by id (nulls last) and digest of the text.

    Ids with digests are joined, so null and repeated ids are kept apart by their texts; rows that share both stay together."""
    text = F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    key = F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), text.alias("as"))
    g = near_groups(docs.select(key.alias("_key"), docs[text_col].alias("_words")), "_key", "_words", **how)
    gone = materialize(g.filter(~F.col("_id").eqNullSafe(F.col("_component"))).select(F.col("_id.id").alias("_id"), F.col("_id.as").alias("_as")).distinct(), "simhash-gone")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (text == gone["_as"]), "left_anti")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    g = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return g.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
