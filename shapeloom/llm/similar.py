"""Near-dedup at a stated Jaccard similarity of word shingles: wide SimHash fingerprints, blocks, verified Hamming distance, components.

The SimHash step is op1's: 64-bit fingerprints, blocks of their bits, at most 2 bits apart, components. But at a similarity of 0.8 two
SimHashes differ in 15 of 100 bits, so any block of their bits long enough to be selective at billions of
documents is missed by nearly all such pairs. So min-wise blocks bring the other pairs: BANDS groups of the least values of the shingles'
hashes, each group shared by close texts with probability similarity ** BAND. Texts that meet in a block are compared by their sizes and, if large,
by the Hamming distance of WORDS * 64 SimHash bits with a wide allowance; what passes is decided by the exact similarity of the sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import arrow_type, id_and_text, materialize, release, scratch, slices
from .components import connected_components

SEED = 42
WORDS, BANDS, BAND = 16, 12, 4
BUCKET, TURNS, LOT = 16, 3, 512
SMALL, DEVIATIONS = 64, 8  # sets of fewer shingles are compared without fingerprints, as ties bias their bits
#: A list of text digests of at most so many rows (about 100 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 250_000
_ODD = np.array([[xxhash.xxh64_intdigest(str(k), 1) | 1] for k in range(BANDS * BAND)], dtype=np.uint64)
_MIX = np.array([[xxhash.xxh64_intdigest(str(k), 2)] for k in range(WORDS)], dtype=np.uint64)
_STEP = 2048


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The different XXH64 of a text's word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    runs = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else iter([words])
    parts = []
    while part := [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, itertools.islice(runs, 1 << 16))]:
        parts.append(np.array(part, dtype=np.uint64))
    return np.unique(np.concatenate(parts))


def marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wide SimHash and the block keys of a set of hashes, both as signed longs."""
    least, ones = np.full(len(_ODD), ~np.uint64(0)), np.zeros((WORDS, 64), dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        s = hashes[at : at + _STEP]
        np.minimum(least, (s * _ODD).min(axis=1), out=least)
        h = (s ^ _MIX) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8).reshape(WORDS, len(s), 8), axis=2, bitorder="little").sum(axis=1, dtype=np.uint16)
    sig = np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()
    keys = np.array([xxhash.xxh64_intdigest(least[b * BAND : (b + 1) * BAND].tobytes(), b) for b in range(BANDS)], dtype=np.uint64)
    return sig.view(np.int64), keys.view(np.int64)


def most_bits(similarity: float, deviations: float = 2) -> int:
    """Bits in which the fingerprints of two sets of that similarity differ at most, with an allowance of so many standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * WORDS * p + deviations * math.sqrt(64 * WORDS * p * (1 - p)))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """_id, _as (a digest of the text), _node (a digest of the shingle set), _n (its size), _sig and _keys of every row."""
    rows = id_and_text(docs, id_col, text_col).withColumn("_as", F.md5("_text"))
    kind, longs = rows.schema["_id"].dataType, T.ArrayType(T.LongType())
    out = T.StructType([T.StructField("_id", kind), T.StructField("_as", T.StringType()), T.StructField("_node", T.StringType()), T.StructField("_n", T.LongType()), T.StructField("_sig", longs), T.StructField("_keys", longs)])
    id_type = arrow_type(kind)

    def run(batches):
        for b in slices(batches, 4 << 20):
            nodes, sizes, sigs, keys = [], [], [], []
            for t in b.column(1):
                s = shingle_hashes(t.as_py(), shingle)
                sig, key = marks(s)
                nodes.append(hashlib.md5(s.tobytes()).hexdigest())
                sizes.append(len(s)), sigs.append(sig), keys.append(key)
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (sigs, keys)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), b.column(2), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), *lists], names=out.names)

    return rows.mapInArrow(run, out)


def shingle_sets(docs: DataFrame, named: DataFrame, text_col: str = "text", shingle: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """_node and _set (its hashes) of the nodes of `named`: _node and _as, the digest of a text that has this set.

    Only these texts are hashed again, each once; copies are put together before their shuffle."""
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text")).select(F.md5("_text").alias("_as"), "_text")
    few = named.select("_as")
    few = texts.join(F.broadcast(few) if named.count() <= broadcast_rows else few, "_as", "left_semi")
    one = few.groupBy("_as").agg(F.first("_text").alias("_text")).join(named, "_as").select("_node", "_text")

    def run(batches):
        for b in slices(batches, 4 << 20):
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_node", "_set"])

    return materialize(one.mapInArrow(run, "_node string, _set array<long>"), "similar-sets")


def _apart(a: str, b: str):
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(WORDS)), F.lit(0))


def _may(similarity: float, a: str, b: str):
    """Whether sets (size and fingerprint in columns of these prefixes) may be that similar; false for no pair that is, but by a chance of 1e-15."""
    small, large = F.least(a + "_n", b + "_n"), F.greatest(a + "_n", b + "_n")
    return (small / large >= similarity) & ((small < SMALL) | (_apart(a + "_sig", b + "_sig") <= most_bits(similarity, DEVIATIONS)))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The different u, v of pairs whose sets (_node, _set) have at least that similarity."""
    a, b = (sets.select(F.col("_node").alias(x), F.col("_set").alias(f"s{x}")) for x in "uv")
    both = pairs.select("u", "v").distinct().join(a, "u").join(b, "v").withColumn("_both", F.size(F.array_intersect("su", "sv")))
    right = both.filter(F.col("_both") / (F.size("su") + F.size("sv") - F.col("_both")) >= similarity).select("u", "v")
    return materialize(right, "similar-verified")


def _sets_of(sets, nodes: DataFrame) -> DataFrame:
    """_node and _set of some nodes, once each; sets: a table of them with repeats, or a function that makes them."""
    nodes = materialize(nodes.distinct(), "similar-wanted")
    got = sets(nodes) if callable(sets) else materialize(sets.join(nodes, "_node", "left_semi").groupBy("_node").agg(F.first("_set").alias("_set")), "similar-sets")
    release(nodes)
    return got


def _rare(members: DataFrame, sets: DataFrame, most: int = BUCKET) -> DataFrame:
    """_node and h: the shingles of members' sets that at most `most` of these nodes have.

    The frequent shingles, no more than a `most`-th of all, are taken away by shingle and salt, so none of them is one task."""
    tokens = sets.join(members.select("_node").distinct(), "_node", "left_semi").select("_node", F.explode("_set").alias("h"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_salt")
    frequent = tokens.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("h", salts)
    salted = tokens.withColumn("_salt", F.pmod(F.xxhash64("_node"), F.lit(most)).cast("int"))
    return materialize(salted.join(frequent, ["h", "_salt"], "left_anti").select("_node", "h"), "similar-rare")


def _stars(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: links of members of crowded blocks with leaders of theirs: TURNS times one of those of a block that no leader has met yet.

    The leader is the node with the smallest share of rare shingles, as that of a group from which its other texts were made, then one drawn by
    hash. The choice is by node, so blocks that hold the same texts compare the same pairs."""
    open_, found = members, None
    for turn in range(TURNS):
        leaders = open_.groupBy("k").agg(F.min(F.struct(1 - F.col("_shared") / F.col("_n"), F.xxhash64("_node", F.lit(turn)), "_node", "_n", "_sig")).alias("l"))
        leaders = materialize(leaders.select("k", *[F.col(f"l.{c}").alias("v" + c) for c in ("_node", "_n", "_sig")]), "similar-leaders")
        own = members.select("k", *[F.col(c).alias("u" + c) for c in ("_node", "_n", "_sig")])
        near = own.join(leaders, "k").filter((F.col("u_node") != F.col("v_node")) & _may(similarity, "u", "v"))
        near = materialize(near.select("k", F.col("u_node").alias("u"), F.col("v_node").alias("v")), "similar-near")
        links = _verified(near, sets, similarity)
        done = near.join(links, ["u", "v"]).select("k", F.col("u").alias("_node")).union(leaders.select("k", F.col("v_node").alias("_node")))
        last, open_ = open_, materialize(open_.join(done, ["k", "_node"], "left_anti"), "similar-open")
        release(leaders, near, *([last] if turn else []))
        found = links if found is None else found.union(links)
    release(open_)
    return found


def _rest(members: DataFrame, found: DataFrame, rare: DataFrame, similarity: float) -> DataFrame:
    """u, v: all pairs of members of a block that the links found don't connect already and that may be that similar.

    Pairs with a rare shingle in common meet at it. All others have no more in common than the smaller number of frequent shingles (_shared),
    which leaves few of them: those outside a block's largest component meet all of the block that this bound and the fingerprints
    allow, dealt over squares of at most about LOT by LOT, each a group of its own."""
    roots = connected_components(found)
    at = members.join(roots, members["_node"] == roots["node"], "left").select(*members.columns, F.coalesce("root", "_node").alias("_root"))
    at = materialize(at, "similar-rooted")
    by_rare = rare.join(at.select("_node", "_n", "_root").distinct(), "_node")
    u, v = (by_rare.select("h", *[F.col(c).alias(side + c) for c in ("_node", "_n", "_root")]) for side in "uv")
    sizes = F.least("u_n", "v_n") / F.greatest("u_n", "v_n") >= similarity
    met_rare = u.join(v, "h").filter((F.col("u_root") != F.col("v_root")) & (F.col("u_node") > F.col("v_node")) & sizes)
    at = at.filter(F.col("_shared") >= similarity * F.col("_n") - 1e-6)  # the others are similar to none by frequent shingles alone
    most = at.groupBy("k", "_root").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", "_root")).alias("m"), F.sum("c").alias("n")).filter("n > m.c")
    most = most.select("k", F.col("m._root").alias("_main"), F.ceil((F.col("n") - F.col("m.c")) / LOT).alias("_rows"), F.ceil(F.col("n") / LOT).alias("_cols"))
    at = materialize(at.join(most, "k"), "similar-rest")
    lot = F.xxhash64("_node", F.lit(TURNS))
    few = at.filter("_root <> _main").withColumns({"_i": F.pmod(lot, F.col("_rows")), "_j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cols") - 1))})
    all_ = at.withColumns({"_j": F.pmod(lot, F.col("_cols")), "_i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1))})
    own = [c for c in (*members.columns, "_root") if c != "k"]
    few, all_ = few.select("k", "_i", "_j", "_main", *[F.col(c).alias("u" + c) for c in own]), all_.select("k", "_i", "_j", *[F.col(c).alias("v" + c) for c in own])
    enough = F.least("u_shared", "v_shared") * (1 + similarity) >= similarity * (F.col("u_n") + F.col("v_n")) - 1e-6
    met = few.join(all_, ["k", "_i", "_j"]).filter((F.col("u_root") != F.col("v_root")) & ((F.col("v_root") == F.col("_main")) | (F.col("u_node") > F.col("v_node"))))
    met = met.filter(enough & _may(similarity, "u", "v"))
    return met.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).union(met_rare.select("u_node", "v_node"))


def fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """u, v: nodes that SimHash itself links, as op1 does: 64-bit fingerprints (the first word of _sig) that meet in blocks of their bits and
    differ in at most 2; of nodes with one fingerprint, each with the first. Pairs that can't be that similar are left out."""
    own = nodes.select("_node", "_n", "_sig", F.col("_sig")[0].alias("_fp"))
    first = materialize(own.groupBy("_fp").agg(F.min(F.struct("_node", "_n", "_sig")).alias("_f")).select("_fp", "_f.*"), "similar-fingerprints")
    a, b, c = (t.select(*[F.col(x).alias(side + x) for x in ("_fp", "_node", "_n", "_sig")]) for t, side in ((first, "u"), (first, "v"), (own, "u")))
    apart = simhash.links(first.select("_fp")).distinct().join(a, F.col("u") == F.col("u_fp")).join(b, F.col("v") == F.col("v_fp")).drop("u", "v")
    same = c.join(b, F.col("u_fp") == F.col("v_fp")).filter(F.col("u_node") != F.col("v_node"))
    met = apart.unionByName(same).filter(_may(similarity, "u", "v"))
    return met.select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v"))


def similar_links(nodes: DataFrame, sets: DataFrame, similarity: float, bucket: int = BUCKET) -> DataFrame:
    """nodes: distinct _node with _n, _sig and _keys; sets: _node and _set, repeats allowed. Returns u, v: verified links that connect all
    nodes which links in blocks connect.

    Candidates are the pairs that SimHash links and those that share a min-wise block, where its blocks miss them; all are verified by the
    exact similarity. A block of at most `bucket` nodes is joined with itself. In a larger one all are compared with a few leaders first; then every pair
    that the links so far leave in different components and that may be similar by the shingles that few of these nodes have is compared
    too, so a large group of close texts costs linear work, and no pair is lost whatever the size of its block."""
    rows = materialize(nodes.select("_node", F.explode("_keys").alias("k")), "similar-blocks")
    counts = materialize(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "similar-counts")
    met = materialize(rows.join(counts, "k").join(nodes.select("_node", "_n", "_sig"), "_node"), "similar-met")
    release(rows, counts)
    cold = met.filter(F.col("n") <= bucket)
    a, b = (cold.select("k", *[F.col(c).alias(side + c) for c in ("_node", "_n", "_sig")]) for side in "uv")
    near = a.join(b, "k").filter((F.col("u_node") > F.col("v_node")) & _may(similarity, "u", "v"))
    near = near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).union(fingerprint_pairs(nodes, similarity))
    near = materialize(near.distinct(), "similar-cold")
    members = materialize(met.filter(F.col("n") > bucket).select("k", "_node", "_n", "_sig"), "similar-members")
    release(met)
    own = _sets_of(sets, near.select(F.col("u").alias("_node")).union(near.select(F.col("v").alias("_node"))).union(members.select("_node")))
    found = _verified(near, own, similarity)
    release(near)
    if not members.isEmpty():
        rare, plain = _rare(members, own, bucket), members
        counts = rare.groupBy("_node").agg(F.count("*").alias("_c"))
        members = materialize(plain.join(counts, "_node", "left").select(*plain.columns, (F.col("_n") - F.coalesce("_c", F.lit(0))).alias("_shared")), "similar-members")
        release(plain)
        stars = materialize(found.union(_stars(members, own, similarity)).distinct(), "similar-found")
        found = stars.union(_verified(_rest(members, stars, rare, similarity), own, similarity))
        release(rare)
    release(own, members)
    return found


def _tops(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """_id, _as and _top of every row; _top holds _id and _as of the first of its group: the smallest id, nulls last, then the smallest digest."""
    with scratch() as made:
        rows = materialize(marked(docs, id_col, text_col, shingle), "similar-marks")
        first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_as"))
        least = materialize(rows.groupBy("_node").agg(first.alias("_least"), F.min("_as").alias("_text_as"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"), F.first("_keys").alias("_keys")), "similar-nodes")

        def sets(nodes: DataFrame) -> DataFrame:
            named = materialize(least.join(nodes, "_node", "left_semi").select("_node", F.col("_text_as").alias("_as")), "similar-named")
            return shingle_sets(docs, named, text_col, shingle)

        roots = connected_components(similar_links(least, sets, similarity, bucket))
        named = least.join(roots, least["_node"] == roots["node"], "left").select("_node", "_least", F.coalesce("root", "_node").alias("_root"))
        named = materialize(named, "similar-roots")
        tops = named.groupBy("_root").agg(F.min("_least").alias("_top"))
        of = materialize(named.join(tops, "_root").select("_node", "_top"), "similar-named")
        return made.keep(materialize(rows.select("_id", "_as", "_node").join(of, "_node").select("_id", "_as", "_top"), "similar-tops"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """_id and _component of every row; _component is the smallest id that links of at least that similarity reach.

    Texts with equal shingle sets share a node, so copies are never paired. Null, empty and white texts have one empty shingle and
    are alike. Null ids never name a component unless all ids of it are null. An empty table gives an empty result."""
    return _tops(docs, id_col, text_col, **how).select("_id", F.col("_top._id").alias("_component"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group, the first by id (nulls last) and digest of the text.

    Ids with digests are joined, so null and repeated ids are kept apart by their texts; rows that share both stay together."""
    g = _tops(docs, id_col, text_col, **how)
    stays = F.col("_id").eqNullSafe(F.col("_top._id")) & (F.col("_as") == F.col("_top._as"))
    gone = materialize(g.filter(~stays).select("_id", "_as").distinct(), "similar-gone")
    release(g)
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("id"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("as"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, rows["id"].eqNullSafe(gone["_id"]) & (rows["as"] == gone["_as"]), "left_anti").select("row.*")
