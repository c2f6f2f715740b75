import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from shapeloom.llm import similar


def _jaccard(a, b):
    a, b = set(similar.shingle_hashes(a).tolist()), set(similar.shingle_hashes(b).tolist())
    return len(a & b) / len(a | b)


def _texts():
    r, words = random.Random(3), [f"w{k}" for k in range(500)]
    texts = [" ".join(r.choices(words, k=r.randint(60, 300))) for _ in range(40)]
    for k in range(10):  # near copies: a few words changed
        w = texts[k].split()
        for _ in range(max(1, len(w) // 70)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    big = [f"b{k}" for k in range(120)]  # a group larger than a bucket
    texts += [" ".join(big[:-1] + [f"end{k}"]) for k in range(60)]
    return texts + [texts[0], texts[0].upper(), "", None, " \n", "one two", "One  two"]


def _brute(texts):
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if _jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in range(len(texts))}


def test_groups_agree_with_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, _node string")
    got = {r._id: r._component for r in similar.similar_groups(docs).collect()}
    want = _brute(texts)
    assert got == want
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert similar.similar_groups(docs.filter(F.lit(False))).count() == 0
    assert {(r._id, r._component) for r in similar.similar_groups(docs).collect()} == {(None, 4), (4, 4), (None, None)}


def test_distance_follows_the_similarity():
    r = np.random.default_rng(5)
    whole = r.integers(0, 1 << 63, 2200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for share, close in ((0.85, True), (0.6, False)):
        n = int(2000 * 2 * share / (1 + share))
        a, b = similar.marks(np.unique(whole[:2000]))[0], similar.marks(np.unique(np.concatenate([whole[:n], r.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)])))[0]
        assert (sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= similar.most_bits(0.8)) == close


def _bridged():
    """Eight chained clusters of 150 texts; only one pair of each two neighbours is over 0.8, others at 0.7 or less."""
    r, texts = random.Random(11), []
    base = [f"c{k}" for k in range(804)]
    for c in range(8):
        u, v = list(base), list(base)
        if c < 7:
            after = list(base)
            at = range(40 * c, 40 * c + 224)
            for k, p in enumerate(at):
                after[p] = f"d{c}_{p}"
                u[p] = after[p] if k < 72 else u[p]
                v[p] = after[p] if k < 148 else v[p]
        for k in range(150):
            w = list(base)
            w[r.randrange(800)] = f"own{c}_{k}"
            texts.append(" ".join(w))
        if c < 7:
            texts += [" ".join(u), " ".join(v)]
            base = after
    return texts


def _components(close):
    root = np.arange(len(close))
    while True:
        now = np.array([root[c].min() for c in close])
        if (now == root).all():
            return root.tolist()
        root = now


def test_bridges_in_a_crowded_block(spark):
    texts = _bridged()
    sets = [similar.shingle_hashes(t) for t in texts]
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    has, n = np.zeros((len(sets), len(words)), dtype=np.float32), np.array([len(s) for s in sets])
    has[np.repeat(np.arange(len(sets)), n), flat] = 1
    both = has @ has.T
    close = both / (n[:, None] + n[None, :] - both) >= 0.8
    names = [hashlib.md5(str(k).encode()).hexdigest() for k in range(len(texts))]
    at = {name: k for k, name in enumerate(names)}
    rows = [(name, len(s), similar.marks(s)[0].tolist(), [1], s.view(np.int64).tolist()) for name, s in zip(names, sets)]
    nodes = spark.createDataFrame(rows, "_node string, _n long, _sig array<long>, _keys array<long>, _set array<long>")
    mine = np.eye(len(texts), dtype=bool)
    for r in similar.similar_links(nodes, nodes, 0.8).collect():
        mine[at[r.u], at[r.v]] = mine[at[r.v], at[r.u]] = True
    assert len(texts) > 1000 and not (mine & ~close).any()
    assert _components(mine) == _components(close)


def _near_the_limit():
    """40 pairs of 8 words and the same with one word added (0.8 exactly), and 40 pairs of 300 shingles at 0.78."""
    texts = []
    for k in range(40):
        w = [f"s{k}_{j}" for j in range(9)]
        texts += [" ".join(w[:8]), " ".join(w)]
    for k in range(40):
        w = [f"l{k}_{j}" for j in range(304)]
        texts += [" ".join(w), " ".join(w[:267] + [f"m{k}_{j}" for j in range(37)])]
    return texts


def test_pairs_near_the_limit_are_decided_exactly(spark):
    texts = _near_the_limit()
    assert {round(_jaccard(*texts[k : k + 2]), 2) for k in range(0, 80, 2)} == {0.8} and {round(_jaccard(*texts[k : k + 2]), 2) for k in range(80, 160, 2)} == {0.78}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r._id: r._component for r in similar.similar_groups(docs).collect()}
    assert got == {k: k - k % 2 if k < 80 else k for k in range(160)}


def test_null_and_repeated_ids_keep_other_groups(spark):
    def text(name, last="end"):
        return " ".join([f"{name}{k}" for k in range(60)] + [last])

    rows = [(1, text("a")), (None, text("a", "x")), (None, text("b")), (None, text("c")), (None, text("c", "x")), (2, text("d")), (3, text("d", "x")), (3, text("e")), (4, text("f")), (4, text("f", "x"))]
    kept = [tuple(r) for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    first = {name: min((text(name), text(name, "x")), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for name in "cf"}
    assert set(kept) == {(1, text("a")), (None, text("b")), (None, first["c"]), (2, text("d")), (3, text("e")), (4, first["f"])} and len(kept) == 6


def test_rare_shingles_of_crowded_blocks(spark):
    """Rare shingles by plain counts; a pair that is alike by shingles that only these two have is found among those that others leave."""
    base = list(range(100))
    sets = {f"n{k}": base[:70] + list(range(1000 + 40 * k, 1040 + 40 * k)) for k in range(20)}
    sets["n20"], sets["n21"] = base[:30] + list(range(5000, 5080)), base[:30] + list(range(5000, 5079)) + [9]
    nodes = spark.createDataFrame([(k, v) for k, v in sets.items()], "_node string, _set array<long>")
    members = spark.createDataFrame([(b, k) for k in sets for b in (1, 2)], "k long, _node string")
    uses = {}
    for v in sets.values():
        for h in v:
            uses[h] = uses.get(h, 0) + 1
    want = sorted((k, h) for k, v in sets.items() for h in v if uses[h] <= 16)
    assert sorted(tuple(r) for r in similar._rare(members, nodes).collect()) == want
    full = [(k, len(v), similar.marks(np.array(v, dtype=np.uint64))[0].tolist(), [1], v) for k, v in sets.items()]
    rows = spark.createDataFrame(full, "_node string, _n long, _sig array<long>, _keys array<long>, _set array<long>")
    links = {frozenset((r.u, r.v)) for r in similar.similar_links(rows, rows, 0.8).collect()}
    assert links == {frozenset(("n20", "n21"))}


def test_simhash_links_without_min_wise_blocks(spark):
    """Close texts of a crowd meet by their 64-bit fingerprints alone; what SimHash links wrongly isn't verified."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(0, 400, 10)] + [" ".join(f"v{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with similar.scratch():
        rows = similar.materialize(similar.marked(docs), "test-marks")
        nodes = rows.select("_node", "_n", "_sig", F.array().cast("array<long>").alias("_keys"))
        sets = similar.shingle_sets(docs, rows.select("_node", "_as"))
        got = {(r.u, r.v) for r in similar.similar_links(nodes, sets, 0.8).collect()}
        name = {r["_node"]: r["_id"] for r in rows.collect()}
    u = [similar.shingle_hashes(t) for t in texts]
    assert got and all(_jaccard(texts[name[a]], texts[name[b]]) >= 0.8 for a, b in got)
    fp = {i: int(similar.marks(h)[0][0]) & (1 << 64) - 1 for i, h in enumerate(u)}
    near = {(i, j) for i in range(len(u)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2 and i < 40}
    parent = list(range(len(u)))
    top = lambda k: k if parent[k] == k else top(parent[k])
    for a, b in got:
        parent[top(name[a])] = top(name[b])
    assert all(top(i) == top(j) for i, j in near)
