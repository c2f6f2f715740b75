"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shapeloom.llm import bloom_exact, components, lang_bloom, mixing, quality_trees, run_index, simhash, similar, sp_bpe, token_store, trie_counts, warc_members
from shapeloom.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, _extra string"
SPACES = "[\x20\x09-\x0d]"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(4)
    vocab = ["the", "of", "Naïve", "été", "x", "漢字", "12", "don't", "##", "a_b", "\n", "  ", "\t", "🙂"]
    out = [None, "", " ", "the", " the ", "t he", "The of", "the of x"]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out += ["long " * 30_000, "word" * 20_000, out[20], out[21] + " end", out[21]]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t, ("en", "fr", None)[k % 3], ("b", "a", None, "c")[k % 4], "e") for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r[0]: r for r in df.collect()}


def grouped(values, near):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(values))]


def plain_fingerprint(text):
    w = re.findall(f"[^{SPACES[1:-1]}]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, rows, docs, empty):
    got = by_id(simhash.near_groups(docs))
    fps = [plain_fingerprint(r[1]) for r in rows]
    assert [got[k]._fp % 2**64 for k in range(len(rows))] == fps
    assert [got[k]._component for k in range(len(rows))] == grouped(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert simhash.near_groups(empty).count() == 0
    kept = {r.doc_id for r in simhash.drop_near(docs).collect()}
    assert kept == {r._component for r in got.values()}


def test_simhash_with_null_and_repeated_ids(spark):
    rows = [(1, "one two three four"), (None, "One two three four"), (None, "quite another text here"), (2, "last words of all"), (3, "Last words of all"), (3, "nothing like the rest")]
    kept = [tuple(r) for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


@pytest.mark.parametrize("bucket", [2, 16])
def test_simhash_links_of_crowded_buckets(spark, bucket):
    rng = np.random.default_rng(1)
    values = set()
    for q in rng.integers(0, 2**63, 4):
        for _ in range(40):
            v = int(q)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(bit)
            values.add(v - 2**64 if v >> 63 else v)
    values = sorted(values)
    roots = {r.node: r.root for r in components.connected_components(simhash.links(spark.createDataFrame([(v,) for v in values], "_fp long"), bucket=bucket)).collect()}
    want = grouped(values, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    assert [roots.get(v, v) for v in values] == [values[k] for k in want]


def test_sentencepiece(rows, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in sp_bpe.encode_documents(docs, PIECES).collect():
        ids = sp.encode(rows[r._id][1] or "", add_eos=True)
        assert r._ids == ids and r._decoded == sp.decode(ids) and r._n_tokens == len(ids)
        assert r._ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sp_bpe.encode_documents(empty, PIECES).count() == 0
    e, rng = sp_bpe.PieceBpe(PIECES, room=20_000), random.Random(3)
    parts = ["a", "e", "th", "ing", " ", "  ", "1", "é", "漢", "▁", "\n", ".", "!!", "²", "².", "<s>", "😀", "Ω", "THE", "́", "क्षि"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e.encode(s).tolist() == sp.encode(s)


def plain_statistics(t):
    t = t or ""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, cov = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            cov.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_quality(spark, rows, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 50)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_trees.train(docs, labels)
    for r in quality_trees.apply_rules(quality_trees.measure(docs, model=model), model.threshold).collect():
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) == plain_statistics(rows[r._id][1])
        assert r._base_failed == (r._n_words < 10 or 100 * r._n_repeat_words > 20 * r._n_words) and not (r._base_failed and r._kept)
    assert quality_trees.measure(empty, model=model).count() == 0
    none = quality_trees.train(empty, labels)
    assert none.score(np.zeros((2, len(quality_trees.FEATURES)))).min() >= none.threshold


def test_quality_scores_against_a_walk_over_the_nodes(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 50)], "doc_id long, quality int, toxic int")
    model = quality_trees.train(docs, labels)
    for r in quality_trees.apply_rules(quality_trees.measure(docs, model=model), model.threshold).collect():
        total = model.base
        for k in model.roots:
            while model.feature[k] >= 0:
                k = model.left[k] if r._features[model.feature[k]] <= model.cut[k] else model.right[k]
            total += model.value[k]
        score = 1 / (1 + np.exp(-total))
        assert r._score == pytest.approx(score) and r._kept == (not r._base_failed and r._score >= model.threshold)


def test_quality_of_long_texts(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "é", "##", "\n", "\t", "word%d" % rng.randrange(50)]) for _ in range(n)) for n in (3, 4, 5, 6, 40, 900)] + ["x" * 500, " " * 300, "a b c d e " * 60]
    want = [quality_trees.statistics(t) for t in texts]
    monkeypatch.setattr(quality_trees, "PIECE", 16)
    assert [quality_trees.statistics(t) for t in texts] == want and [w[0][:5] for w in want] == [plain_statistics(t) for t in texts]


def test_quality_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.8).astype(float)
    t = quality_trees.grow(x, y, (1, 0, -1))
    assert ((t.score(x) > 0.5) == y).mean() > 0.95
    grid = np.repeat(x[:50, None, :], 30, axis=1)
    for f, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(0, 1, 30)
        s = t.score(g.reshape(-1, 3)).reshape(50, 30)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()


def test_token_files(spark, rows, docs, empty):
    from tokenizers import Tokenizer

    ref, start = Tokenizer.from_file(WORDS), 0
    got = by_id(token_store.read_tokens(token_store.write_tokens(docs, WORDS, shared_dir(spark, "t"), 2)))
    for k, r in enumerate(rows):
        ids = np.array([*ref.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(got[k])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.read_tokens(token_store.write_tokens(empty, WORDS, shared_dir(spark, "t"), 2)).count() == 0
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], dtype=np.uint32)
    assert (token_store.unpack(*token_store.pack(v), len(v)) == v).all()
    w, rng = token_store.WordTokenizer(WORDS), random.Random(3)
    parts = ["a", "'s", "'S", "1", "_", "É", "漢", "\n", "\x1f", "\x85", "\xa0", ".", "!!", "²", "ª", "µ", "ß", "ẞ", " ", "Σ", "İ", "é", "<|endoftext|>", "ŉ", "\xad"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert w.encode(s).tolist() == ref.encode(s, add_special_tokens=False).ids


def test_language(spark, docs, empty):
    held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_bloom.train(held)
    got = held.join(lang_bloom.identify(held, model), F.col("doc_id") == F.col("_id")).filter(lang_bloom.in_fold(F.col("doc_id")))
    n, right = got.agg(F.count("*"), F.count_if(F.expr('lang = _lang'))).first()
    assert n > 20 and right / n > 0.97
    for r in lang_bloom.identify(docs, model, carry=("text",)).collect():
        letters = re.search(r"[^\W\d_]", r.text or "")
        assert (r._lang == "und") == (letters is None) and 0 <= r._score <= 1
    assert lang_bloom.identify(empty, lang_bloom.train(empty)).count() == 0
    assert {r._lang for r in lang_bloom.identify(docs, lang_bloom.train(empty)).collect()} == {"und"}


def test_language_with_null_and_repeated_ids(spark):
    n = spark.range(1500)
    text = F.concat_ws(" ", F.lit("alpha beta"), F.col("id"))
    parts = [n.select(F.lit(i).cast("long").alias("doc_id"), text.alias("text"), F.lit(f"l{k}").alias("lang")) for k, i in enumerate([None, 0, 1, 4, 5, 6, 8])]
    parts += [n.select(F.lit(i).cast("long").alias("doc_id"), F.lit("gamma delta").alias("text"), F.lit(f"m{i}").alias("lang")) for i in (0, 1, 4, 5, 6, 8)]
    docs = functools.reduce(lambda a, b: a.union(b), parts)
    want = sorted(r.lang for r in docs.filter(~lang_bloom.in_fold(F.col("doc_id"))).select("lang").distinct().collect())
    assert len(want) > 6 and lang_bloom.train(docs).langs == want


def test_warc(spark, tmp_path):
    body = "é<p>\r\n\r\n" + "x" * 120
    data = [(k, f"http://e.org/ü {k}\r\n", t) for k, t in enumerate([body, None, "", "short", "short", body, body + "y", body])] + [(5, None, body), (None, "u", body)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    top = shared_dir(spark, "w")
    written = warc_members.write_archives(warc_members.plan_records(pages), f"{top}/a", file_bytes=300)
    got = warc_members.read_archives(warc_members.normalise_archives(written, f"{top}/b"), pages.schema["page_id"].dataType).collect()
    want = []
    for k, _, t in data:
        raw = (t or "").encode()
        again = t == body and k != 0
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 0 if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    none = warc_members.write_archives(warc_members.plan_records(pages.limit(0)), f"{top}/c")
    assert warc_members.read_archives(warc_members.normalise_archives(none, f"{top}/d"), pages.schema["page_id"].dataType).count() == 0


def _area(rank, t):
    knots = mixing.SCHEDULES[rank % 3]
    w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
    return area / area[-1]


def test_mixing(rows, docs, empty):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    src = {r[0]: r[3] for r in rows}
    order = sorted({s for s in src.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(v for k, v in size.items() if src[k] == s) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * total[s]}
        for s in over or open_:
            target[s] = 3.0 * total[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    got = by_id(mixing.mix(docs))
    taken = Counter()
    for k, r in got.items():
        assert (r._size, r._source_size) == (size[k], total[src[k]]) and r._target == pytest.approx(target[src[k]])
        assert r._taken == r._copies * r._size and r._copies <= 3 and len(r._positions) == r._copies and all(0 <= p <= 1 for p in r._positions)
        taken[src[k]] += r._taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(v for k, v in size.items() if src[k] == s)
    assert {k: tuple(r) for k, r in by_id(mixing.mix(docs.repartition(2))).items()} == {k: tuple(r) for k, r in got.items()}
    for r in got.values():  # the integral of the schedule up to a position is the share of the demand there
        knots = mixing.SCHEDULES[order.index(src[r._id]) % 3]
        t = np.linspace(0, 1, 20_001)
        w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
        demand = [np.interp(p, t, area / area[-1]) * r._target for p in r._positions]
        assert all(b - a == pytest.approx(r._source_size, abs=1e-3 * max(r._target, 1)) for a, b in zip(demand, demand[1:]) if b < r._target * 0.999)
    for s in order:  # documents of a source follow each other along its demand, without gaps or overlaps
        first = sorted((np.interp(r._positions[0], t, _area(order.index(s), t)) * r._target, r._size) for r in got.values() if src[r._id] == s and r._positions and r._size)
        at = 0.0
        for mid, n in first:
            assert mid == pytest.approx(min(at + n / 2, target[s]), abs=1e-3 * max(target[s], 1))
            at += n
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(docs).count() == sum(r._copies for r in got.values())


def test_token_counts(rows, docs, empty):
    scores = trie_counts.zipf_scores(PIECES)
    low, longest = min(scores.values()) - 10, max(map(len, scores))

    def plain(word):
        t = "▁" + word
        best = [(0.0, 0)] + [(-1e300, 0)] * len(t)
        for e in range(1, len(t) + 1):
            for b in range(max(0, e - longest), e):
                if t[b:e] in scores and best[b][0] + scores[t[b:e]] > best[e][0]:
                    best[e] = best[b][0] + scores[t[b:e]], best[b][1] + 1
            n = len(t[e - 1].encode())
            if t[e - 1] not in scores and best[e - 1][0] + n * low > best[e][0]:
                best[e] = best[e - 1][0] + n * low, best[e - 1][1] + n
        return best[-1][1]

    known = {}
    for r in trie_counts.count_tokens(docs, PIECES).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[r._id][1] or "")
        assert r._n_pretokens == len(w) and r._n_tokens == sum(known.setdefault(x, plain(x)) for x in w)
    small = trie_counts.SharedTrie(scores, most=20, room=1000, deep=16)
    assert all(small.count([x.encode()]) == n for x, n in known.items() if len(x) < 50)
    assert trie_counts.count_tokens(empty, PIECES).count() == 0


def plain_repeats(data, length):
    seen, out = set(), []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("symbols", [1 << 20, 300])
def test_repeats(spark, empty, symbols):
    rng = random.Random(1)
    data = [None, "", "a" * 50, "é" * 30] + ["".join(rng.choice(["a", "b", "abab", "é", "xyz" * 3]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    data += [data[10], data[11] + data[12], "q" * 30_000]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(3)
    got = by_id(run_index.remove_repeats(df, length=12, kmer=8, bucket_bytes=500, index_symbols=symbols))
    want = plain_repeats([(t or "").encode() for t in data], 12)
    assert [tuple(got[k])[1:5] for k in range(len(data))] == want
    assert run_index.remove_repeats(empty).count() == 0
    twice = run_index.remove_repeats(df.union(df), length=12, kmer=8)
    assert sorted(tuple(r)[:5] for r in twice.collect()) == sorted((k, *w) for k, w in enumerate(want) for _ in range(2))


def test_repeats_of_a_hundred_bytes(spark):
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(90, 400))) for _ in range(12)]
    data = [" ".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("ijklmn") for _ in range(rng.randint(1, 150))) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    data += [data[3], data[4][:99], data[4][:100], "ab" * 700, None]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(4)
    want = plain_repeats([(t or "").encode() for t in data], 100)
    for symbols in (1 << 20, 2_000):
        got = by_id(run_index.remove_repeats(df, bucket_bytes=4_000, index_symbols=symbols))
        assert [tuple(got[k])[1:5] for k in range(len(data))] == want


@pytest.mark.parametrize("most", [30, 100, 200, 1 << 20])
def test_repeats_in_parts(most):
    rng = random.Random(most)
    for _ in range(40):
        length = rng.choice([3, 5, 12])
        some = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 40))) for _ in range(5)]
        some = [rng.choice(some) if rng.random() < 0.6 else bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 40))]
        strings = [[s[k : k + length] for k in range(len(s) - length + 1)] for s in some]
        kept = [k for k, t in enumerate(strings) if len(set(t)) == len(t)]  # no string is twice in a segment
        seen, want = set(), []
        for k in kept:
            want.append([t in seen for t in strings[k]])
            seen.update(strings[k])
        got = run_index.repeated_in_parts([some[k] for k in kept], np.array([len(strings[k]) for k in kept], dtype=np.int64), length, max(2, length - 4), most)
        assert [hit.tolist() for hit in got] == want


def test_run_length_index_is_the_transform():
    text = np.frombuffer(b"banana_bandana_banana", dtype=np.uint8).astype(np.uint16)
    order = sorted(range(len(text)), key=lambda i: bytes(text[i:].astype(np.uint8)))
    assert run_index.suffix_array(text).tolist() == order
    before, match = run_index.RunLengthIndex(text).matching_statistics()
    for a, b in zip(order, order[1:]):
        n = next((k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), 0)
        assert (before[b], match[b]) == (a, n)
    cut = np.array([5, 3, 0, 5, 3, 0, 5, 3, 0, 0], dtype=np.uint16)  # each separator differs from the others, in order of place
    assert run_index.suffix_array(cut).tolist() == [2, 5, 8, 9, 1, 4, 7, 0, 3, 6]
    assert run_index.RunLengthIndex(cut).matching_statistics()[1].tolist() == [0, 0, 0, 2, 1, 0, 2, 1, 0, 0]


def test_exact(spark, rows, docs, empty):
    norm = [re.sub(SPACES, "", r[1] or "") for r in rows]
    got = by_id(bloom_exact.mark_exact(docs))
    for k, t in enumerate(norm):
        own = [j for j, u in enumerate(norm) if u == t]
        keep = min(own, key=lambda j: (-len(rows[j][1] or ""), j))
        r = got[k]
        assert (r._digest, r._keep_id, r._group_size, r._kept) == (hashlib.sha256(t.encode()).hexdigest(), keep, len(own), keep == k)
    assert bloom_exact.mark_exact(empty).count() == 0
    kept = bloom_exact.drop_exact(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in got.items() if r._kept) and kept.columns == docs.columns
    tight = by_id(bloom_exact.mark_exact(docs, max_bits_log2=3))  # a full filter lets all rows through, and changes nothing
    assert {k: tuple(r) for k, r in tight.items()} == {k: tuple(r) for k, r in got.items()}


def test_exact_lets_unique_rows_pass(spark):
    n = 1 << 14
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 64 == 0, F.col("id") % 128).otherwise(F.col("id"))).alias("text"))
    read = bloom_exact._read(rows, "doc_id", "text")
    narrow = rows.select(*[c.alias(k) for k, c in read.items()])
    bitmaps, bits = bloom_exact.repeated_filter(narrow, max_bits_log2=13)  # two rows to a bit
    passed = bloom_exact.possibly_repeated(narrow, bitmaps, bits).groupBy("_digest").agg(F.count("*").alias("c"), F.first("_possible").alias("p"))
    alone, through, missed = passed.agg(*[F.count_if(F.expr(e)) for e in ("c = 1", "c = 1 and p", "c > 1 and not p")]).first()
    assert missed == 0 and alone > 0.9 * n and through < 0.05 * alone


CLASHING = "doc_id long, text string, lang string, source string, _id int, _digest int, _lang int, _score int, _size int, _src int, _null int, _positions int, _at int, _h int, _row int, row int, v int, `a.b` int"


def test_stages_keep_columns_of_any_name(spark):
    rows = [(k, t, "en", s, *([k] * 14)) for k, (t, s) in enumerate([("one two three", "a"), ("one two three", "a"), ("four five six seven", "b"), (None, None), ("eight nine", "b")])]
    docs = spark.createDataFrame(rows, CLASHING)
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    model = lang_bloom.LanguageFilter.fit({"en": (np.unique(lang_bloom._grams(np.frombuffer(b" one two three four five six seven eight nine ", dtype=np.uint8), 3)), np.full(44, 5)[: len(np.unique(lang_bloom._grams(np.frombuffer(b" one two three four five six seven eight nine ", dtype=np.uint8), 3)))])})
    for got, want in ((lang_bloom.keep_known(docs, model, 0.0), [0, 1, 2, 4]), (bloom_exact.drop_exact(docs), [0, 2, 3, 4]), (similar.drop_similar(docs), [0, 2, 3, 4])):
        assert got.columns == docs.columns and as_rows(got) == sorted([rows[k] for k in want], key=str)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)


def test_very_long_texts(spark):
    import sentencepiece

    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    sp, e = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp_bpe.PieceBpe(PIECES, room=1 << 20)
    assert e.encode(word).tolist() == sp.encode(word) and word not in e.words
    text = ("ab cd  é\n" * 300_000)[: 2 * sp_bpe.LOT + 17]
    for t in (text, text.replace("  ", " ")):
        assert e.encode(t).tolist() == sp.encode(t)
    trie = trie_counts.SharedTrie(trie_counts.zipf_scores(PIECES))
    few = trie_counts.SharedTrie(trie.scores, deep=1 << 30)
    assert trie.count([word[:20_000].encode()]) == few.count([word[:20_000].encode()]) and len(trie.forward) < 1000
    model = lang_bloom.LanguageFilter.fit({k: (np.unique(lang_bloom._grams(np.frombuffer(t, dtype=np.uint8), 3)), np.full(len(np.unique(lang_bloom._grams(np.frombuffer(t, dtype=np.uint8), 3))), 4)) for k, t in (("x", b" abc cde "), ("y", b" xyz zzz "))})
    long = "abc xyz cde " * 40_000
    assert model.predict([long, "abc", None, long])[0] == ["x", "x", "und", "x"]


def plain_language(model, grams, text):
    """Scores by exact sets of n-grams, without filters."""
    hits, letters = Counter(), lang_bloom._letters(text)
    for size in lang_bloom.SIZES:
        for at in range(len(letters) - size + 1):
            for k in model.langs:
                hits[k] += int.from_bytes(letters[at : at + size], "big") | size << 32 in grams[k]
    return hits


def test_language_filters_agree_with_exact_sets(spark):
    held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lang_bloom.train(held)
    sample = [r.text for r in held.filter("text is not null").orderBy("doc_id").limit(60).collect()]
    every = np.unique(np.concatenate([lang_bloom._grams(np.frombuffer(lang_bloom._letters(t), dtype=np.uint8), s) for t in sample for s in lang_bloom.SIZES]))
    found = model.masks(every)
    grams = {k: {int(g) for g, m in zip(every, found[j // 64]) if int(m) >> j % 64 & 1} for j, k in enumerate(model.langs)}
    langs, scores = model.predict(sample)
    for t, lang, score in zip(sample, langs, scores):
        hits, seen = plain_language(model, grams, t), sum(max(len(lang_bloom._letters(t)) - s + 1, 0) for s in lang_bloom.SIZES)
        right = {k: max(0.0, (hits[k] - seen * model.false_rate[j]) / (1 - model.false_rate[j])) for j, k in enumerate(model.langs)}
        if re.search(r"[^\W\d_]", t) and sum(right.values()):
            assert lang == max(model.langs, key=lambda k: right[k]) and score == pytest.approx(max(right.values()) / sum(right.values()))


def test_language_filters_hold_the_ngrams_of_plain_counts():
    rng = random.Random(6)
    texts = {lang: [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(80)) for _ in range(12)] for lang, letters in {"xx": "abcdeé", "yy": "cdefgh", "zz": "hijkl漢"}.items()}
    count = {lang: Counter() for lang in texts}
    for lang, own in texts.items():
        for t in own:
            b = lang_bloom._letters(t)
            count[lang].update(b[k : k + s] for s in lang_bloom.SIZES for k in range(len(b) - s + 1))
    number = lambda g: int.from_bytes(g) | len(g) << 32
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in count.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for c in count.values() for g in c}
    exact = {lang: {g for g, n in c.items() if n >= 2 and rate[lang][g] >= 0.25 * top[g]} for lang, c in count.items()}
    given = {lang: (np.array(sorted(map(number, c)), dtype=np.uint64), np.array([n for _, n in sorted((number(g), n) for g, n in c.items())])) for lang, c in count.items()}
    model = lang_bloom.LanguageFilter.fit(given, slots_log2=16)
    every = sorted(top)
    masks = model.masks(np.array([number(g) for g in every], dtype=np.uint64))[0]
    for j, lang in enumerate(model.langs):
        found = {g for g, m in zip(every, masks) if int(m) >> j & 1}
        assert exact[lang] <= found  # a filter forgets nothing
        others = len(every) - len(exact[lang])
        assert abs(len(found - exact[lang]) - model.false_rate[j] * others) <= 3 * max(1, (model.false_rate[j] * others) ** 0.5) + 3


def test_pipeline(spark):
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    lang = corpus_pipeline.language_id(spark, docs, sf)
    ids = {r.doc_id for r in lang.collect()}
    assert {k for k, t in text.items() if len(t) > 200} <= ids
    norm, best = {}, {}
    for k in ids:
        norm.setdefault(re.sub(SPACES, "", text[k]), []).append(k)
    exact = {min(v, key=lambda j: (-len(text[j]), j)) for v in norm.values()}
    order = sorted(exact)
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[k])) for k in order]
    shingles = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in words]
    near = {order[k] for k in grouped(shingles, lambda a, b: len(a & b) >= 0.8 * len(a | b))}
    out = corpus_pipeline.run(spark, sf)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in out.collect():
        best[r.doc_id] = best.get(r.doc_id, 0) + 1
        assert r.ids == sp.encode(text[r.doc_id], add_eos=True)
    assert set(best) <= near and max(best.values()) <= 3
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, lang, sf), sf)
    assert {r.doc_id for r in kept.collect()} == near  # no clean document goes, no copy stays
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, kept, sf).collect()) == best
