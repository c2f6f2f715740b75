"""Decontamination, spelling variants and the schema rewrite against brute force on small tables."""

import datetime
import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shapeloom.llm import contamination, schema_rewrite, variants
from shapeloom.llm.common import table_folder

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# ---- decontamination ------------------------------------------------------------------------------------------------------------------


def plain_leaks(text, items, size):
    low = lower(text or "")
    words = [(m[0], m.start(), m.end()) for m in re.finditer(WORD, low)]
    hit, found = [False] * len(words), set()
    for i, t in items:
        w = re.findall(WORD, lower(t or ""))
        n = min(size, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for k in range(len(words) - n + 1) if w else ():
            if tuple(x[0] for x in words[k : k + n]) in windows:
                hit[k : k + n] = [True] * n
                found.add("" if i is None else str(i))
    spans = []
    for k, h in enumerate(hit):
        if h and k and hit[k - 1]:
            spans[-1] = (spans[-1][0], words[k][2])
        elif h:
            spans.append(words[k][1:])
    return len(words), sum(hit), sorted(found), spans


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(7)
    vocab = ["a", "b", "the", "Été", "漢字", "x1", "Z", "🙂", "don", "t"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([0, 1, 3, 4, 5, 9])))) for k in range(14)] + [(3, "a b the"), (None, "x1 Z x1 Z"), (99, None), (98, "..."), (97, "A, b; THE -- été!"), (10, "a b the Été")]
    texts = [None, "", "...", "a b the été", "A-b_the\nÉTÉ x", "A-b_the\nété x"] + ["".join(w + rng.choice([" ", ", ", "\n", "--", "\x00"]) for w in make(rng.randint(1, 80))) for _ in range(50)]
    texts += ["filler " * 200_000 + "A b. The été" + " filler" * 1000, texts[7], texts[7]]
    return items, [(k if k != 9 else None, t, "e") for k, t in enumerate(texts)]


@pytest.mark.parametrize("part_bytes", [contamination.PART_BYTES, 200])
def test_leaks(spark, leaks, part_bytes):
    items, docs = leaks
    d = spark.createDataFrame(docs, "doc_id long, text string, _items string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, _n int")
    got = {r._id: r for r in contamination.find_leaks(d, i, size=4, part_bytes=part_bytes).collect()}
    assert len(got) == len(docs)
    for k, t, _ in docs:
        if t and len(t) > 1_000_000:
            continue
        r = got[k]
        assert (r._n_words, r._n_hit, r._items, [(s.start, s.end) for s in r._spans]) == plain_leaks(t, items, 4)
    long_ = next(r for r in got.values() if r._n_words > 200_000)
    assert long_._n_hit == 4 and "97" in long_._items and docs[56][1][slice(*long_._spans[0])] == "A b. The été"


def test_leaks_edges(spark, leaks):
    items, docs = leaks
    d, i = spark.createDataFrame(docs, "doc_id long, text string, _row string"), spark.createDataFrame(items, "item_id long, text string")
    none = contamination.find_leaks(d, i.filter("false"))
    assert none.count() == len(docs) and none.filter("_n_hit > 0 or size(_items) > 0").isEmpty()
    assert contamination.find_leaks(d.filter("false"), i).count() == 0
    kept = contamination.drop_leaks(d, i, size=4)
    assert kept.columns == d.columns
    want = sorted(str(x) for x in docs if (x[1] and len(x[1]) < 1_000_000 or not x[1]) and plain_leaks(x[1], items, 4)[1] == 0)
    assert sorted(str(tuple(r)) for r in kept.collect()) == want


# ---- spelling variants ----------------------------------------------------------------------------------------------------------------


def plain_variants(docs, least_count, loss):
    count = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % loss == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= least_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, out = {}, {}
    for w in count:
        by = [v for v in count if near(w, v)]
        best = min(by, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 5 * count[w] else None
        out[w] = len(by)
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], out[w], count[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    base = ["aaaaaa", "aaaaaaaaaaaaaa", "banana", "bananas", "gârçon", "spellings", "ÀÉîõü" * 2, "abababab", "informationen"]
    words = Counter()
    for w in base:
        words[w] = rng.choice([1, 6, 40, 300])
        for _ in range(25):
            k = rng.randrange(len(w))
            c = rng.choice("abné")
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words[v] += rng.choice([1, 2, 5, 8])
            k = rng.randrange(len(v))
            words[v[:k] + rng.choice("abs") + v[k:]] += 1
    words["turbines"], words["turbine"], words["turbin"] = 500, 60, 7  # a chain of forms
    words["z" * 3000] = words["z" * 3001] = 7
    flat = [w.upper() if w.isascii() and rng.random() < 0.2 else w for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    docs = [(k, rng.choice([" ", "-", "1"]).join(flat[k * 40 : (k + 1) * 40])) for k in range(len(flat) // 40 + 1)]
    return docs + [(None, "banana bananas banana"), (5, None), (6, ""), (7, "short"), (8, "banana"), (8, "banana")]


@pytest.mark.parametrize("max_group", [variants.MAX_GROUP, 3])
def test_variants(spark, spelled, max_group):
    d = spark.createDataFrame([(i, t, "e", 0) for i, t in spelled], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(d, max_group=max_group, loss=7, least_count=2).collect()}
    want = plain_variants(spelled, 2, 7)
    assert got == want and any(x[0] for x in want.values()) and any(x[1] != x[0] and x[0] for x in want.values())
    assert variants.spelling_variants(d.filter("false")).count() == 0


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    a = variants.Automaton(words)
    assert [a._ends(a.root, 0, w, 0) for w in words] == list(range(len(words))) and a._ends(a.root, 0, "cccccccc", 0) is None
    rest = defaultdict(set)  # states of a minimal automaton are the different sets of what may follow a prefix
    for w in words:
        for k in range(len(w) + 1):
            rest[w[:k]].add(w[k:])
    assert a.states == len({frozenset(x) for x in rest.values()})
    assert variants.Automaton([]).one_error("a", 0, False) == set()


# ---- schema rewrite -------------------------------------------------------------------------------------------------------------------

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
NAMES = [x.split()[0] for x in CLIENTS.split(", ")]


def some_clients(n):
    rng = random.Random(11)
    maybe = lambda v: None if rng.random() < 0.1 else v
    rows = [(k, maybe(k // 2), maybe("crm"), maybe(datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.randrange(10**12))), maybe(f"n{k}"), maybe(f"é{k}@x"), maybe("City"), maybe(k % 25), maybe("s"), maybe(rng.choice([-0.1, 1e9 + 0.3, 5.0, 1234.56]))) for k in range(n)]
    rng.shuffle(rows)
    return rows


def plain_rewrite(rows, file_rows):
    order = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    out = {}
    for no in range(math.ceil(len(order) / file_rows)):
        part, v = [list(r) for r in order[no * file_rows : (no + 1) * file_rows]], zlib.crc32(f"7:{no}".encode()) % 24
        v = v if v < 16 else 0
        for r in part:
            if v & 8 and r[9] is not None:
                r[9] = float(pa.scalar(r[9], pa.float64()).cast(pa.float32(), safe=False).as_py())
            if v & 4:
                r[7], r[6] = -1, "none"
        text = lambda k, x: "?" if x is None else str((x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)) if k == 3 else str(math.floor(1048576 * x)) if k == 9 else str(x)
        names = [n for n in NAMES if not (v & 4 and n in ("nation_id", "city"))]
        names = names[:1] + names[:0:-1] if v & 2 else names
        names = [{"name": "email", "email": "name"}.get(n, n) for n in names] if v & 1 else names
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[no] = (v, len(part), sum(x is None for r in part for x in r), sha(",".join(str(r[0]) for r in part)), sha("\n".join("|".join(text(k, x) for k, x in enumerate(r)) for r in part)), ",".join(names), v != 0)
    return out


@pytest.mark.parametrize("n, file_rows, fan_in", [(2600, None, 256), (700, 40, 2), (3, 1, 256)])
def test_schema_rewrite(spark, tmp_path, monkeypatch, n, file_rows, fan_in):
    rows = some_clients(n)
    monkeypatch.setattr(schema_rewrite, "FAN_IN", fan_in)
    monkeypatch.setattr(schema_rewrite, "RUN_ROWS", 16)
    df = spark.createDataFrame([(*r, "clash") for r in rows], CLIENTS + ", _key string").repartition(9)
    kinds = {f.name: schema_rewrite.arrow_type(f.dataType) for f in df.schema} | {"nation_id": pa.int64()}
    evolved = schema_rewrite.evolved_schema([(x, kinds[x]) for x in NAMES])
    folder = f"{table_folder(spark, 'test')}/files"
    starts = schema_rewrite.lay_out(df, "client_id", folder, evolved, file_rows, fan_in=fan_in)
    for r in starts.collect():  # starting files keep the ids and drift in names, order, types and columns
        f = pq.read_schema(r.uri.removeprefix("file://"))
        assert [schema_rewrite.field_id(x) for x in f] == [schema_rewrite.field_id(x) for x in schema_rewrite.drifted(evolved, r.version)] and ",".join(f.names) == r.start_columns
        assert not r.version & 8 or "float" == str(f.field("balance").type)
    final = schema_rewrite.rewrite_files(starts, folder, evolved, {8: -1, 7: "none"})
    got = {r.file_no: r for r in schema_rewrite.digest_files(final, "client_id").collect()}
    assert {k: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.rewritten) for k, r in got.items()} == plain_rewrite(rows, file_rows or 1 + n // 1000)
    there = glob.glob(folder.removeprefix("file://") + "/*")
    assert sorted(there) == sorted(r.path.removeprefix("file://") for r in got.values())
    assert all(pq.read_schema(x).equals(evolved, check_metadata=True) for x in there)


def test_schema_rewrite_edges(spark):
    evolved = schema_rewrite.evolved_schema([("client_id", pa.int64()), ("name", pa.string()), ("email", pa.string()), ("nation_id", pa.int64()), ("city", pa.string()), ("balance", pa.float64())])
    fields = "client_id long, name string, email string, nation_id long, city string, balance double"
    same = [(5, f"n{k % 3}", None, k % 7, "c", float("nan")) for k in range(300)]
    rows = same + same[:50] + [(None, "x", None, None, None, None), (-1, "y" * 100_000, "", 1, None, math.inf), (5, None, None, None, None, None)]
    seen = set()
    for parts in (1, 7):
        df, folder = spark.createDataFrame(rows, fields).repartition(parts, F.rand(parts)), f"{table_folder(spark, 'test')}/files"
        got = schema_rewrite.digest_files(schema_rewrite.rewrite_files(schema_rewrite.lay_out(df, "client_id", folder, evolved, 60), folder, evolved, {4: -1, 5: "none"}), "client_id").orderBy("file_no").collect()
        assert sum(r.n_rows for r in got) == len(rows) and all(r.n_rows == 60 for r in got[:-1])
        seen.add(tuple(r.rows_sha256 for r in got))
    assert len(seen) == 1  # rows that repeat an id have one order, however they came
    folder = f"{table_folder(spark, 'test')}/files"
    assert schema_rewrite.lay_out(spark.createDataFrame([], fields), "client_id", folder, evolved).count() == 0
    with pytest.raises(Exception, match="field_id|NoneType|KeyError"):
        schema_rewrite.cast_by_id(pa.table({"client_id": [1]}), evolved)


def test_query_writes_a_new_folder_each_time(spark):
    a, b = (schema_rewrite.op13_schema_rewrite(spark, "/root/testdata/sf0.001").collect() for _ in range(2))
    assert {r.file_no: (r.ids_sha256, r.rows_sha256) for r in a} == {r.file_no: (r.ids_sha256, r.rows_sha256) for r in b} and {r.path for r in a}.isdisjoint(r.path for r in b)
