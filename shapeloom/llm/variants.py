"""Spelling variants: words at one inserted, deleted or replaced character, found with forward and backward minimal automata.

Of two words at one edit, the shorter of length L, one half of the shorter is also in the other: its first L // 2 characters as a
prefix, or its last L // 2 as a suffix. So every word goes to the groups of its halves (as the shorter, and as the longer one), which
Spark deals out. In a group, a minimal acyclic automaton is built of the sorted words, forward for prefixes and of the reversed words
for suffixes. A word is looked up by walking its half exactly and completing the rest with one error; an automaton numbers its words
(each edge knows how many words come before those behind it), and the numbers index the words' counts.

A group of over MAX_GROUP words is dealt again: of what lies between the shared prefix and suffix, again one half must agree, so each
word goes to two smaller groups, and so on until one character is left, where a group can't hold more words than there are
combinations of two characters. A pair that agrees in both halves is met in both groups and reported by the forward one alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize, release, slices

#: Fixed values of the words that are compared: least length and count, and how many times more frequent a word's form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many (by checksum) loses a character.
LOSS = 199
MAX_GROUP = 50_000
#: Words that a task holds while it counts.
MAX_COUNTED = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, loss: int = LOSS) -> DataFrame:
    """word, n: runs of Latin letters of whole texts with A to Z in lower case, after the planted loss of a character, that are long and
    frequent enough.

    A null text has none, a null id is written as ''. Rows that repeat count each. Tasks add up what they have read before the shuffle, so a
    word of any frequency is a row for each task there."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def count(batches):
        total: Counter = Counter()

        def flush():
            words = list(total)
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[w] for w in some], pa.int64())], names=["word", "n"])
            total.clear()

        for b in slices(batches, 4 << 20):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(runs.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % loss == 0:
                        h %= len(w)
                        w = w[:h] + w[h + 1 :]
                        if len(w) < least_length:
                            continue
                    total[w] += n
            if len(total) >= MAX_COUNTED:
                yield from flush()
        yield from flush()

    rows = id_and_text(docs, id_col, text_col).select(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct strings, in which each string has a number: its place among them.

    A state is a tuple (whether a string ends here, {character: (state, strings before it, counted from this state)}, strings from here)."""

    def __init__(self, strings: list[str]):
        known: dict[tuple, tuple] = {}
        path: list[list] = [[False, []]]  # open states along the last string: end, edges (character, state)
        last = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                end, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], state(end, edges)))

        def state(end: bool, edges: list) -> tuple:
            key = (end, tuple([(c, id(s)) for c, s in edges]))
            found = known.get(key)
            if found is None:
                before, out = int(end), {}
                for c, s in edges:
                    out[c] = (s, before)
                    before += s[2]
                found = known[key] = (end, out, before)
            return found

        for s in strings:
            same = 0
            for x, y in zip(s, last):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(s) - same))
            path[-1][0], last = True, s
        close(0)
        self.root = state(*path[0])
        self.states = len(known)

    def _ends(self, state, number: int, s: str, k: int) -> int | None:
        """The number of the string that goes on from state with s[k:], if there is one."""
        for c in s[k:]:
            edge = state[1].get(c)
            if edge is None:
                return None
            state, number = edge[0], number + edge[1]
        return number if state[0] else None

    def one_error(self, s: str, exact: int, longer: bool) -> set[int]:
        """Numbers of strings that begin with s[:exact] and differ from s by one edit. longer: those that lack a character of s, else those
        that have one more or another one."""
        state, number, found = self.root, 0, set()
        for c in s[:exact]:
            edge = state[1].get(c)
            if edge is None:
                return found
            state, number = edge[0], number + edge[1]
        for k in range(exact, len(s) + 1):
            if longer:
                if k < len(s):
                    found.add(self._ends(state, number, s, k + 1))
            else:
                for c, (to, before) in state[1].items():
                    found.add(self._ends(to, number + before, s, k))
                    if k < len(s) and c != s[k]:
                        found.add(self._ends(to, number + before, s, k + 1))
            edge = state[1].get(s[k]) if k < len(s) else None
            if edge is None:
                break
            state, number = edge[0], number + edge[1]
        found.discard(None)
        return found


def _shared(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def near_in_group(words: list[str], counts: list[int], shorter: int, prefix: int, suffix: int, backward: bool, limit: int):
    """(word, near words, count and word of the best of them) of each word with near ones whose common prefix is under limit.

    words: sorted as they are, or by their reverse if backward, distinct, all with the same prefix and suffix of such lengths."""
    automaton = Automaton([w[::-1] for w in words] if backward else words)
    exact = suffix if backward else prefix
    for w in words:
        near = [k for k in automaton.one_error(w[::-1] if backward else w, exact, len(w) > shorter) if words[k] != w]
        if backward or limit <= len(w):
            near = [k for k in near if _shared(w, words[k]) < limit]
        if near:
            best = min(near, key=lambda k: (-counts[k], words[k]))
            yield w, len(near), counts[best], words[best]


#: The characters of a group that are shared at its start and at its end, and what lies between them in the word.
_HEAD, _TAIL = "substring(word, 1, prefix)", "if(suffix = 0, '', right(word, suffix))"
_KEY = ["shorter", "prefix", "suffix", "backward", "limit", "head", "tail"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.expr(_HEAD), "tail": F.expr(_TAIL)})


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with half of what lies between prefix and suffix added to the one, and to the other."""
    half = F.floor((F.col("shorter") - F.col("prefix") - F.col("suffix")) / 2).cast("int")
    end = F.col("prefix") + half
    forward = F.struct(end.alias("prefix"), F.col("suffix").alias("suffix"), F.lit(False).alias("backward"), F.col("limit").alias("limit"))
    backward = F.struct(F.col("prefix").alias("prefix"), (F.col("suffix") + half).alias("suffix"), F.lit(True).alias("backward"), F.least(F.col("limit"), end).alias("limit"))
    return rows.select("word", "n", "shorter", F.explode(F.array(forward, backward)).alias("h")).select("word", "n", "shorter", "h.*")


def groups(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """word, n and the group's key (_KEY): groups of at most max_group words that hold, for any two words at one edit, both of them
    in one whose limit is over the length of their common prefix, and in no other such group."""
    length = F.char_length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter")).withColumns({"prefix": F.lit(0), "suffix": F.lit(0), "limit": F.lit(2**31 - 1)})
    open_, done = _keyed(_halves(start.filter("shorter > 0"))), None
    while True:
        sizes = open_.groupBy(*_KEY).agg(F.count("*").alias("size"))
        large = materialize(sizes.filter((F.col("size") > max_group) & (F.expr("shorter - prefix - suffix") > 1)), "variant-groups")
        if large.isEmpty():
            release(large)
            return open_ if done is None else done.unionByName(open_)
        small = open_.join(large.drop("size"), _KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = _keyed(_halves(open_.join(large.drop("size"), _KEY, "left_semi")))


def near_words(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """word, n_near, best_n, best of each word that has near ones: how many, and the most frequent of them (ties: first in code-point order).

    words: distinct words and their counts n. Of a pair, its group alone reports it, so numbers of groups add up."""
    dealt = groups(words, max_group)
    order = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    rows = dealt.withColumn("_g", F.xxhash64(*_KEY)).repartition("_g").sortWithinPartitions("_g", *_KEY, order).select(*_KEY, "word", "n")

    def run(batches):
        key, held, counts, out = None, [], [], []

        def ready():
            if len(held) > 1:
                out.extend(near_in_group(held, counts, key[0], key[1], key[2], key[3], key[4]))

        def packed():
            c = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string())], names=["word", "n_near", "best_n", "best"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for k, w, n in zip(zip(*cols[:7]), cols[7], cols[8]):
                if k != key:
                    ready()
                    key, held, counts = k, [], []
                    if len(out) >= 20_000:
                        yield packed()
                held.append(w)
                counts.append(n)
        if key is not None:
            ready()
        if out:
            yield packed()

    found = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain from each word (word, form). A form is several times as frequent as its word, so chains are no
    longer than a logarithm of the counts, and each round doubles how far a word has come."""
    far = materialize(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = far.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(far.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variant-roots")
        release(far)
        far = step.select("word", "root")
        far._folder = step._folder
        if step.filter("_moved").isEmpty():
            return far


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP, **words) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of word_counts(): its form is the near word of largest n, if that is
    TIMES its own n at least, else null; root follows forms to the last.

    Without documents or words the result is empty. Whole texts of any length are read; other columns aren't looked at."""
    counted = materialize(word_counts(docs, id_col, text_col, **words), "variant-words")
    near = materialize(near_words(counted, max_group), "variant-near")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    rows = counted.join(near, "word", "left")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "variant-forms")
    release(counted, near)
    return rows.join(roots(rows.filter("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Checksums by the table of the polynomial, bytes of a character up to U+00FF written out; near words by the words with one character less.
OP12_SQL = r"""
WITH RECURSIVE
  bits AS (SELECT i, 0 AS k, CAST(i AS UBIGINT) AS c FROM range(256) t(i)
           UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END FROM bits WHERE k < 8),
  tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
  per AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
  bytes AS (SELECT doc_id, w, n, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''),
              lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS UBIGINT)] ELSE [CAST(195 AS UBIGINT), CAST(unicode(x) - 64 AS UBIGINT)] END)) AS b FROM per),
  crc AS (SELECT doc_id, w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), b), lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS h FROM bytes, tab),
  lost AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word FROM crc),
  v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, range(1, 100000) t(i) WHERE i <= length(word)),
  pairs AS (SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word FROM less a JOIN v b ON a.rest = b.word
            UNION SELECT b.word, a.word FROM less a JOIN v b ON a.rest = b.word),
  near AS (SELECT x, y, v.n AS m, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS r, count(*) OVER (PARTITION BY x) AS n_near FROM pairs JOIN v ON v.word = y),
  f AS (SELECT v.word, v.n, coalesce(near.n_near, 0) AS n_near, CASE WHEN near.m >= 5 * v.n THEN near.y END AS form, CASE WHEN near.m >= 5 * v.n THEN near.m END AS form_n
        FROM v LEFT JOIN near ON near.x = v.word AND near.r = 1),
  chain AS (SELECT word, word AS root, 0 AS d FROM f UNION ALL SELECT chain.word, f.form, d + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
  ends AS (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends USING (word)
"""
