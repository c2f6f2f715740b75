"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a prefix is the same for all pre-tokens that begin with it. Distinct pre-tokens are inserted in a trie; the
forward score of a node (the best sum of piece scores over all ways to cut its prefix) is computed once, when the node
is made, from those above it, with the number of pieces on that way. A pre-token's count is its terminal node's.
"""

from __future__ import annotations

import math
from array import array

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, arrow_type, slices
from .sp_bpe import MARK


def zipf_scores(model_file: str) -> dict[str, float]:
    """Piece scores for a vocabulary file that holds ranks only: log 1/(rank + 2), by Zipf's rule; nothing is trained."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usual = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    return {sp.id_to_piece(k): -math.log(n + 2) for n, k in enumerate(sorted(usual, key=lambda k: (-sp.get_score(k), k)))}


class SharedTrie:
    """most: nodes held, and `deep` more; a fuller trie is begun anew, which costs time and changes no count. Characters of a pre-token
    beyond the first `deep` get no nodes: their forward scores are held only as far back as a piece reaches."""

    def __init__(self, scores: dict[str, float], most: int = 300_000, room: int = 48 << 20, deep: int = 256):
        self.scores, self.most = scores, most
        self.deep = max(deep, max(map(len, scores), default=1))
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0  # for each byte of a character without a piece
        self.counts = Recent(self._count, room)  # terminal counts
        self._begin()

    def _begin(self):
        self.child: dict[int, int] = {}
        self.forward, self.tokens = array("d", [0.0]), array("i", [0])

    def _count(self, word: bytes) -> int:
        text, scores = MARK + word.decode("utf-8", "replace"), self.scores
        if len(self.forward) > self.most:
            self._begin()
        node, path = 0, [0]  # path: the nodes of this pre-token's prefixes
        for end, c in enumerate(text[: self.deep], 1):
            key = node << 21 | ord(c)
            node = self.child.get(key, -1)
            if node < 0:
                best, tokens = -math.inf, 0
                for begin in range(max(0, end - self.longest), end):
                    s = scores.get(text[begin:end])
                    if s is not None and (s := s + self.forward[path[begin]]) > best:
                        best, tokens = s, self.tokens[path[begin]] + 1
                if c not in scores:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    if (s := self.forward[path[end - 1]] + size * self.unknown) > best:
                        best, tokens = s, self.tokens[path[end - 1]] + size
                node = self.child[key] = len(self.forward)
                self.forward.append(best)
                self.tokens.append(tokens)
            path.append(node)
        return self.tokens[node] if len(text) <= self.deep else self._beyond(text, path)

    def _beyond(self, text: str, path: list[int]) -> int:
        """The count of a pre-token that is longer than its path: score and pieces of the last prefixes stand in a ring."""
        w, scores = self.longest, self.scores
        ring = {k % w: (self.forward[path[k]], self.tokens[path[k]]) for k in range(len(path) - w, len(path))}
        for end in range(len(path), len(text) + 1):
            best, tokens = -math.inf, 0
            for begin in range(end - w, end):
                s = scores.get(text[begin:end])
                if s is not None and (s := s + ring[begin % w][0]) > best:
                    best, tokens = s, ring[begin % w][1] + 1
            if text[end - 1] not in scores:
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                if (s := ring[(end - 1) % w][0] + size * self.unknown) > best:
                    best, tokens = s, ring[(end - 1) % w][1] + size
            ring[end % w] = best, tokens
        return ring[len(text) % w][1]

    def count(self, words: list[bytes]) -> int:
        return sum(map(self.counts.__getitem__, words))


_MADE: dict[str, SharedTrie] = {}


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _n_pretokens, _n_tokens of every row. Pre-tokens are the runs of other than ASCII white space, each with a leading mark; a
    character without a piece counts its bytes. Null and empty texts have none. Repeated rows agree; an empty table gives an empty
    result; of a pre-token of any length the first 256 characters are a path of the trie."""
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType
    id_type = arrow_type(kind)
    out = T.StructType([T.StructField("_id", kind), T.StructField("_n_pretokens", T.LongType()), T.StructField("_n_tokens", T.LongType())])

    def run(batches):
        if model_file not in _MADE:
            _MADE[model_file] = SharedTrie(zipf_scores(model_file))
        trie = _MADE[model_file]
        for b in slices(batches, 8 << 20):
            words = [t.encode("utf-8", "surrogatepass").split() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array([len(w) for w in words], pa.int64()), pa.array([trie.count(w) for w in words], pa.int64())], names=out.names)

    return rows.mapInArrow(run, out)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.select(F.col("_id").alias("doc_id"), F.col("_n_pretokens").alias("n_pretokens"), F.col("_n_tokens").alias("n_tokens"))
