r"""Token counts: greedy longest-match word pieces in linear time, without building pieces.

The vocabulary is a trie of byte strings. A node that is a piece fails to the root with one popped
token; any other node fails to where its parent's failure chain can go on with its byte, and the
tokens popped on that way are added up beforehand. Reading a word follows trie edges; where none
goes on it adds the node's popped count and moves to its failure link, so every byte is read once.
A word that cannot be split into pieces is one unknown token.

Words are runs of ``[^\x20\x09-\x0D]``. A word is read behind a mark: for byte-level vocabularies
the space that starts their word-initial pieces, for word-piece vocabularies ("##" before inner
pieces) a zero byte that is put before word-initial pieces. Counts of words are remembered within
a task, in a table of bounded size. The vocabulary is read on the driver, its size is checked, and
it is broadcast.

Defined results: a null or word-less text has no tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import utf8_rows, word_runs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
_MEMORY = 1 << 18


def read_vocabulary(spark, path: str = VOCABULARY) -> tuple[bytes, list[bytes]]:
    """(mark, pieces) from a .tiktoken file of ranks (base64, byte-level) or a word-piece list (one
    piece a line, "##" before inner ones)."""
    try:
        with open(path, "rb") as file:
            data = file.read(MAX_VOCABULARY_BYTES + 1)
    except FileNotFoundError:  # a store that only Spark reads
        data = b"\n".join(bytes(r["value"]) for r in spark.read.text(path).selectExpr("CAST(value AS binary) AS value").toLocalIterator())
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    lines = data.split(b"\n")
    if path.endswith(".tiktoken"):
        return b" ", [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    pieces = [line.rstrip(b"\r") for line in lines]
    return b"\0", [p[2:] if p.startswith(b"##") else b"\0" + p for p in pieces if p and p != b"##"]


class Matcher:
    """Trie with failure links and popped-token counts."""

    def __init__(self, mark: bytes, pieces: list[bytes]):
        self.mark = mark
        edges: dict[int, int] = {}  # node << 8 | byte -> node
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(whole)
                    whole.append(False)
                node = edges[key]
            whole[node] = node > 0
        below: list[list[tuple[int, int]]] = [[] for _ in whole]
        for key, node in edges.items():
            below[key >> 8].append((key & 255, node))
        fail, popped = [-1] * len(whole), [0] * len(whole)
        level = [0]
        while level:
            deeper = []
            for u in level:
                for byte, v in below[u]:
                    deeper.append(v)
                    if whole[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, n = fail[u], popped[u]
                    while z >= 0 and (z << 8 | byte) not in edges:
                        n += popped[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], popped[v] = edges[z << 8 | byte], n
            level = deeper
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = tokens = 0
        for byte in self.mark + word:
            while (node << 8 | byte) not in edges:
                if fail[node] < 0:
                    return 1  # unknown
                tokens += popped[node]
                node = fail[node]
            node = edges[node << 8 | byte]
        while node:
            if fail[node] < 0:
                return 1
            tokens += popped[node]
            node = fail[node]
        return tokens


class _Counts(dict):
    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMORY:
            self.clear()
        n = self.matcher.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


_BUILT: dict = {}


def _matcher(shared) -> Matcher:
    """Built once in each Python worker."""
    mark, pieces = shared.value
    key = (mark, len(pieces), hash(tuple(pieces)))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(mark, pieces)
    return _BUILT[key]


def _count(shared):
    def run(batches):
        counts = _Counts(_matcher(shared))
        for batch in batches:
            n_words, n_tokens, longest = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, data in enumerate(utf8_rows(batch.column("text"))):
                for words in word_runs(data or b""):
                    if words:
                        each = list(map(counts.__getitem__, words))
                        n_words[i] += len(words)
                        n_tokens[i] += sum(each)
                        longest[i] = max(longest[i], max(each))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, (n_words, n_tokens, longest))],
                                             names=["row", "n_words", "n_tokens", "max_word_tokens"])
    return run


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, n_words, n_tokens, max_word_tokens) of every row; ``row`` is a struct of the columns
    of ``docs`` but the text."""
    rest = [F.col(c) for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(spark, vocabulary))
    return rows.mapInArrow(_count(shared), f"row {kind}, n_words bigint, n_tokens bigint, max_word_tokens bigint")
