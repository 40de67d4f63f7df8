"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a space and a word ``[^\\x20\\x09-\\x0D]+``. Its tokens are the segmentation into pieces
of a byte vocabulary with the highest sum of scores (ties: fewest tokens). The vocabulary's ranks
give the scores, by Zipf's law: a piece of rank r has log probability -ln(r + 1) - ln(H).

Distinct pre-tokens of some rows are put in order, which walks their trie in depth-first order:
the forward scores of a prefix stay on the stack and are computed once for all pre-tokens that
share it. Each pre-token's terminal count is stored, and texts only sum those counts.

Null and empty texts have no pre-tokens. Nothing is shuffled, so no key or copy can be hot."""

from __future__ import annotations

import base64
import functools
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_blocks, text_buffer, trimmed, word_array, word_spans

BLOCK_BYTES = 4 << 20


def scores(path: str) -> dict[bytes, float]:
    """Log probabilities of the pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class TrieCounter:
    """Token counts of words. Counts are remembered for up to LIMIT words."""

    LIMIT = 400_000

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.lengths = sorted({len(p) for p in pieces})
        self.known: dict[bytes, int] = {}

    def walk(self, ordered: list[bytes]) -> None:
        """Store the terminal counts of words in order."""
        get, lengths, known = self.pieces.get, self.lengths, self.known
        best, count, last = [0.0], [0], b""
        lowest = -math.inf
        for word in ordered:
            pre = b" " + word
            same = len(os.path.commonprefix((last, pre)))
            del best[same + 1 :], count[same + 1 :]
            for d in range(same + 1, len(pre) + 1):
                top, n = lowest, 0
                for size in lengths:
                    if size > d:
                        break
                    s = get(pre[d - size : d])
                    if s is not None:
                        s += best[d - size]
                        if s > top or (s == top and count[d - size] + 1 < n):
                            top, n = s, count[d - size] + 1
                best.append(top)
                count.append(n)
            known[word], last = count[-1], pre

    def counts(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        self.walk(sorted(w for w in words if w not in self.known))
        return np.fromiter((self.known[w] for w in words), np.int64, len(words))


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(scores(path))


def token_counts(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pretokens, n_tokens: one row for each row of df."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def scan(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            words, tokens = [], []
            for a, b in row_blocks(off, BLOCK_BYTES):
                start, end, first, mask = word_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
                coded = word_array(data[off[a] : off[b]], start, end, mask).dictionary_encode()
                each = counter.counts(coded.dictionary.to_pylist())
                total = np.zeros(len(start) + 1, np.int64)
                np.cumsum(each[coded.indices.to_numpy()] if len(start) else each, out=total[1:])
                words.append(np.diff(first))
                tokens.append(total[first[1:]] - total[first[:-1]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(np.concatenate([none, *words])), pa.array(np.concatenate([none, *tokens]))], ["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scan), "doc_id long, n_bytes long, n_pretokens long, n_tokens long")
