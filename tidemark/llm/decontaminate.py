"""Benchmark decontamination over windows of each item's size.

Texts and items are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and into shingles of five
words (items with fewer: the whole item). The weighted shingle similarity sums, over shingles, the
smaller and the larger count, and a window is a hit at LEAST or more. Of k shingles of a window and
m of an item such a hit shares LEAST * (k + m) / (1 + LEAST) or more, so every window start that has
as many shared shingles is compared exactly, whether a shingle stands at the item's offset or not.
Fingerprints are reported, and don't decide: within() gives the items of a radius.

Items are taken in blocks of at most ITEM_BYTES of text, one pass over the documents for each,
so what is broadcast is bounded; documents are not shuffled. Null and empty texts and items
have no hits. Items that repeat are separate items. Null ids are kept in the result."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import superkmer as S
from tidemark.llm.common import LOWER, mix, row_blocks, text_buffer, trimmed, word_array, word_spans
from tidemark.llm.simhash import bit_counts, majority

SHINGLE, LEAST, BLOCK_BYTES, ITEM_BYTES = 5, 0.8, 2 << 20, 16 << 20
_NEAR = [np.array([x for x in range(256) if x.bit_count() <= r]) for r in range(9)]


def _hashes(data: np.ndarray, off: np.ndarray):
    """First words of rows, and hashes of all shingles of 1 to 5 words by size."""
    start, end, first, mask = word_spans(data, off)
    coded = word_array(LOWER[data], start, end, mask).dictionary_encode()
    one = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    tokens = one[coded.indices.to_numpy()] if len(start) else one
    up, down = S.powers(len(tokens) + 1)
    total = S.prefix(tokens, up[: len(tokens)])
    return first, lambda size: mix(S.rolling(total, size, down))


def simhash(h: np.ndarray) -> int:
    return majority(bit_counts(h), len(h))


class Items:
    """Items of a block, ready to be searched for."""

    def __init__(self, ids: list, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        first, hashes = _hashes(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
        self.ids, self.words = ids, np.diff(first)
        self.shingles, self.counts, prints = [], [], []
        places: dict[int, dict[int, list]] = {}
        for i, n in enumerate(self.words.tolist()):
            size = min(n, SHINGLE)
            h = hashes(size)[first[i] : first[i] + n - size + 1] if n else np.zeros(0, np.uint64)
            self.shingles.append(size)
            self.counts.append(Counter(h.tolist()))
            prints.append(simhash(h) if n else 0)
            for o, x in enumerate(h.tolist()):
                places.setdefault(size, {}).setdefault(x, []).append((i, o))
        self.places = places
        self.known = {size: np.array(sorted(p), np.uint64) for size, p in places.items()}
        self.bits = {}
        for size, h in self.known.items():
            self.bits[size] = np.zeros(1 << 20, bool)
            self.bits[size][(h >> np.uint64(44)).astype(np.int64)] = True
        self.prints = np.array(prints, np.uint64)
        self.blocks = []
        for b in range(8):
            part = ((self.prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            at: list[list[int]] = [[] for _ in range(256)]
            for i, x in enumerate(part.tolist()):
                at[x].append(i)
            self.blocks.append(at)

    def within(self, fp: int, radius: int) -> list[int]:
        """All items whose fingerprints differ from fp in radius bits or fewer."""
        found: set[int] = set()
        for b, at in enumerate(self.blocks):
            part = fp >> 8 * b & 255
            for x in (_NEAR[radius // 8] ^ part).tolist():
                found.update(at[x])
        return [i for i in sorted(found) if (int(self.prints[i]) ^ fp).bit_count() <= radius]

    def hits(self, data: np.ndarray, off: np.ndarray, least: float = LEAST):
        """(row, item, first word, words, differing bits, similarity): the best window of each item."""
        first, hashes = _hashes(data, off)
        best: dict[tuple[int, int], tuple] = {}
        for size, known in self.known.items():
            h = hashes(size)
            maybe = np.flatnonzero(self.bits[size][(h >> np.uint64(44)).astype(np.int64)])
            at = maybe[known[np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)] == h[maybe]]
            row = np.searchsorted(first, at, "right") - 1
            ok = at + size <= first[row + 1]
            shared: dict[tuple[int, int], list[int]] = {}
            for p, r, x in zip(at[ok].tolist(), row[ok].tolist(), h[at[ok]].tolist(), strict=True):
                for i in dict.fromkeys(i for i, _ in self.places[size][x]):
                    shared.setdefault((r, i), []).append(p)
            for (r, i), places in shared.items():
                lo, hi, m = int(first[r]), int(first[r + 1]), int(self.words[i]) - size + 1
                n = min(int(self.words[i]), hi - lo)
                k = n - size + 1
                need = max(1, math.ceil(least * (k + m) / (1 + least) - 1e-9))
                done = lo - 1
                for j in range(len(places) - need + 1):
                    # the starts whose windows hold these shared shingles
                    for a in range(max(done + 1, lo, places[j + need - 1] - k + 1), min(places[j], hi - n) + 1):
                        done = a
                        own = h[a : a + k]
                        both = sum((Counter(own.tolist()) & self.counts[i]).values())
                        alike = both / (k + m - both)
                        if alike >= least and ((r, i) not in best or (alike, lo - a) > best[r, i][:2]):
                            best[r, i] = (alike, lo - a, n, (int(self.prints[i]) ^ simhash(own)).bit_count())
        return [(r, self.ids[i], -a, n, bits, alike) for (r, i), (alike, a, n, bits) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Items in blocks of at most ITEM_BYTES of text or one item."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text")).where(F.length("text") > 0)
    ids, texts, held = [], [], 0
    for r in rows.toLocalIterator():
        if held and held + len(r.text) > ITEM_BYTES:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r.id)
        texts.append(bytes(r.text))
        held += len(r.text)
    if ids:
        yield Items(ids, texts)


def _rows(items, col):
    data, off = text_buffer(col)
    for a, b in row_blocks(off, BLOCK_BYTES):
        for r, *hit in items.hits(data[off[a] : off[b]], off[a : b + 1] - off[a]):
            yield a + r, *hit


SCHEMA = "doc_id long, item_id long, first_word int, n_words int, hamming int, similarity double"


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, hamming, similarity: a row for each row of df and item
    of which it has a window, with the most similar window (ties: the first)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for items in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches, sent=sent):
            for batch in batches:
                got = list(_rows(sent.value, batch.column(1)))
                cols = list(zip(*got, strict=True)) if got else [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["doc_id", "item_id", "first_word", "n_words", "hamming", "similarity"])

        out = out.union(rows.mapInArrow(trimmed(scan), SCHEMA))
    return out


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that have no window of an item, with all their columns."""
    spark, at = df.sparkSession, df.columns.index(text_col)
    for items in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def scan(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in _rows(sent.value, batch.column(at).cast(pa.string()))]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(trimmed(scan), df.schema)
    return df
