"""Vector best-fit packing of tokenised documents into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Pieces of one length are alike in all three, so the packing is planned over the table of counts
by length (at most one row for each length up to the capacity, however large the corpus): lengths
go from long to short, each piece into the open bin that keeps the smallest weighted norm of
what is left, among those with room in every capacity. Bins that hold the same lengths are
planned together as one group with a count, so the plan has a few rows for each length.
A piece finds its bin by its number among the pieces of its length.

Null and empty texts have the end token only. Rows that repeat are packed like any other."""

from __future__ import annotations

import functools
import itertools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, numbered, row_blocks, text_buffer, trimmed, with_row, word_array, word_spans

TOKENS, END = 4096, 1
BLOCK_BYTES = 4 << 20
WORDS_EACH = 1 << 19
#: Pieces that the query allows in a sequence, and attention cost: neither binds below TOKENS.
DOCUMENTS, ATTENTION = 4096, 4096 * 4096
WEIGHTS = (1.0, 0.05, 0.05)


class WordTokens:
    """Token ids of words, for a tokenizer that drops white space and starts anew after it.

    Words of Latin letters, digits and marks are cut by the tokenizer's own pattern and given to
    its model, many at a time; others go through the whole tokenizer. Words are remembered, up to
    LIMIT of them and those of a block."""

    LIMIT, GROUP = 300_000, 10_000
    # fixed values: the tokenizer file's pattern
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.find = regex.compile(rf"\n|{self.PATTERN}").findall
        self.plain = regex.compile("[!-~¡-ɏ]+").fullmatch
        # lines with other characters, or with what could begin a special token
        self.odd = regex.compile(r"(?m)^[^\n]*(?:[^\n!-~¡-ɏ]|<\|)[^\n]*$").findall
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table, extra = {}, itertools.count(256)
        for b in range(256):
            table[b] = b if b in kept else next(extra)
        self.bytes = table
        self.line, self.model = chr(table[10]), self.whole.model
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn_parts(self, parts: list[str]) -> None:
        """Ids of pre-tokens: the same for words that differ in case or marks."""
        if len(self.parts) > self.LIMIT:
            self.parts.clear()
        tokenize = self.model.tokenize
        new = [p for p in dict.fromkeys(parts) if p != "\n" and p not in self.parts]
        for a in range(0, len(new), self.GROUP):
            some = new[a : a + self.GROUP]
            coded = "\n".join(some).encode().decode("latin-1").translate(self.bytes).split(self.line)
            ids, at = [], [0]
            for x in coded:
                ids += [t.id for t in tokenize(x)]
                at.append(4 * len(ids))
            ids = np.array(ids, "<u4").tobytes()
            self.parts.update(zip(some, (ids[i:j] for i, j in itertools.pairwise(at)), strict=True))

    def learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        if odd := {w.encode() for w in self.odd(text)}:
            plain = [w for w in words if w not in odd]
            for w in odd:
                normal = unicodedata.normalize("NFC", w.decode())
                if "<|" not in normal and self.plain(normal):
                    found = self.find(normal.lower())
                    self.learn_parts(found)
                    self.known[w] = b"".join([self.parts[p] for p in found])
                else:
                    self.known[w] = np.array(self.whole.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            words, text = plain, b"\n".join(plain).decode()
        if not words:
            return
        found = self.find(text.lower())
        self.learn_parts(found)
        parts, ids, at = self.parts, [], iter(words)
        for p in found:
            if p == "\n":
                self.known[next(at)] = b"".join(ids)
                ids = []
            else:
                ids.append(parts[p])
        self.known[next(at)] = b"".join(ids)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        return [self.known[w] for w in words]


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def joined(ids: list[bytes], order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of rows of words, each row followed by END, and where each row ends.

    ids are the distinct words' tokens, order the words' numbers, first each row's first word."""
    flat = np.frombuffer(b"".join([*ids, END.to_bytes(4, "little")]), "<u4")
    size = np.array([*map(len, ids), 4], np.int64) // 4
    begin = np.cumsum(size) - size
    order = np.insert(order.astype(np.int64), first[1:], len(ids))
    stop = np.cumsum(size[order])
    out = np.empty(int(stop[-1]) if len(stop) else 0, "<u4")
    for a in range(0, len(order), WORDS_EACH):  # the indices of a very long text come in parts
        some, till = order[a : a + WORDS_EACH], stop[a : a + WORDS_EACH]
        lo, hi = int(till[0] - size[some[0]]), int(till[-1])
        out[lo:hi] = flat[np.repeat(begin[some] - till + size[some], size[some]) + np.arange(lo, hi)]
    return out, stop[first[1:] + np.arange(len(first) - 1)]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each document's pieces of capacity tokens."""

    def scan(batches):
        coder = _tokens(tokenizer)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for a, b in row_blocks(off, BLOCK_BYTES):
                start, end, first, mask = word_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
                coded = word_array(data[off[a] : off[b]], start, end, mask).dictionary_encode()
                tokens, end = joined(coder.encode(coded.dictionary.to_pylist()), coded.indices.to_numpy(), first)
                n = np.diff(end, prepend=0)
                many = -(-n // capacity)
                row = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                at, length = piece * capacity, np.minimum(n[row] - piece * capacity, capacity)
                lo = (end - n)[row] + at
                crc = [zlib.crc32(tokens[i:j]) for i, j in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                cols = (pa.array(piece.astype(np.int32)), pa.array(at), pa.array(length), pa.array(crc, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + row)), *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scan), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int, documents: int, attention: int, weights: tuple[float, float, float]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, bin, offset): pieces number low to high - 1 of a length go to the bins
    from bin on, one to each, at offset."""
    for n in counts:
        if n > capacity or n * n > attention:
            raise ValueError(f"a piece of {n} tokens fits no sequence")
    full = np.array([capacity, documents, attention], float)
    left, size, begin = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, bins, lengths = [], 0, sorted(counts, reverse=True)
    for k, n in enumerate(lengths):
        need, todo, done = np.array([n, 1, n * n], float), counts[n], 0
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                rest = (left[fits] - need) / full
                g = int(fits[np.argmin((rest * rest) @ np.array(weights))])
                m = min(todo, int(size[g]))
                out.append((n, done, done + m, int(begin[g]), int(capacity - left[g, 0])))
                if m < size[g]:
                    left, size, begin = np.vstack((left, left[g])), np.append(size, size[g] - m), np.append(begin, begin[g] + m)
                    size[g] = m
                left[g] -= need
                done, todo = done + m, todo - m
                continue
            each = int(min(capacity // n, documents, attention // (n * n)))
            whole, rest = divmod(todo, each)
            for held, many in ((each, whole), (rest, 1)):
                if held and many:
                    for j in range(held):
                        out.append((n, done, done + many, bins, j * n))
                        done += many
                    left, size, begin = np.vstack((left, full - held * need)), np.append(size, many), np.append(begin, bins)
                    bins += many
            todo = 0
        if k + 1 < len(lengths):
            room = left[:, 0] >= lengths[-1]
            left, size, begin = left[room], size[room], begin[room]
    return out


def pack(parts: DataFrame, capacity: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """parts (see pieces) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = materialize(with_row(parts), "pieces")
    counts = dict(parts.groupBy("length").count().collect())  # at most one row for each length
    found = plan(counts, capacity, documents, attention, weights)
    # a few rows for each length, whatever the input: small enough to broadcast
    steps = spark.createDataFrame(found, "length long, low long, high long, bin long, offset long")
    rows = numbered(parts, ["length"], "nth")
    on = (rows["length"] == steps["length"]) & (rows["nth"] >= steps["low"]) & (rows["nth"] < steps["high"])
    placed = rows.join(F.broadcast(steps), on)
    return placed.select("doc_id", "piece", "start", rows["length"], "ids_crc32", (F.col("bin") + F.col("nth") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces(df, tokenizer, id_col, text_col))
