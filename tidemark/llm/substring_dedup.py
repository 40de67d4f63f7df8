"""Repeated word windows, by super-k-mer partitioning.

Each text is read as words ``[^\\x20\\x09-\\x0D]+``. A window is k consecutive words of one row;
every word that lies in a window whose words also start anywhere else is removed, and windows
are judged on the input. Windows reach their minimiser's bucket as packed strings of text;
sorting the bucket's windows counts them. Hashes only bring equal windows together: words are
compared as whole byte strings before anything is removed.

A hot passage doesn't make a hot bucket: each task first settles the windows that repeat among
its own rows and passes one copy of each on, so a bucket gets a window at most once from each
block of rows, however many rows share it.

Null text counts as empty; an empty text has no words, and its kept text is empty. Rows that
repeat, with one id or several, are separate rows: their windows repeat. Other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm import superkmer as S
from tidemark.llm.common import keyed, real_id, text_buffer, word_array, word_spans

WINDOW, MINIMISER = 35, 8
BLOCK_BYTES = 2 << 20


def _tokens(data: np.ndarray, off: np.ndarray):
    """Word spans, exact word ids within data, and word hashes."""
    start, end, first, mask = word_spans(data, off)
    coded = word_array(data, start, end, mask).dictionary_encode()
    ids = coded.indices.to_numpy()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return start, end, first, ids, hashes[ids] if len(ids) else np.zeros(0, np.uint64)


def _equal(ids: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    ok = np.ones(len(a), bool)
    for j in range(k):
        ok &= ids[a + j] == ids[b + j]
    return ok


def _twice(ids: np.ndarray, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over at: windows that occur again, and those of them that are not the first."""
    again, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    which = S.repeated(h)
    if len(which):
        head = S.group_heads(h[which])
        ok = _equal(ids, at[which], at[which[head]], k)
        if not ok.all():  # a hash met two different windows: sort those out by their words
            seen: dict = {}
            for i in np.flatnonzero(np.isin(head, head[~ok])).tolist():
                w = ids[at[which[i]] : at[which[i]] + k].tobytes()
                if w in seen:
                    again[which[[seen[w], i]]] = later[which[i]] = True
                seen.setdefault(w, i)
            keep = ~np.isin(head, head[~ok])
            which, head = which[keep], head[keep]
            head = S.group_heads(h[which])
        again[which] = True
        later[which[head != np.arange(len(which))]] = True
    return again, later


def removed_ranges(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """did, th, tl, lo, hi: word ranges to remove from rows of common.keyed; ranges may overlap."""

    def block(packer, row, data, off, hot):
        start, end, first, ids, wh = _tokens(data, off)
        at, h, least = S.windows(wh, first, k, m)
        if not len(at):
            return
        again, later = _twice(ids, at, h, k)
        if again.any():
            own, lo, hi = S.row_ranges(S.covered(len(ids), at[again], at[again] + k), first)
            packer.add_ranges(tuple(c[own] for c in row), lo, hi)
        at, least = at[~later], S.spread(h[~later], least[~later], hot)
        head, count = S.cut(at, least)
        a, b = at[head], at[head] + count + k - 2
        own = np.searchsorted(first, a, "right") - 1
        packer.add(least[head], tuple(c[own] for c in row), a - first[own], count, data.tobytes(), start[a], end[b])

    def bucket(did, th, tl, begin, count, length, text):
        off = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=off[1:])
        _, _, first, ids, wh = _tokens(np.frombuffer(text, np.uint8), off)
        at, h, _ = S.windows(wh, first, k, None)
        again, _ = _twice(ids, at, h, k)
        row, lo, hi = S.row_ranges(S.covered(len(ids), at[again], at[again] + k), first)
        return did[row], th[row], tl[row], begin[row] + lo, begin[row] + hi

    return S.removal_ranges(docs, block, bucket, BLOCK_BYTES)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row for each row of df."""
    docs = keyed(df, id_col, text_col)

    def apply(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            n, gone, sha, kept = [], [], [], []
            for i, r in enumerate(batch.column(2)):
                words = bytes(data[off[i] : off[i + 1]]).translate(_TO_SPACE).split(b" ")
                words = [w for w in words if w]
                n.append(len(words))
                if r.is_valid:
                    lo, hi = (r.values.field(j).to_numpy() for j in (0, 1))
                    mask = S.covered(len(words), lo, hi)
                    words = [w for w, out in zip(words, mask.tolist(), strict=True) if not out]
                text = b" ".join(words)
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["did", "n_words", "n_removed", "kept_sha256", "kept_text"])

    rows = S.with_ranges(docs, removed_ranges(docs, k, m), apply, "did long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return rows.select(real_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")


_TO_SPACE = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in range(256))
