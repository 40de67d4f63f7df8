"""Byte strings that an earlier document has too, by suffix arrays over super-k-mer buckets.

Each text is UTF-8 bytes; matches never cross rows. A byte is removed if it lies in a k-byte
string that also starts in a row with a smaller id, judged on the input. Windows of k bytes
reach their minimiser's bucket as packed strings; there an enhanced suffix array (suffixes in
order, with the length that neighbours share) is built over the suffixes that can begin a
maximal repeat, and a stack scan turns it into the tree of common-prefix intervals. An interval
whose occurrences differ in the byte before them is a maximal repeat, with all its occurrences.

Only suffixes whose k-byte window occurs again enter a suffix array, so unique text costs no
sorting of suffixes. Each task first settles what its own rows show: a window passes on only
from the rows with its smallest id, so a hot passage reaches its bucket about once a block, and
only once from each row, so text that repeats itself sends one period. What a row repeats
itself shares its fate: that is settled at the end, with the whole text at hand.

Null text counts as empty. A null id is larger than any other and never the earlier one. Rows
that share an id do not remove each other's text. Other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import superkmer as S
from tidemark.llm.common import NULL_ID, keyed, mix, real_id, row_blocks, text_buffer

WINDOW, MINIMISER = 50, 12
BLOCK_BYTES = 1 << 20
_TOKEN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _rank(did: np.ndarray) -> np.ndarray:
    """Ids in the order in which the earlier one keeps its text."""
    return np.where(did == NULL_ID, np.iinfo(np.int64).max, did)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether the k bytes at a are those at b; k is 8 or more."""
    ok = np.ones(len(a), bool)
    w = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    for j in [*range(0, k - 8, 8), k - 8]:
        ok &= w[a + j] == w[b + j]
    return ok


def suffix_array(data: np.ndarray, off: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at the places at (each ends with its row), and how many
    bytes each shares with the one before it, both up to depth bytes."""
    end = off[np.searchsorted(off, at, "right")]
    length = np.minimum(end - at, depth)
    padded = np.concatenate((data, np.zeros(depth, np.uint8)))
    grid = padded[at[:, None] + np.arange(depth)]
    grid[np.arange(depth) >= length[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(grid).view(f"S{depth}").ravel(), kind="stable")
    grid, length = grid[order], length[order]
    lcp = np.zeros(len(at), np.int64)
    if len(at) > 1:
        differ = grid[1:] != grid[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(length[1:], length[:-1]))
    return order, lcp


def intervals(lcp: list[int], left: list[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats (first, last, length) of the suffix array whose neighbours share lcp bytes
    and whose suffixes follow the bytes left (distinct negative numbers where a row begins).

    The stack holds the open intervals: [shared length, first, the byte before all of its
    suffixes or None where they differ]. Shared lengths below least close everything."""
    found: list[tuple[int, int, int]] = []
    stack: list[list] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first, byte = i - 1, left[i - 1]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            byte = own if own == byte else None
            if byte is None:
                found.append((first, i - 1, length))
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            else:
                stack.append([now, first, byte])
    return found


def maximal_repeats(data: np.ndarray, off: np.ndarray, k: int):
    """For rows data[off[i]:off[i+1]]: maximal repeats of k bytes or more, as (starts, length)."""
    at, h, _ = S.windows(_TOKEN[data], off, k, None)
    which = S.repeated(h)
    if not len(which):
        return
    # a group of equal windows begins maximal repeats only if the windows before them differ
    group = np.full(len(at), -1, np.int64)
    group[which] = S.group_heads(h[which])
    before = np.full(len(which), -1, np.int64)
    inner = (which > 0) & (at[which] == at[np.maximum(which - 1, 0)] + 1)
    before[inner] = group[which[inner] - 1]
    edge = np.flatnonzero(np.concatenate(([True], group[which][1:] != group[which][:-1])))
    low, high = np.minimum.reduceat(before, edge), np.maximum.reduceat(before, edge)
    size = np.diff(np.concatenate((edge, [len(which)])))
    begin = np.sort(at[which[np.repeat((low != high) | (low < 0), size)]])
    depth = int(np.diff(off).max())
    # suffixes of one k-byte window share a run of the array, so the array may be built in slices
    per = max(1, (16 << 20) // max(1, depth))
    key = h[np.searchsorted(at, begin)]
    begin = begin[np.argsort(key, kind="stable")]
    key = np.sort(key)
    a = 0
    while a < len(begin):
        b = len(begin)
        if a + per < b:
            b = int(np.searchsorted(key, key[a + per]))
            if b <= a:
                b = int(np.searchsorted(key, key[a], "right"))
        at_slice = begin[a:b]
        order, lcp = suffix_array(data, off, at_slice, depth)
        pos = at_slice[order]
        row_start = off[np.searchsorted(off, pos, "right") - 1] == pos
        left = np.where(row_start, -1 - np.arange(len(pos)), data[np.maximum(pos - 1, 0)])
        for lo, hi, length in intervals(lcp.tolist(), left.tolist(), k):
            yield pos[lo : hi + 1], length
        a = b


def removed_ranges(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """did, th, tl, lo, hi: from lo to hi (exclusive), each place in a row of common.keyed begins a
    k-byte string that an earlier row has. Of what a row repeats, one occurrence is there at least."""

    def block(packer, key, data, off, hot):
        # very long rows go in pieces that overlap by k - 1 bytes
        if len(data) > BLOCK_BYTES and len(off) == 2:
            cuts = np.arange(0, max(1, len(data) - k + 1), BLOCK_BYTES)
            for c in cuts.tolist():
                piece = data[c : c + BLOCK_BYTES + k - 1]
                _block(packer, key, piece, np.array([0, len(piece)]), c, hot)
        else:
            _block(packer, key, data, off, 0, hot)

    def _block(packer, key, data, off, shift, hot):
        at, h, least = S.windows(_TOKEN[data], off, k, m)
        if not len(at):
            return
        emit = np.ones(len(at), bool)
        which = S.repeated(h)
        if len(which):
            row = np.searchsorted(off, at[which], "right") - 1
            ranks = _rank(key[0])
            order = np.lexsort((at[which], ranks[row], h[which]))
            which, row = which[order], row[order]
            rank, head = ranks[row], S.group_heads(h[which])
            ok = _equal(data, at[which], at[which[head]], k)
            gone = which[ok & (rank > rank[head])]
            emit[gone] = False
            inner = np.flatnonzero(ok[1:] & ok[:-1] & (head[1:] == head[:-1]) & (row[1:] == row[:-1])) + 1
            emit[which[inner]] = False
            if len(gone):
                mask = np.zeros(len(data), bool)
                mask[at[gone]] = True
                own, lo, hi = S.row_ranges(mask, off)
                packer.add_ranges(tuple(c[own] for c in key), lo + shift, hi + shift)
        at, least = at[emit], S.spread(h[emit], least[emit], hot)
        head, count = S.cut(at, least)
        a = at[head]
        row = np.searchsorted(off, a, "right") - 1
        packer.add(least[head], tuple(c[row] for c in key), a - off[row] + shift, count, data.tobytes(), a, a + count + k - 1)

    def bucket(did, th, tl, begin, count, length, text):
        off = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=off[1:])
        data, rank = np.frombuffer(text, np.uint8), _rank(did)
        los, his = [], []
        for pos, shared in maximal_repeats(data, off, k):
            who = rank[np.searchsorted(off, pos, "right") - 1]
            late = pos[who > who.min()]
            los.append(late)
            his.append(late + shared - k + 1)
        if not los:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        row, lo, hi = S.row_ranges(S.covered(len(data), np.concatenate(los), np.concatenate(his)), off)
        return did[row], th[row], tl[row], begin[row] + lo, begin[row] + hi

    return S.removal_ranges(docs, block, bucket, BLOCK_BYTES, level=6)


def removed_bytes(data: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Mask of the bytes of rows data[off[i]:off[i+1]] to remove: windows that begin in some
    [lo, hi), places in data, and those windows of the same row that equal one."""
    out = S.covered(len(data), lo, hi)
    at, h, _ = S.windows(_TOKEN[data], off, k, None)
    row = np.searchsorted(off, at, "right") - 1
    which = S.repeated(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
    if len(which):
        of, h, row = at[which], h[which], row[which]
        order = np.lexsort((~out[of], h, row))  # those that go come first
        of, h, row = of[order], h[order], row[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
        head = of[np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))]
        out[of[out[head] & _equal(data, of, head, k)]] = True
    start = np.flatnonzero(out)
    return S.covered(len(data), start, start + k)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary): one row for each row of df."""
    docs = keyed(df, id_col, text_col)

    def apply(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for a, b in row_blocks(off, BLOCK_BYTES):
                own, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                lists = batch.column(2).slice(a, b - a)
                gone = np.zeros(len(own), bool)
                some = lists.drop_null().flatten()
                if len(some):
                    row = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                    lo, hi = (some.field(j).to_numpy() + o[row] for j in (0, 1))
                    gone = removed_bytes(own, o, lo, hi, k)
                total = np.concatenate(([0], np.cumsum(gone)))
                begins = np.concatenate((gone[:1], gone[1:] & ~gone[:-1]))
                edge = o[:-1][np.diff(o) > 0]
                begins[edge] = gone[edge]
                spans = np.concatenate(([0], np.cumsum(begins)))
                kept, at = own[~gone].tobytes(), (o - total[o]).tolist()
                parts = [kept[x:y] for x, y in zip(at, at[1:], strict=False)]
                sha = [hashlib.sha256(x).hexdigest() for x in parts]
                cols = (pa.array(np.diff(o)), pa.array(np.diff(total[o])), pa.array(np.diff(spans[o])), pa.array(sha, pa.string()), pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    rows = S.with_ranges(docs, removed_ranges(docs, k, m), apply, schema)
    return rows.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
