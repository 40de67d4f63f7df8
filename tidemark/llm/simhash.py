"""SimHash near-duplicates by tiled exact comparison.

A text's A-Z are lower-cased, its words ``[^\\x20\\x09-\\x0D]+`` are joined by one space and cut into
shingles of three words, repeats included (fewer words: the whole sequence). A fingerprint bit is
1 if it is set in over half of the shingles' XXH64 (UTF-8, seed 42); no words: fingerprint zero.

Fingerprints link at RADIUS differing bits or fewer. Distinct fingerprints are dealt into cells by
the population counts of their four 16-bit parts, and cells into tiles. Two fingerprints within
the radius have part counts that differ by no more than it in all, so only tiles of such cells
are compared: with exclusive-or and bit counts over whole tiles. A pair of tiles passes on a
spanning forest of its links, never all pairs of a group. Components come from alternating
star contraction over written tables.

Null text counts as empty; null ids link like any other, but a component's id is its smallest
id that is not null. Rows that repeat are rows like any other. Other columns are ignored."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, remove, text_buffer, trimmed

SHINGLE, RADIUS, SEED, TILE, FEW, PIECE = 3, 3, 42, 2048, 256, 1 << 20
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACE = re.compile(rb"[ \t-\r]")


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, the highest bit first."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def majority(ones: np.ndarray, n: int) -> int:
    """The value whose bits are those that more than half of n values have."""
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _word_pieces(text: bytes):
    """Lists of words, which begin anew after about PIECE bytes."""
    at = 0
    while at < len(text):
        stop = _SPACE.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        yield text[at:end].translate(_LOWER).split()
        at = end


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    xxh, ones, n, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in _word_pieces(text):
        held += words
        if len(held) < size:
            continue
        joined = b" ".join(held)
        end = list(itertools.accumulate((len(w) + 1 for w in held), initial=0))
        h = np.array([xxh(joined[a : b - 1], SEED) for a, b in zip(end, end[size:], strict=False)], np.uint64)
        ones, n = ones + bit_counts(h), n + len(h)
        held = held[len(held) - size + 1 :]
    if n:
        return majority(ones, n)
    return majority(bit_counts(np.array([xxh(b" ".join(held), SEED)], np.uint64)), 1) if held else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the columns keep, which are longs."""

    def scan(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            raw, off = data.tobytes(), off.tolist()
            fp = np.array([fingerprint(raw[a:b], size) for a, b in zip(off, off[1:], strict=False)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keep])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return rows.mapInArrow(trimmed(scan), ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


_SPAN = 24  # a part's count is 0 to 16; neighbours reach 3 below and above


def _near(radius: int) -> list[int]:
    """Steps between cells whose part counts differ by radius or less in all; one of each pair."""
    steps = (d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius)
    codes = (((a * _SPAN + b) * _SPAN + c) * _SPAN + d for a, b, c, d in steps)
    return sorted(x for x in codes if x >= 0)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles: all of them if they are few, else a spanning forest."""
    return spanning(a, b, np.bitwise_count(a[:, None] ^ b[None, :]) <= radius, same)


def spanning(a: np.ndarray, b: np.ndarray, near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links where near is set: all of them if they are few, else a spanning forest. near is changed."""
    if same:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    top = len(a) + len(b)
    at_a, at_b = np.arange(len(a)), np.arange(len(b)) if same else np.arange(len(a), top)
    values = a if same else np.concatenate((a, b))
    while True:
        new_b = np.minimum(at_b, np.where(near, at_a[:, None], top).min(axis=0))
        new_a = np.minimum(at_a, np.where(near, new_b[None, :], top).min(axis=1))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == at_a).all() and (new_b == at_b).all():
            break
        at_a, at_b = new_a, new_b
    label = at_a if same else np.concatenate((at_a, at_b))
    return values, values[label]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u > v) between values of fp that connect what lies within radius of each other."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    cell = F.lit(0)
    for shift in (48, 32, 16, 0):
        cell = cell * _SPAN + 3 + F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFF)))
    rows = distinct.select("fp", cell.alias("cell"))
    # at most 17 ** 4 cells, so what there is one row for each may be broadcast
    cells = materialize(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "cells")
    dealt = rows.join(F.broadcast(cells), "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"), "fp")
    tiles = materialize(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = cells.select(F.col("cell").alias("own"), F.col("tiles").alias("own_tiles"), F.explode(F.array(*map(F.lit, _near(radius)))).alias("step"))
    near = near.withColumn("cell", F.col("own") + F.col("step")).join(F.broadcast(cells), "cell")
    # a tile that meets many others is there in several copies, for FEW of them each
    copies = near.groupBy("cell").agg(F.ceil(F.sum("own_tiles") / FEW).cast("int").alias("copies"))
    right = tiles.join(F.broadcast(copies), "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    left = near.select("own", F.explode(F.sequence(F.lit(0), F.col("own_tiles") - 1)).alias("own_tile"), "cell", "tiles", "step")
    left = left.join(tiles.select(F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.col("fps").alias("own_fps")), ["own", "own_tile"])
    left = left.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where((F.col("step") != 0) | (F.col("own_tile") <= F.col("tile")))
    left = left.join(F.broadcast(copies), "cell").withColumn("copy", F.pmod(F.xxhash64("own", "own_tile"), F.col("copies")).cast("int"))
    pairs = left.join(right.select("cell", "tile", "copy", "fps"), ["cell", "tile", "copy"])
    pairs = pairs.select("own_fps", "fps", ((F.col("step") == 0) & (F.col("own_tile") == F.col("tile"))).alias("same"))

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            sides = []
            for k in (0, 1):
                col = batch.column(k)
                sides.append((col.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(col.value_lengths().to_numpy()))).tolist()))
            (a, ao), (b, bo) = sides
            for i, same in enumerate(batch.column(2).to_pylist()):
                u, v = forest(a[ao[i] : ao[i + 1]], b[bo[i] : bo[i + 1]], radius, same)
                if len(u):
                    us.append(u.view(np.int64))
                    vs.append(v.view(np.int64))
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                u, v, ok = np.maximum(u, v), np.minimum(u, v), u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], ["u", "v"])

    return pairs.mapInArrow(trimmed(compare), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root: for each node of edges (u > v) that isn't its component's smallest node."""
    edges, said = materialize(edges, "edges"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == said:
            return edges.select("u", F.col("v").alias("root"))
        said = now


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of df."""
    fps = materialize(fingerprints(df, id_col, text_col, size), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, radius))
    nodes = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = materialize(nodes, "nodes")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
