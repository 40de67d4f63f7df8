"""Links between near-duplicates: all pairs whose sets of five-word shingles are alike by LEAST or more.

A text's A-Z are lower-cased, its words ``[^\\x20\\x09-\\x0D]+`` are cut into shingles of five words
(fewer words: the whole sequence); similarity is the Jaccard similarity of the distinct ones.

SimHash fingerprints of the sets are compared first, in tiles (see simhash): those within three
bits are candidates. A similarity of 0.8 goes with about ten differing bits, a radius at which
tiles prune nothing, so fingerprints alone miss most such pairs. The rest come from an exact join.
Shingles get one order for all texts: by how often a sample of texts holds them, then by hash. Of
n shingles in that order the first n - ceil(0.8 n) + 1 are the text's prefix, and two sets with
similarity 0.8 have a shingle of their prefixes in common (the sample changes how many candidates
there are, never which pairs are found). Texts that share a prefix shingle form a bucket. Each
bucket's texts are compared with that one of them which is in most buckets. Then those that no
links connect yet are compared pair by pair, in tiles where a bucket is large, by how many shingles
of each of CLASSES hash classes they have: the smaller counts' sum bounds what two sets share, so
what it rules out is not alike. So a group of many copies costs a few comparisons each, and all
pairs that matter to the components are still tried. Every other candidate is verified by its sets.

A node is a set of shingles by a 64-bit hash (shingles are 64-bit hashes too). Null text counts as
empty; all texts without words are one node. Rows that repeat are one node. An empty table has no
links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import materialize, may_match, remove, row_blocks, shuffles_removed, text_buffer, trimmed
from tidemark.llm.decontaminate import _hashes
from tidemark.llm.simhash import components

SHINGLE, BLOCK_BYTES, SAMPLE, FREQUENT, STAR, TILE, CLASSES = 5, 2 << 20, 20_000, 200_000, 256, 1024, 256


def shingle_sets(data: np.ndarray, off: np.ndarray):
    """The distinct shingles of each row, ascending."""
    first, hashes = _hashes(data, off)
    all_of = {size: hashes(size) for size in range(1, SHINGLE + 1)}
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        size = min(SHINGLE, b - a)
        yield np.unique(all_of[size][a : b - size + 1]) if size else np.zeros(0, np.uint64)


def prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles by which a set is found: rare ones first."""
    n = len(own)
    if not n:
        return own
    at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
    weight = np.where(frequent[at] == own, rank[at], 0) if len(frequent) else np.zeros(n, np.int64)
    return own[np.lexsort((own, weight))[: n - (4 * n + 4) // 5 + 1]]


def _rows(col: pa.Array):
    data, off = text_buffer(col)
    for a, b in row_blocks(off, BLOCK_BYTES):
        yield from shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of texts holds most often, ascending, and how often."""

    def scan(batches):
        for batch in batches:
            got = list(_rows(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64) if got else [], pa.int64())], ["x"])

    every = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod("_h1", F.lit(every)) == 0).dropDuplicates(["_h1", "_h2"]).select("text").mapInArrow(trimmed(scan), "x long")
    with shuffles_removed(rows.sparkSession):
        got = some.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow()
    x, n = got.column("x").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], n[order]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _parts(batches):
    """Batches of at most 1000 rows, with the sets of the texts in their first column."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            yield part, list(_rows(part.column(0)))


def classes(own: np.ndarray) -> bytes:
    """How many shingles of a set each of CLASSES hash classes has, as 32-bit numbers."""
    return np.bincount((own >> np.uint64(20)).astype(np.int64) % CLASSES, minlength=CLASSES).astype("<u4").tobytes()


def shingled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys (longs), node, fp (the set's fingerprint), n (its size), classes and prefix: one row for
    each row of rows, which has text."""
    sent = rows.sparkSession.sparkContext.broadcast(_frequent(rows))

    def scan(batches):
        frequent, rank = sent.value
        for part, own in _parts(batches):
            fp = [simhash.majority(simhash.bit_counts(s), len(s)) for s in own]
            n = pa.array([len(s) for s in own], pa.int64())
            first = _lists([prefix(s, frequent, rank) for s in own])
            count = pa.array([classes(s) for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], _longs([_node(s) for s in own]), _longs(fp), n, count, first], [*keys, "node", "fp", "n", "classes", "prefix"])

    schema = ", ".join(f"{c} long" for c in (*keys, "node", "fp", "n")) + ", classes binary, prefix array<long>"
    return rows.select(F.col("text").cast("string").alias("text"), *keys).mapInArrow(trimmed(scan), schema)


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own: the sets of the nodes in the written table wanted. They are made again from the
    texts: stored for all rows they would take twice the room of the texts."""

    def scan(batches):
        for _, own in _parts(batches):
            yield pa.RecordBatch.from_arrays([_longs([_node(s) for s in own]), _lists(own)], ["node", "own"])

    every = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(scan), "node long, own array<long>")
    some = may_match(every, wanted, "node").where("_maybe").select("node", "own")
    return some.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """_verified, given the sets. One a may be in any number of pairs."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("k")).where("k > 1")
    left = sets.join(many.withColumnRenamed("a", "node"), "node", "left").select(F.col("node").alias("a"), F.col("own").alias("left"), F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("salt"))
    salted = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1))).cast("int").alias("salt"))
    both = salted.join(left, ["a", "salt"]).join(sets.select(F.col("node").alias("b"), F.col("own").alias("right")), "b")
    alike = 9 * F.size(F.array_intersect("left", "right")) >= 4 * (F.size("left") + F.size("right"))
    return materialize(both.where(alike).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """u > v: those of the written pairs (a, b) that are alike."""
    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    sets = materialize(_sets(rows, wanted), "sets")
    found = _linked(pairs, sets)
    remove(wanted, sets)
    return found


def _sizes_fit(a: str, b: str):
    return (5 * F.least(a, b)) >= (4 * F.greatest(a, b))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates a, b: nodes with one fingerprint (a star for each), and the first nodes of
    fingerprints that the tiled comparison links."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("a")), "prints")
    same = nodes.join(first, "fp").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    linked = simhash.links(first.select("fp"))
    end = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("a").alias(name))
    return same.unionByName(linked.join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, times, node, n: nodes that share a shingle of their prefixes. Near copies share many,
    so shingles with one set of nodes are one bucket, named by one of them, and times counts them.
    Sets of nodes are told apart by their size and 128 bits, so no shingle's nodes are gathered."""
    mark = [F.bit_xor(h).alias(name) for name, h in (("h1", F.xxhash64("node")), ("h2", F.xxhash64(F.lit(1), "node")))]
    tokens = nodes.select("node", "n", F.explode("prefix").alias("x"))
    shared = materialize(tokens.groupBy("x").agg(F.count(F.lit(1)).alias("size"), *mark).where("size > 1"), "shared")
    named = shared.groupBy("size", "h1", "h2").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("times")).select("x", "size", "times")
    each = materialize(tokens.join(named, "x").select(F.col("x").alias("bucket"), "times", "node", "n", "size"), "each")
    remove(shared)
    return each


def links(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Edges (u > v) between nodes that connect what is alike; own is shingled(rows), written."""
    nodes = materialize(own.select("node", "fp", "n", "classes", "prefix").dropDuplicates(["node"]), "nodes")
    each = _buckets(nodes)
    ranked = materialize(each.join(each.groupBy("node").agg(F.sum("times").alias("found")), "node"), "ranked")
    middle = ranked.groupBy("bucket").agg(F.max(F.struct("found", "node", "n")).alias("m")).select("bucket", F.col("m.node").alias("a"), F.col("m.n").alias("an"))
    stars = ranked.join(middle, "bucket").where((F.col("node") != F.col("a")) & _sizes_fit("n", "an")).select("a", F.col("node").alias("b"))
    tried = materialize(stars.unionByName(_by_fingerprint(nodes)).distinct(), "tried")
    remove(ranked)
    kept = materialize(_bounded(tried, nodes), "kept")
    first = _verified(kept, rows)
    remove(kept)
    roots = components(first)
    part = each.join(roots, each["node"] == roots["u"], "left").select("bucket", "size", "node", F.coalesce("root", "node").alias("root"))
    part = materialize(part, "part")
    open_ = part.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    before = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = materialize(_possible(part.join(open_, "bucket", "left_semi"), nodes).join(before, ["a", "b"], "left_anti"), "rest")
    remove(nodes, each, part, tried)
    out = first.union(_verified(rest, rows))
    remove(rest)
    return out


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that their sizes and the counts of their classes don't rule out."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("classes").alias(f"c{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "na", "nb", "ca", "cb")

    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                na, nb = (part.column(j).to_numpy() for j in (2, 3))
                ca, cb = (np.frombuffer(b"".join(part.column(j).to_pylist()), "<u4").reshape(-1, CLASSES) for j in (4, 5))
                ok = 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)
                ok &= 9 * np.minimum(ca, cb).sum(axis=1, dtype=np.int64) >= 4 * (na + nb)
                yield pa.RecordBatch.from_arrays([part.column(j).filter(pa.array(ok)) for j in (0, 1)], ["a", "b"])

    return both.mapInArrow(trimmed(compare), "a long, b long")


def may_be_alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which sets of a could be alike to which of b, by their sizes and the counts of their classes."""
    ok = 5 * np.minimum(na[:, None], nb) >= 4 * np.maximum(na[:, None], nb)
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        at = np.flatnonzero(ok[i])
        ok[i, at] = 9 * np.minimum(a[i], b[at]).sum(axis=1, dtype=np.int64) >= 4 * (na[i] + nb[at])
    return ok


def _possible(part: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a > b of a bucket's nodes, of different roots, that may be alike. Nodes are compared
    tile by tile: each tile goes to its pairs with all tiles of its bucket, itself included."""
    dealt = part.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    sent = dealt.select("bucket", "tile", "node", "root", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    sent = sent.select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), (F.col("tile") > F.col("other")).alias("right"), "node", "root")
    full = sent.join(nodes.select("node", "n", "classes"), "node")
    full = full.groupBy("bucket", "lo", "hi").agg(F.collect_list(F.struct("right", "node", "root", "n", "classes")).alias("e")).select("e", (F.col("lo") == F.col("hi")).alias("same"))

    def compare(batches):
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                e, same = batch.column(0).slice(i, 1).flatten(), batch.column(1)[i].as_py()
                right, node, root, n = (e.field(j).to_numpy(zero_copy_only=False) for j in range(4))
                count = np.frombuffer(b"".join(e.field(4).to_pylist()), "<u4").reshape(-1, CLASSES)
                a, b = np.flatnonzero(~right), np.flatnonzero(right)
                if same:
                    b = a
                ok = may_be_alike(count[a], count[b], n[a], n[b]) & (root[a][:, None] != root[b])
                x, y = np.nonzero(np.triu(ok, 1) if same else ok)
                us.append(np.maximum(node[a][x], node[b][y]))
                vs.append(np.minimum(node[a][x], node[b][y]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["a", "b"])

    return full.mapInArrow(trimmed(compare), "a long, b long").distinct()
