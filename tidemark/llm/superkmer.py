"""Windows of k tokens, grouped by minimiser into packed strings (super-k-mers).

The minimiser of a window is the smallest hash among its runs of m tokens. Equal windows have
equal minimisers, and neighbouring windows mostly share one, so a maximal run of windows with
one minimiser travels as a single string to the bucket that its minimiser names. Every window
of the corpus reaches exactly one bucket, and all copies of a window reach the same."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import input_bytes, materialize, may_match, mix, row_blocks, runs, shuffle_partitions, shuffles_removed, text_buffer, trimmed

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of packed strings that one bucket should hold, on average; it is settled in SUB parts.
BUCKET_BYTES, SUB = 16 << 20, 16
#: Windows in one packed string at most.
LONGEST = 64
#: Hot minimisers are counted over a sample of so many bytes, where they occur LEAST_SEEN times.
SAMPLE_BYTES, LEAST_SEEN, MOST_HOT = 16 << 20, 16, 1 << 20
#: Shuffle partitions at most; beyond, a partition holds several buckets, one after another.
MOST_PARTITIONS = 20_000


#: Powers of the base and of its inverse, as many as were needed so far.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base)
            table[0] = 1
            _POWERS[i] = np.cumprod(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(total: np.ndarray, width: int, down: np.ndarray) -> np.ndarray:
    """Hashes of all runs of width tokens, from prefix sums of hash times power; equal for equal
    runs, and not mixed."""
    if len(total) <= width:
        return np.zeros(0, np.uint64)
    got = total[width:] - total[:-width]
    got *= down[: len(total) - width]
    return got


def prefix(tokens: np.ndarray, up: np.ndarray) -> np.ndarray:
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up, out=total[1:])
    return total


def slide_min(a: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        a = np.minimum(a[:-w], a[w:])
        w *= 2
    return np.minimum(a[: len(a) - (width - w)], a[width - w :]) if w < width else a


def windows(tokens: np.ndarray, off: np.ndarray, k: int, m: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Window starts (those that stay in one row), window hashes, and minimisers unless m is None."""
    n = len(tokens)
    if n < k:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    up, down = powers(n)
    total = prefix(tokens, up)
    whole = rolling(total, k, down)
    # the first of each row's windows, and how many it has
    count = np.maximum(np.diff(off) - k + 1, 0)
    at = np.arange(count.sum()) + np.repeat(off[:-1] - np.cumsum(count) + count, count)
    # minimisers are the least by mixed hash, lest some tokens always win
    least = slide_min(mix(rolling(total, m, down)), k - m + 1)[at] if m is not None else None
    return at, whole[at], least


def repeated(h: np.ndarray) -> np.ndarray:
    """Places, sorted by hash, of those hashes that occur more than once."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << 20, bool)
    seen[(twice >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
    maybe = maybe[np.argsort(h[maybe], kind="stable")]
    hm = h[maybe]
    same = hm[1:] == hm[:-1]
    return maybe[np.concatenate((same, [False])) | np.concatenate(([False], same))]


def group_heads(h: np.ndarray) -> np.ndarray:
    """For sorted h: the index at which each entry's run of equal values begins."""
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def cut(at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where super-k-mers begin in at, and how many windows each has. In text that repeats itself
    one minimiser may hold for very long; such runs go in strings of LONGEST windows."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(at)])))
    if len(size) and size.max() > LONGEST:
        pieces = -(-size // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * LONGEST
    return first, np.diff(np.concatenate((first, [len(at)])))


def text_bytes(df: DataFrame) -> int:
    """What the planner knows of the size of df's text; where it knows nothing, the text is measured."""
    known = input_bytes(df)
    if known is None:
        known = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return known


def sizes(df: DataFrame, size: int) -> tuple[int, int]:
    """(buckets, shuffle partitions) for size bytes of text; buckets are a multiple of partitions."""
    want = max(shuffle_partitions(df.sparkSession), -(-size * 5 // BUCKET_BYTES))
    parts = min(want, MOST_PARTITIONS)
    return parts * -(-want // parts), parts


def is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of x are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def spread(whole: np.ndarray, least: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What names each window's bucket: its minimiser or, where that is hot, the window itself. So
    windows that share no more than a frequent minimiser scatter over all buckets."""
    return np.where(is_in(least, hot), whole, least) if len(hot) else least


def hot_minimisers(docs: DataFrame, size: int, map_block, block_bytes: int) -> np.ndarray:
    """Minimisers that would fill a good part of a bucket by themselves, ascending.

    Counted over the rows of a sample of about SAMPLE_BYTES, chosen by hash; MOST_HOT at most, the
    most frequent. This decides where windows meet, never which are found."""
    every = max(1, size // SAMPLE_BYTES)
    some = docs.where(F.pmod("th", F.lit(every)) == 0).select("did", "th", "tl", "text")

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            did, th, tl = (batch.column(i).to_numpy() for i in range(3))
            data, off = text_buffer(batch.column(3))
            for a, b in row_blocks(off, block_bytes):
                counter = _Counter()
                map_block(counter, (did[a:b], th[a:b], tl[a:b]), data[off[a] : off[b]], off[a : b + 1] - off[a], np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counter.totals()], ["least", "bytes", "n"])

    many = F.sum("bytes").alias("bytes"), F.sum("n").alias("n")
    got = some.mapInArrow(trimmed(scan), "least long, bytes long, n long").groupBy("least").agg(*many)
    got = got.where((F.col("bytes") * every > BUCKET_BYTES // 4) & (F.col("n") >= LEAST_SEEN))
    with shuffles_removed(docs.sparkSession):
        found = got.orderBy(F.desc("bytes"), "least").limit(MOST_HOT).select("least").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


class _Counter:
    """Takes super-k-mers as a Packer does, and keeps how much each minimiser has."""

    def __init__(self):
        self.least, self.bytes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def add(self, least, row, start, count, raw, lo, hi) -> None:
        self.least.append(least)
        self.bytes.append(hi - lo)

    def add_ranges(self, *arrays) -> None:
        """Ranges reach no bucket."""

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, at, n = np.unique(np.concatenate(self.least), return_inverse=True, return_counts=True)
        return value.view(np.int64), np.bincount(at, np.concatenate(self.bytes), len(value)).astype(np.int64), n


class Packer:
    """Collects super-k-mers and writes them out as one compressed blob for each bucket."""

    LIMIT = 16 << 20

    def __init__(self, buckets: int, parts: int, level: int = 3):
        self.buckets, self.parts, self.held, self.bytes, self.turn = buckets, parts, [], 0, 0
        self.ranges: list[tuple[np.ndarray, ...]] = []
        self.zip = zstandard.ZstdCompressor(level=level)

    def add(self, least: np.ndarray, row: tuple[np.ndarray, ...], start: np.ndarray, count: np.ndarray, raw: bytes, lo: np.ndarray, hi: np.ndarray) -> None:
        """row is (did, th, tl) of each super-k-mer."""
        strings = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        h = mix(least.copy())
        place = (h % np.uint64(self.buckets)).astype(np.int64) * SUB + (h >> np.uint64(40)).astype(np.int64) % SUB
        self.held.append((place, *row, start.astype(np.int32), count.astype(np.int16), (hi - lo - count).astype(np.int32), strings))
        self.bytes += int((hi - lo).sum()) + 72 * len(lo)

    def add_ranges(self, row: tuple[np.ndarray, ...], lo: np.ndarray, hi: np.ndarray) -> None:
        if len(lo):
            self.ranges.append((*row, lo, hi))
            self.bytes += 32 * len(lo)

    def flush(self):
        """Rows (part, bucket, n, blob); bucket -1 carries finished ranges."""
        if self.ranges:
            cols = [np.concatenate(x) for x in zip(*self.ranges, strict=True)]
            blob = b"".join(c.astype(kind).tobytes() for c, kind in zip(cols, _RANGE, strict=True))
            self.turn += 1
            yield (int(cols[0][0]) + 7919 * self.turn) % self.parts, -1, len(cols[0]), self.zip.compress(blob)
        if self.held:
            cols = [np.concatenate([x[i] for x in self.held]) for i in range(len(_STRING))]
            strings = [s for x in self.held for s in x[-1]]
            self.held = []
            order = np.argsort(cols[0], kind="stable")
            cols = [c[order] for c in cols]
            bucket_of = (cols[0] // SUB).astype(np.int32)
            cols[0] = (cols[0] % SUB).astype(np.int8)
            edge = np.flatnonzero(np.concatenate(([True], bucket_of[1:] != bucket_of[:-1], [True])))
            order = order.tolist()
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                blob = b"".join([*(c[a:b].tobytes() for c in cols), *(strings[i] for i in order[a:b])])
                bucket = int(bucket_of[a])
                yield bucket % self.parts, bucket, b - a, self.zip.compress(blob)
        self.held, self.ranges, self.bytes = [], [], 0


#: Types of a packed string's columns (part, row key, start, windows, length) and of a range's.
_STRING = (np.int8, np.int64, np.int64, np.int32, np.int32, np.int16, np.int32)
_RANGE = (np.int64, np.int64, np.int32, np.int32, np.int32)


def _columns(raw: bytes, n: int, kinds: tuple) -> tuple[list[np.ndarray], int]:
    cols, at = [], 0
    for kind in kinds:
        cols.append(np.frombuffer(raw, kind, n, at).copy())
        at += n * np.dtype(kind).itemsize
    return cols, at


def unpack(n: int, blob: bytes):
    """The parts of a bucket's blob: (part, columns, text), in order of part."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    cols, at = _columns(raw, n, _STRING)
    cols[6] = cols[6].astype(np.int64) + cols[5]  # the length came as what it has beyond the count
    ends = at + np.concatenate(([0], np.cumsum(cols[6])))
    edge = np.searchsorted(cols[0], np.arange(SUB + 1))
    for sub, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if a < b:
            yield sub, [c[a:b] for c in cols[1:]], raw[ends[a] : ends[b]]


def unpack_ranges(n: int, blob: bytes) -> list[np.ndarray]:
    return _columns(zstandard.ZstdDecompressor().decompress(blob), n, _RANGE)[0]


RANGES = "did long, th long, tl int, lo int, hi int"


def removal_ranges(docs: DataFrame, map_block, bucket_rows, block_bytes: int, level: int = 3) -> DataFrame:
    """did, th, tl, lo, hi: the token ranges to remove from each row of docs (see common.keyed).

    map_block(packer, row, data, off, hot) adds the super-k-mers of some rows, whose keys are row =
    (did, th, tl), and what it could settle among those rows. bucket_rows(did, th, tl, start, count,
    length, text) settles a bucket and returns arrays did, th, tl, lo, hi."""
    size = text_bytes(docs)
    buckets, parts = sizes(docs, size)
    sent = docs.sparkSession.sparkContext.broadcast(hot_minimisers(docs, size, map_block, block_bytes))

    def scan(batches):
        import pyarrow as pa

        packer, hot = Packer(buckets, parts, level), sent.value

        def rows():
            got = list(packer.flush())
            cols = list(zip(*got, strict=True)) if got else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["part", "bucket", "n", "blob"])

        for batch in batches:
            row = [batch.column(i).to_numpy() for i in range(3)]
            data, off = text_buffer(batch.column(3))
            for a, b in row_blocks(off, block_bytes):
                map_block(packer, tuple(c[a:b] for c in row), data[off[a] : off[b]], off[a : b + 1] - off[a], hot)
                if packer.bytes >= packer.LIMIT:
                    yield rows()
        yield rows()

    def settle(batches):
        import pyarrow as pa

        def out(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.from_numpy_dtype(kind)) for c, kind in zip(cols, _RANGE, strict=True)], ["did", "th", "tl", "lo", "hi"])

        def closed(held):
            for sub in sorted(held):
                some = held.pop(sub)
                cols = [np.concatenate(c) for c in zip(*(h[0] for h in some), strict=True)]
                yield out(*bucket_rows(*cols, b"".join(h[1] for h in some)))

        now, held = None, {}
        for batch in batches:
            for bucket, n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if bucket < 0:
                    yield out(*unpack_ranges(n, blob.as_py()))
                    continue
                if bucket != now and held:
                    yield from closed(held)
                now = bucket
                for sub, cols, text in unpack(n, blob.as_py()):
                    held.setdefault(sub, []).append((cols, text))
        yield from closed(held)

    packed = docs.select("did", "th", "tl", "text").mapInArrow(trimmed(scan), "part int, bucket int, n int, blob binary")
    dealt = packed.repartitionById(parts, packed["part"]).sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(settle), RANGES)


KEY = ["did", "th", "tl"]

def with_ranges(docs: DataFrame, ranges: DataFrame, apply, schema: str) -> DataFrame:
    """apply (a mapInArrow function that gives schema) over did, text, ranges: the rows of docs with
    the set of their (lo, hi), null where there is none.

    The ranges are written first, so that the packed strings' shuffle files go before documents
    are shuffled; and only rows that may have ranges are shuffled (see common.may_match)."""
    lists = materialize(ranges.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    marked = may_match(docs.select(*KEY, "text"), lists, "th")
    few = marked.where("_maybe").join(lists, KEY, "left").select("did", "text", "ranges")
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    rest = marked.where("not _maybe").select("did", "text", none.alias("ranges"))
    return few.mapInArrow(trimmed(apply), schema).unionAll(rest.mapInArrow(trimmed(apply), schema))


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mask of the places below n that lie in any [lo, hi)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:n], dtype=np.int32) > 0


def row_ranges(cover: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True in cover, cut at the rows' borders: row, start and end within the row."""
    lo, hi = runs(cover)
    row = np.searchsorted(off, lo, "right") - 1
    while len(bad := np.flatnonzero(hi > off[row + 1])):  # a run that goes on into the next row
        edge = off[row[bad] + 1]
        lo, hi = np.concatenate((lo, edge)), np.concatenate((hi, hi[bad]))
        hi[bad] = edge
        row = np.searchsorted(off, lo, "right") - 1
    return row, lo - off[row], hi - off[row]
