"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space and the five control characters from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_SPACE
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Stands in for a null id inside an operator; rows are told apart by the text's hash as well.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint
    folder. Only a local session, as in tests, may do without: it gets a temporary one."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        said = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run meanwhile remove their shuffle files when they end, on all executors."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends here, a lost
    executor costs no more than the stages after it, and the shuffle files of df's plan go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote; nothing may read them afterwards."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.written_at).getParent()
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _free_memory() -> None:
    """This process gives back the memory that it has free."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=1)
def _trim_of(gateway):
    """A call by which the driver's JVM gives back its free native memory."""
    jvm = gateway.jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # the server's own class is not exported, so the interface's method is called by reflection
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args[1] = "systemTrimNativeHeap"
    args[2], args[3] = gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
    return lambda: invoke.invoke(server, args)


def give_back(spark: SparkSession) -> None:
    """The driver, its JVM and its Python, gives back the memory that it has free. Planning and
    compiling many queries takes native memory that the JVM frees but its allocator keeps, some
    160 MB after one near-dedup; a JVM without the command for it keeps it."""
    _free_memory()
    with contextlib.suppress(Py4JError, StopIteration):
        _trim_of(spark.sparkContext._gateway)()


def trimmed(scan):
    """scan for mapInArrow, whose worker gives back the memory that it has free at the end: workers
    serve later stages too, and what one stage needed would add up with what the next one does."""

    def run(batches):
        yield from scan(batches)
        _free_memory()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int | None:
    """What the planner knows of the size of df's input; None if it knows nothing."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 55 else None


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, th, tl, text: th and tl (95 bits of the text) tell rows apart that share an id, null ids
    too: of 10 ** 12 such rows, two differ and agree with a probability of 13 in a million.
    Operators whose decision depends on id and text alone give rows that agree in all three the
    same result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(text).alias("th"),
        F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tl"),
        text.alias("text"),
    )


def real_id(col: str = "did") -> Column:
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


#: Bits of a hash that tell which rows a filter lets through: 2 ** FILTER of them, in words of 64.
FILTER = 24


def may_match(df: DataFrame, keys: DataFrame, hashed: str) -> DataFrame:
    """df with _maybe: false only for rows whose hash (a long in column hashed, of 64 good bits) no
    row of the written table keys has. The filter that decides is broadcast; it has 2 ** FILTER
    bits, so 2 ** FILTER / 64 rows at most, whatever the input."""
    word = F.shiftrightunsigned(hashed, 64 - FILTER + 6).cast("int")
    bit = F.shiftrightunsigned(hashed, 64 - FILTER).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = materialize(keys.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits")), "filter")
    found = F.coalesce(F.call_function("shiftrightunsigned", "_bits", bit).bitwiseAND(F.lit(1)), F.lit(0)) == 1
    return df.join(F.broadcast(words), word == words["_word"], "left").select(*df.columns, found.alias("_maybe"))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins (one more entry than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most limit bytes, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows in data: starts, ends, and each row's first word (one more entry than
    rows); also the mask of word bytes. A word never crosses from one row into the next."""
    n = len(data)
    mask = _WORD[data]
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    first, last = mask.copy(), mask.copy()
    if n:
        first[1:] &= ~mask[:-1] | brk[1:n]
        last[:-1] &= ~mask[1:] | brk[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off), mask


def word_array(data: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array."""
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes; x is changed."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], flag.view(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def with_row(df: DataFrame) -> DataFrame:
    """df with _row, a long that no two rows share. Write the result before it is read twice."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def numbered(df: DataFrame, keys: list[str], name: str, rows_each: int = 1_000_000) -> DataFrame:
    """Add name: 0, 1, 2 ... without gaps within each value of keys. df is a written table that has
    _row (see with_row), which goes.

    A key may hold any share of the rows, and rows may be equal in all else: each key is split into
    parts by a hash of _row, parts are counted, and a row's number is its place in its part plus
    the sizes of the parts before. Keys are not null."""
    parts = max(32, -(-df.count() // rows_each))
    split = df.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    sizes = materialize(split.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    place = Window.partitionBy(*keys, "_part").orderBy("_row")
    rows = split.withColumn("_place", F.row_number().over(place) - 1)
    own = [c for c in df.columns if c != "_row"]
    return rows.join(base, [*keys, "_part"]).select(*own, (F.col("_place") + F.col("_base")).cast("long").alias(name))
