"""The driver gives back memory that it has used, and fits in little of it."""

import tracemalloc
from pathlib import Path

import numpy as np


def _mb(pid: int) -> float:
    lines = Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines()
    return next(int(x.split()[1]) for x in lines if x.startswith("Anonymous:")) / 1024


def test_native_memory_goes_when_a_table_is_written(spark):
    from tidemark.llm.common import materialize

    jvm = spark._jvm
    pid, memory = jvm.java.lang.ProcessHandle.current().pid(), jvm.org.apache.spark.unsafe.Platform
    materialize(spark.range(1), "before")
    before = _mb(pid)
    at = [memory.allocateMemory(65_000) for _ in range(5000)]
    for a in at:
        memory.setMemory(a, 1, 65_000)
    used = _mb(pid)
    for a in at[:-1]:  # the last keeps the allocator from giving back what lies below it
        memory.freeMemory(a)
    kept = _mb(pid)
    materialize(spark.range(1), "after")
    after = _mb(pid)
    memory.freeMemory(at[-1])
    assert used - before > 250 and used - kept < 50, (before, used, kept)
    assert kept - after > 120, (kept, after)


def test_fit_takes_little_memory():
    from tidemark.llm.quality import BITS, fit

    rng = np.random.default_rng(1)
    grade, size = rng.integers(0, 3, 8000), rng.integers(0, 600, 8000)
    off = np.concatenate(([0], np.cumsum(size)))
    # numbers of common features and of rare ones, some of which go with the grade
    f = np.minimum(rng.pareto(0.6, off[-1]) * 20, 30_000).astype(np.int32) * 7 + np.repeat(grade, size).astype(np.int32)
    tracemalloc.start()
    weights, cuts = fit(f, off, grade, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(weights) == 1 << BITS and (weights != 0).any() and (np.diff(cuts) > 0).all()
    assert peak < 36 * len(f), peak / len(f)
