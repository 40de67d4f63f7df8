"""Window and byte dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, th string, did int, lo int"


def corpus(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4)))
    base = [" ".join(word() for _ in range(rnd.choice((20, 60, 150)))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(base) if rnd.random() < 0.3 else " ".join(word() for _ in range(rnd.randint(1, 80))) for _ in range(rnd.randint(1, 4))]
        rows.append(rnd.choice((" ", "\n", "\t ")).join(parts))
    rows += [None, "", " \n", "x", "y " * 50, "z" * 120, rows[0], rows[0], " ".join(base), "a\x00b" * 40, "a\x00b" * 30, "ab " * 3000]
    out = [(i * 3 % 101, t, "x", 1, 2) for i, t in enumerate(rows)]
    return [*out, out[5], (None, rows[3], "x", 1, 2), (out[7][0], rows[9], "x", 1, 2)]


def brute_words(rows, k):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (i, *_), w in zip(rows, split, strict=True):
        gone = {j + x for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for x in range(k)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def brute_bytes(rows, k):
    data = [((1 << 63) if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in data:
        for j in range(len(b) - k + 1):
            w = b[j : j + k]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (doc, *_) in zip(data, rows, strict=True):
        mask = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if first[b[j : j + k]] < i:
                mask[j : j + k] = b"\1" * k
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        out.append((doc, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    got = [tuple(r)[:4] for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, 35), key=key)
    assert sum(r[2] for r in got) > 500


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    got = [tuple(r)[:5] for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, 50), key=key)
    assert sum(r[2] for r in got) > 500


def test_long_row_in_pieces(spark, monkeypatch):
    import tidemark.llm.suffix_dedup as M

    monkeypatch.setattr(M, "BLOCK_BYTES", 200)
    rows = corpus(3)
    docs = [t or "" for _, t, *_ in rows]
    import numpy as np

    from tidemark.llm import superkmer as S

    got = []
    class Spy(S.Packer):
        def add(self, least, row, start, count, raw, lo, hi):
            got.extend((int(s), raw[a:b]) for s, a, b in zip(start, lo, hi, strict=True))
    caught = {}
    monkeypatch.setattr(S, "removal_ranges", lambda docs, block, bucket, size, **k: caught.update(block=block))
    M.removed_ranges(None)
    text = max(docs, key=len).encode()
    one = (np.array([1]), np.array([2]), np.array([3]))
    caught["block"](Spy(4, 4), one, np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(0, np.uint64))
    assert {raw[j : j + 50] for _, raw in got for j in range(len(raw) - 49)} == {text[j : j + 50] for j in range(len(text) - 49)}
    assert all(text[s : s + len(raw)] == raw for s, raw in got)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(none).collect() == [] and suffix_dedup(none).collect() == []


def test_maximal_repeats_have_all_occurrences():
    import numpy as np

    from tidemark.llm.suffix_dedup import maximal_repeats

    rows = [b"xxABCDEFGHyy", b"zzABCDEFGHww", b"qABCDEFrABCDEF"]
    off = np.cumsum([0, *map(len, rows)])
    got = {(tuple(sorted(p.tolist())), n) for p, n in maximal_repeats(np.frombuffer(b"".join(rows), np.uint8), off, 5)}
    assert got == {((2, 14), 8), ((2, 14, 25, 32), 6)}


def test_rows_whose_32_bit_hashes_agree(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.common import keyed

    texts = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    pair = [r.t for r in texts.groupBy(F.hash("text")).agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a < b").select(F.array("a", "b").alias("t")).limit(1).collect()][0]
    rows = [(None, t, "x", 1, 2) for t in pair]
    got = keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()
    assert len({r.th for r in got}) == len({r.tl for r in got}) == 2
    assert keyed(texts, "doc_id", "text").select("th").distinct().count() == 200_000
    assert keyed(texts, "doc_id", "text").select("tl").distinct().count() > 199_900


def test_many_equal_rows_without_ids(spark):
    from tidemark.llm.common import keyed
    from tidemark.llm.substring_dedup import removed_ranges

    text = " ".join(f"w{i % 70}" for i in range(300))
    rows = [(None, text, "x", 1, 2)] * 500 + [(None, "a " + text, "x", 1, 2), (None, None, "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(40)
    assert sorted([tuple(r)[:4] for r in substring_dedup(df).collect()], key=key) == sorted(brute_words(rows, 35), key=key)
    assert sorted([tuple(r)[:5] for r in suffix_dedup(df).collect()], key=key) == sorted(brute_bytes(rows, 50), key=key)
    lists = removed_ranges(keyed(df, "doc_id", "text")).distinct().groupBy("did", "th", "tl").count().collect()
    assert len(lists) == 2 and all(r["count"] < 40 for r in lists)


@pytest.mark.parametrize("words", [True, False])
def test_windows_of_a_hot_minimiser_scatter(spark, words, monkeypatch):
    """Rows that share little more than one minimiser: as many windows, and far smaller buckets."""
    from tidemark.llm import superkmer as S
    from tidemark.llm.common import keyed
    from tidemark.llm.substring_dedup import removed_ranges as by_words
    from tidemark.llm.suffix_dedup import removed_ranges as by_bytes

    rnd = random.Random(11)
    common = " ".join(f"c{i}" for i in range(30 if words else 12))
    word = lambda: f"{rnd.randrange(10**9)}"
    side = 30 if words else 3
    rows = [(i, " ".join([*(word() for _ in range(side)), common, *(word() for _ in range(side))]), "x", 1, 2) for i in range(400)]
    rows += [(1000 + i, t, "x", 1, 2) for i, (_, t, *_) in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = {}
    real = S.removal_ranges

    def spy(docs, block, bucket, size, **how):
        blocks["map"] = block
        return real(docs, block, bucket, size, **how)

    monkeypatch.setattr(S, "removal_ranges", spy)
    find = by_words if words else by_bytes
    find(keyed(df, "doc_id", "text"))
    raw = "".join(t for _, t, *_ in rows).encode()
    import numpy as np

    off = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t, *_ in rows])))
    own = tuple(np.arange(len(rows), dtype=t) for t in (np.int64, np.int64, np.int32))
    data = np.frombuffer(raw, np.uint8)
    counter = S._Counter()
    blocks["map"](counter, own, data, off, np.zeros(0, np.uint64))
    least, size, _ = counter.totals()
    hot = np.sort(least.view(np.uint64)[size > 20 * np.median(size)])
    assert len(hot) and size[size > 20 * np.median(size)].sum() > 0.05 * size.sum()
    after = S._Counter()
    blocks["map"](after, own, data, off, hot)
    assert after.totals()[1].max() < size.max() / 20
    monkeypatch.setattr(S, "hot_minimisers", lambda *a: hot)
    dedup, brute, n = (substring_dedup, brute_words, 4) if words else (suffix_dedup, brute_bytes, 5)
    got = [tuple(r)[:n] for r in dedup(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 35 if words else 50), key=key)


def test_hot_minimisers_are_found(spark, monkeypatch):
    from tidemark.llm import superkmer as S
    from tidemark.llm.substring_dedup import removed_ranges

    monkeypatch.setattr(S, "BUCKET_BYTES", 1 << 12)
    caught = {}
    monkeypatch.setattr(S, "hot_minimisers", lambda *a, f=S.hot_minimisers: caught.setdefault("hot", f(*a)))
    rnd = random.Random(12)
    common = " ".join(f"c{i}" for i in range(30))
    word = lambda: f"{rnd.randrange(10**9)}"
    rows = [(i, " ".join([*(word() for _ in range(30)), common, *(word() for _ in range(30))]), "x", 1, 2) for i in range(200)]
    from tidemark.llm.common import keyed

    removed_ranges(keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text"))
    assert 0 < len(caught["hot"]) <= 23
