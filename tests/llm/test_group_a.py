"""SimHash, sharding, packing and token counts against brute force."""

import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import public_tokenizers
from tidemark.llm.packing import pack_documents, plan
from tidemark.llm.sharding import jump_hash, shard
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.token_counts import scores, token_counts

SCHEMA = "doc_id long, text string, fp string, length int, shard int"


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(("the", "on", "Er", "é", "ing", "x.", "9", "日本", "ß", "'s", "ΣΑΣ")) for _ in range(rnd.randint(1, 4)))
    rows = []
    for _ in range(150):
        w = [word() for _ in range(rnd.choice((0, 1, 2, 5, 120, 300, 700)))]
        rows.append(" ".join(w))
        for _ in range(rnd.choice((0, 0, 2))):
            if len(w) > 100:
                v = list(w)
                for _ in range(rnd.randint(0, 3)):
                    v[rnd.randrange(len(v))] = word()
                rows.append("\n".join(v))
    rows += [None, "", "   ", "one", "One", "a b   c\x1cd <|endoftext|> x<|startoftext|>", "Ａ İ ǅ ﬁ é", "long " * 9000, rows[0], "z" * 3000]
    out = [(i * 7 % 1009, t, "x", 1, 2) for i, t in enumerate(rows)]
    return [*out, out[3], (None, rows[5], "x", 1, 2), (out[9][0], rows[20], "x", 1, 2)]


key = lambda r: tuple((x is None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_simhash(docs, rows):
    fps = []
    for _, t, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(fps)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(math.inf if r[0] is None else r[0])
    want = [(r[0], f"{fps[i]:016x}", min(least[find(i)])) for i, r in enumerate(rows)]
    got = [tuple(r) for r in simhash_groups(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 20 < len({r[2] for r in got}) < len(got) - 20


def test_simhash_tiles_and_forest(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.simhash import components, links

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    vals = set(base)
    for b in base:
        for _ in range(60):
            b ^= 1 << rnd.randrange(64)
            vals.add(b)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(vals)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = dict(components(links(df, 3, tile=16)).collect())
    root = {v: v for v in signed}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in signed if find(v) != v} == got
    assert links(df, 3).where(F.col("u") <= F.col("v")).count() == 0


def test_jump_hash_moves_only_into_the_new_shard(docs, rows):
    k = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = jump_hash(k, 40), jump_hash(k, 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.005 and np.bincount(a).min() > 380
    assert (jump_hash(k, 1) == 0).all()
    got = shard(docs).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    want = sorted((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sorted(tuple(r[:3]) for r in got if r.doc_id is not None) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = []
    for i, t, *_ in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((i, n, at, len(part), zlib.crc32(part.tobytes())))
    got = pack_documents(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    left = []  # plain best fit, longest first
    for n in sorted((r.length for r in got), reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(4096 - n)
    assert len(bins) <= len(left)


def test_plan_keeps_every_capacity():
    rnd = random.Random(2)
    counts = {n: rnd.randint(1, 400) for n in rnd.sample(range(1, 101), 60)}
    bins = defaultdict(list)
    seen = defaultdict(list)
    for n, lo, hi, b, o in plan(counts, 100, 5, 6000 + 4000, (1, 1, 1)):
        seen[n] += range(lo, hi)
        for i in range(hi - lo):
            bins[b + i].append((o, n))
    assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b)][:-1]
        assert sum(n for _, n in b) <= 100 and len(b) <= 5 and sum(n * n for _, n in b) <= 10000
    with pytest.raises(ValueError):
        plan({101: 1}, 100, 5, 10**6, (1, 1, 1))


def test_token_counts(docs, rows):
    pieces = scores(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    def viterbi(w):
        best = [(0.0, 0)]
        for d in range(1, len(w) + 1):
            best.append(max(((best[d - n][0] + pieces[w[d - n : d]], best[d - n][1] - 1) for n in range(1, min(d, 130) + 1) if w[d - n : d] in pieces)))
        return -best[-1][1]
    known = {}
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        for w in set(words) - set(known):
            known[w] = viterbi(b" " + w)
        want.append((i, len((t or "").encode()), len(words), sum(known[w] for w in words)))
    assert sorted((tuple(r) for r in token_counts(docs).collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (simhash_groups, shard, pack_documents, token_counts):
        assert f(none).collect() == []
