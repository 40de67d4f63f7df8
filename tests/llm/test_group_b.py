"""Quality, PII, decontamination, media and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, base string, spans int, m int"
SF = "/root/testdata/sf0.001"
key = lambda r: tuple((x is None, x) for x in r)


def base_spans(t):
    t = t or ""
    out = []
    add = lambda k, m: out.append((m.start(), k, m.end()))
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        add(0, m)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            add(1, m)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m)
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            add(2, m)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(digits(m)) <= 15:
            add(3, m)
    return sorted(out)


KINDS = ("email", "ip", "card", "phone")
TEXTS = [
    None, "", "é日 a.b@c.d x@y.z.q. a@b..c @x.y", "a@b.c_x@d.e@f.g h@i", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.0255", "call 4111 1111 1111 1111 or 4111-1111-1111-1112 411111111111111",
    "+1 (555) 123-4567, +12 3, +1234567890123456 +49 30 1234567.", "4111  1111 1111 1111", "5" * 5000, "a." * 4000 + "@" + "b." * 4000 + "c", "1 " * 6000, "+" * 50 + "1" * 12, "x@" * 500,
    "mail bob [at] host [dot] com or call (555) 123-4567 now; order 555-123-4567", "𝒳 +44 20 7946 0958 x@y.zz", "1.2.3 4.5.6.7 1..2.3.4 1.2.3.4-5.6.7.8", "ab@c.d-.e-f.g.", "0000 0000 0000 00",
]


def random_texts(n=300):
    rnd = random.Random(3)
    bits = ["@", ".", "a", "b-", "1", "25", "255", "4111", "+", " ", "-", "(", ")", "_", "%", "é", "1.1.1.1", "a@b.c", "+1234567890", "\n", "00000000000000"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


def test_pii(spark):
    from tidemark.llm.pii import pii_digest, train

    texts = TEXTS + random_texts()
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], "x", 1, 2)]
    model = train(spark)
    assert set(model[1]) == set(KINDS) and max(model[1].values()) < float("inf")
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone): r.spans for r in pii_digest(spark.createDataFrame(rows, SCHEMA), model).collect()}
    for i, t, *_ in rows:
        want = base_spans(t)
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want)
        k = (i, hashlib.sha256(text.encode()).hexdigest(), *(sum(s[1] == n for s in want) for n in range(4)))
        assert k in got, (t, want)
        assert set(text.split(",")) - {""} <= set(got[k].split(",")), t
    spans = next(v for k, v in got.items() if k[0] == 13).split(",")
    t = TEXTS[13]
    found = {t[int(b) : int(c)] for _, b, c in (s.split(":") for s in spans)}
    assert {"bob [at] host [dot] com", "(555) 123-4567"} <= found and "555-123-4567" not in found


def test_pii_keeps_what_clashes_and_merges_proposals(spark):
    from tidemark.llm.pii import find_pii, pii_digest, redact

    schema = "doc_id long, text string, base string, spans int, _text string, _digit int, _email string, __x int"
    rows = [(1, "call 555-123-4567. mail a@b.cc; host fe80::1:2", "B", 2, "T", 3, "E", 4), (1, None, "B", 2, "T", 3, "E", 4), (None, "", None, None, None, None, None, None)]
    df = spark.createDataFrame([*rows, rows[0]], schema)
    got = redact(df)
    assert got.columns == df.columns
    out = sorted([tuple(r) for r in got.collect()], key=key)
    new = (1, "call [PHONE]. mail [EMAIL]; host [IP]", *rows[0][2:])
    assert out == sorted([new, new, rows[1], rows[2]], key=key)
    with pytest.raises(ValueError):
        find_pii(df)
    assert redact(df.limit(0)).collect() == [] and pii_digest(df.limit(0)).collect() == []


def test_pii_array_helpers(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import pii as P

    rnd = random.Random(8)
    rows = []
    for i in range(60):
        n = rnd.randint(0, 40)
        spans = sorted((a := rnd.randrange(200), rnd.randrange(4), a + rnd.randint(1, 12), rnd.random()) for _ in range(n))
        base = sorted((a := rnd.randrange(200), rnd.randrange(4), a + rnd.randint(1, 12)) for _ in range(rnd.randint(0, 20)))
        rows.append((i, [s[2] for s in spans], spans, base, "é𝒳a" * rnd.randint(0, 1500)))
    span = "struct<start:int,rank:int,stop:int"
    df = spark.createDataFrame(rows, f"i int, v array<int>, s array<{span},score:double>>, b array<{span}>>, t string")
    cut = F.expr("transform(sequence(0, 40), k -> struct(k * 97 as a, k * 97 + k * k as z))")
    got = df.select("i", P._running(F.col("v"), P._add).alias("sum"), P._merged(F.col("s")).alias("m"), P._not_covered(F.col("s"), F.col("b")).alias("n"), P._let(P._chunks(F.col("t")), lambda c: F.transform(cut, lambda x: P._cut(c, x["a"], x["z"]))).alias("cut")).collect()
    for r in got:
        _, v, s, b, t = rows[r.i]
        assert r["sum"] == np.cumsum(v).tolist()
        want = []
        for x in s:
            if want and x[0] < want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], x[2]), max(want[-1][2], (x[3], -x[0], -x[1])))
            else:
                want.append((x[0], x[2], (x[3], -x[0], -x[1])))
        assert [tuple(x) for x in r.m] == [(a, -best[2], z) for a, z, best in want]
        assert sorted(tuple(x) for x in r.n) == [x for x in s if not any(y[0] <= x[0] and x[2] <= y[2] for y in b)]
        assert r.cut == [t[k * 97 : k * 97 + k * k] for k in range(41)]


def test_pii_of_a_long_text_of_matches(spark):
    import time

    from tidemark.llm.pii import redact, train

    model, took = train(spark), []
    for n in (3000, 12000):
        df = spark.createDataFrame([(1, "+1 555 123 4567 or a@b.cc, " * n)], "doc_id long, text string")
        began = time.time()
        assert redact(df, model).first().text == "[PHONE] or [EMAIL], " * n
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 5


def test_redact_and_empty(spark):
    from tidemark.llm.pii import pii_digest, redact

    rows = [(1, "é a@b.cc and 1.2.3.4!", "x", 1, 2), (2, None, "x", 1, 2), (3, "none", "x", 1, 2)]
    got = {r[0]: tuple(r)[1:] for r in redact(spark.createDataFrame(rows, "doc_id long, text string, source string, a int, b int")).collect()}
    assert got == {1: ("é [EMAIL] and [IP]!", "x", 1, 2), 2: (None, "x", 1, 2), 3: ("none", "x", 1, 2)}
    assert pii_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_native_plan(spark):
    from tidemark.llm.pii import pii_digest

    plan = pii_digest(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_quality(spark):
    from tidemark.llm.quality import grades, keep_good, train

    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    model = train(docs, half)
    got = grades(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.p_clean >= 0.5 for r in got if r.quality == 1 and r.toxic == 0]
    toxic = [r.p_clean < 0.5 for r in got if r.quality == 1 and r.toxic == 1]
    junk = [r.p_clean < 0.5 for r in got if r.quality == 0]
    shares = np.mean(clean), np.mean(toxic), np.mean(junk)
    assert shares[0] > 0.97 and shares[1] > 0.6 and shares[2] > 0.95, shares  # half the labels are few
    assert all(0 <= r.p_clean <= r.p_good <= 1 and abs(r.expected_grade - r.p_clean - r.p_good) < 1e-9 for r in got)
    rows = spark.createDataFrame([(1, None, "", 1, 1), (1, "", "", 1, 1), (None, "x " * 90000, "", 1, 1)], SCHEMA)
    assert len(grades(rows, model).collect()) == 3
    assert train(rows, labels.limit(0)) is None and grades(rows, None).where("p_clean < 0.5").count() == 0
    assert keep_good(rows.limit(0), model).collect() == [] and keep_good(rows, None).count() == 3


def test_features_once_a_row():
    from tidemark.llm.quality import features

    f, off = features(np.frombuffer(b"Aa aa aa bbA a", np.uint8), np.array([0, 8, 12, 12, 14]))
    assert off.tolist() == [0, 10, 20, 28, 38] and len(set(f[:10])) == 10


def windows_brute(doc, item):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    from collections import Counter

    d, w = low(doc), low(item)
    if not w or not d:
        return 0
    s = min(5, len(w))
    sh = lambda x: Counter(tuple(x[i : i + s]) for i in range(len(x) - s + 1))
    have, best = sh(w), 0
    for a in range(max(1, len(d) - len(w) + 1)):
        o = sh(d[a : a + len(w)])
        both = sum((o & have).values())
        best = max(best, both / max(1, sum(o.values()) + sum(have.values()) - both))
    return best


def test_decontamination(spark):
    from tidemark.llm.decontaminate import clean, contaminated

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeEé") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.choice((3, 8, 20, 40)))), "z") for i in range(30)]
    items += [(90, None, "z"), (91, "", "z"), (92, items[2][1], "z")]
    docs = []
    for i in range(120):
        t = rnd.choice(items[:30])[1].split()
        for _ in range(rnd.choice((0, 0, 1, 3))):
            t[rnd.randrange(len(t))] = word()
        if rnd.random() < 0.2:
            t.insert(len(t) // 2, word())
        around = [word() for _ in range(rnd.choice((0, 5, 60)))]
        docs.append((i, "\n".join([*around, *(t if rnd.random() < 0.7 else []), *around]).upper() if i % 3 else " ".join(t), "x", 1, 2))
    docs += [(500, None, "x", 1, 2), (501, "", "x", 1, 2), (None, docs[0][1], "x", 1, 2), docs[1]]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(df, bench).collect()}
    want = {(d[0], i[0]): s for d in docs for i in items if (s := windows_brute(d[1], i[1])) >= 0.8}
    assert got.keys() - want.keys() == set() and want.keys() - got.keys() == set()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and 8 < len(got)
    left = clean(df, bench).collect()
    assert sorted([tuple(r) for r in left], key=key) == sorted([d for d in docs if not any(windows_brute(d[1], i[1]) >= 0.8 for i in items)], key=key)
    assert contaminated(df.limit(0), bench).collect() == [] and clean(df, bench.limit(0)).count() == len(docs)


def test_multi_index_is_exact():
    from tidemark.llm.decontaminate import Items

    rnd = random.Random(9)
    items = Items(list(range(300)), [(" ".join(str(rnd.random()) for _ in range(20)) + "\n").encode() for _ in range(300)])
    for _ in range(50):
        fp = int(rnd.choice(items.prints)) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 24)))
        assert items.within(fp, 20) == [i for i in range(300) if (int(items.prints[i]) ^ fp).bit_count() <= 20]


def test_media(spark):
    from tidemark.llm import media as M

    texts = [None, "", "é", "a" * 64, "b" * 65, "日本語" * 3000, bytes(range(1, 128)).decode() * 300, ("A" * 2048 + "\x7f" * 2048) * 3]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, 2), (None, "q", "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in M.media_digest(df).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(M.store(raw)) and r.media_sha256 == hashlib.sha256(M.store(raw)).hexdigest()
    files = M.media(df)
    cut = [tuple(r)[1:5] for r in M.clip_rows(files).orderBy("clip").collect() if r.doc_id == 7]
    assert cut == [(i, i, i, i / 25) for i in range(6)]
    assert M.media_digest(df.limit(0)).collect() == [] and M.clip_rows(files.limit(0)).collect() == []


def test_bad_media_has_no_clips(spark):
    from tidemark.llm import media as M

    good = M.store(b"a" * 5000)
    blobs = [b"", b"x", b"RIFF", good[:100], good[:400], good.replace(b"\xff\xda", b"\xff\x00"), None, good]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "doc_id long, media binary")
    assert {r.doc_id for r in M.clip_rows(df).collect()} == {7}


def test_training_rows_are_bounded(spark, monkeypatch):
    from tidemark.llm import quality as Q

    docs = spark.createDataFrame([(i % 2, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda f, off, grade: seen.append(len(grade)))
    Q.train(docs, labels, sample=2)
    assert seen == [2]


def test_general_jpeg_decoder_agrees():
    from tidemark.llm import media as M

    rnd = np.random.default_rng(1)
    levels = rnd.integers(0, 256, (5, 64), dtype=np.uint8)
    jpeg = M.encode_frame(levels)
    other = jpeg.replace(bytes([0, *([8] * 64)]), bytes([0, 8, *([9] * 63)]))  # other tables: the general path
    assert (M.decode_frame(jpeg) == levels).all() and (M.decode_frame(other) == levels).all()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0.5 * n < len(rows) <= n
        docs = spark.createDataFrame(rows, docs.schema)
        n = len(rows)
        if name == "near_dedup":
            from tidemark.llm.simhash import simhash_groups

            assert simhash_groups(docs).select("component_id").distinct().count() == n
    assert all(not base_spans(r.text) for r in docs.collect())
    got = P.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert P.stage_near_dedup(spark, docs.limit(0), SF).collect() == []


@pytest.mark.parametrize("rows", [[(1, "a b c", "", "", 5), (1, "a b c", "", "", 5), (None, "a b c", "", "", 5)], [(None, None, "", "", 5), (None, "", "", "", 5)]])
def test_near_dedup_repeats(spark, rows):
    import corpus_pipeline as P

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert P.stage_near_dedup(spark, docs, SF).count() == 1


def test_near_dedup_drops_by_row(spark):
    import corpus_pipeline as P

    def text(seed):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))

    copies = [(5, text(0)), (None, text(0).upper()), (7, text(0)), (None, text(8)), (None, text(8).upper())]
    others = [(None, text(1)), (None, text(2)), (7, text(3)), (9, text(4)), (9, text(5))]
    docs = spark.createDataFrame([(i, t, "", "", 5) for i, t in copies + others], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in P.stage_near_dedup(spark, docs, SF).collect()]
    assert sorted(left, key=key) != [] and set(others) | {copies[0]} <= set(left)
    assert len(left) == len(others) + 2 and sum(t.lower() == text(8) for _, t in left) == 1


def test_near_dedup_finds_all_pairs(spark):
    import corpus_pipeline as P
    from tidemark.llm import near_dup

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice((4, 12, 60, 200)))]
        for _ in range(rnd.choice((1, 2, 6))):
            t = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 4))):
                t[rnd.randrange(len(t))] = word()
            texts.append(" ".join(t if rnd.random() < 0.7 else t[: len(t) * 9 // 10]))
    texts += ["", "\t", texts[0].upper()]
    docs = spark.createDataFrame([(i, t, "", "", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                linked += sets[i] != sets[j]
                a, b = sorted((top(i), top(j)))
                root[b] = a
    left = {r.doc_id for r in P.stage_near_dedup(spark, docs, SF).collect()}
    assert left == {i for i in range(len(texts)) if root[i] == i} and linked > 30
    assert near_dup.prefix(np.arange(10, dtype=np.uint64), np.array([0], np.uint64), np.array([9])).tolist() == [1, 2, 3]


def test_decontamination_tries_unaligned_windows():
    from tidemark.llm.decontaminate import Items

    item = [f"w{i}" for i in range(64)]
    doc = ["x", *item[1:32], "y", "z", *item[32:63], "v"]
    raw = np.frombuffer(" ".join(doc).encode(), np.uint8)
    got = Items([7], [" ".join(item).encode()]).hits(raw, np.array([0, len(raw)]))
    assert [h[:4] for h in got] == [(0, 7, 1, 64)] and abs(got[0][5] - windows_brute(" ".join(doc), " ".join(item))) < 1e-9
