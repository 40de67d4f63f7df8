"""Ordinal cumulative-link regression over hashed text.

Labelled documents have a grade: 0 low quality, 1 good but toxic, 2 good and clean. With one score
s for a text and ordered thresholds, P(grade <= k) = logistic(threshold_k - s). The score sums
shared weights of hashed features: each distinct lower-cased word, each distinct word beginning,
and the text's shape (lengths, repetition, case, marks) in steps. Training is full-batch gradient
descent over at most SAMPLE labelled documents, those with the smallest hashes of their ids; the
weights are one array of 2 ** BITS floats. Every document is then scored where it lies, without
a shuffle, so no key or copy can be hot.

Null text counts as empty. Labels with nulls are not used; of labelled rows that share an id, the
smallest text is fitted on. Rows that repeat, and ties, are scored alike; very long texts whole.
Without labels of two grades every row has expected grade 2 and is kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, give_back, row_blocks, text_buffer, trimmed, word_array, word_spans

SAMPLE, BITS, GRADES, PREFIX, BLOCK_BYTES, SCREEN = 8000, 18, 3, 4, 2 << 20, 6.0
_MASK = (1 << BITS) - 1
_MARKS = bytes(b for b in range(33, 127) if not bytes([b]).isalnum())


def _hash(x: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(x, seed) & _MASK


_SHAPE = [[_hash(b"%d" % step, 100 + k) for step in range(64)] for k in range(8)]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the rows one after another, each once a row, and where rows begin."""
    rows = len(off) - 1
    start, end, first, mask = word_spans(data, off)
    coded = word_array(LOWER[data], start, end, mask).dictionary_encode()
    words = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy().astype(np.int64)
    own = np.array([(_hash(w, 1), _hash(w.decode()[:PREFIX].encode(), 2)) for w in (w.strip(_MARKS) for w in words)], np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(rows), np.diff(first))
    distinct = np.unique(row * len(words) + ids) if len(ids) else ids
    row_d, id_d = (distinct // len(words), distinct % len(words)) if len(ids) else (ids, ids)
    n, size = np.diff(first), np.diff(off)
    count = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[off])
    upper = count((data >= 65) & (data <= 90))
    letters = upper + count((data >= 97) & (data <= 122)) + count(data >= 128)
    marks = count((data > 32) & (data < 48)) + count((data > 57) & (data < 65)) + count((data > 90) & (data < 97)) + count((data > 122) & (data < 127))
    lines = count(data == 10)
    shape = np.stack([
        np.log2(n + 1) * 2,
        40 * (1 - np.bincount(row_d, minlength=rows) / np.maximum(n, 1)),
        40 * upper / np.maximum(letters, 1),
        40 * marks / np.maximum(size, 1),
        40 * count((data >= 48) & (data <= 57)) / np.maximum(size, 1),
        2 * size / np.maximum(n, 1),
        200 * count(data == 124) / np.maximum(size, 1),
        100 * lines / np.maximum(n, 1),
    ]).astype(np.int64).clip(0, 63)
    steps = np.array(_SHAPE)[np.arange(8)[:, None], shape]
    all_row = np.concatenate((row_d, row_d, np.tile(np.arange(rows), 8)))
    all_f = np.concatenate((own[id_d, 0], own[id_d, 1], steps.ravel()))
    both = np.unique(all_row << BITS | all_f)
    return both & _MASK, np.searchsorted(both, np.arange(rows + 1) << BITS)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(f: np.ndarray, off: np.ndarray, grade: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the cumulative-link likelihood. A word keeps weight 0 unless
    at least eight rows have it and, at some cut of the grades, its share above and below differs
    by SCREEN standard errors: rare words would only learn noise."""
    df = np.bincount(f, minlength=1 << BITS)
    row_grade = np.repeat(grade.astype(np.int8), np.diff(off))
    chosen = np.zeros(1 << BITS, bool)
    for k in range(1, GRADES):
        up = int((grade >= k).sum())
        if 0 < up < len(grade):
            high = np.bincount(f[row_grade >= k], minlength=1 << BITS)
            share = np.clip(df / len(grade), 1e-9, 1 - 1e-9)
            z = (high / up - (df - high) / (len(grade) - up)) / np.sqrt(share * (1 - share) * (1 / up + 1 / (len(grade) - up)))
            chosen |= np.abs(z) >= SCREEN
    chosen &= df >= 8
    chosen[np.ravel(_SHAPE)] = True
    ok = chosen[f]
    del row_grade
    kept = np.array([np.count_nonzero(ok[a:b]) for a, b in zip(off.tolist(), off[1:].tolist(), strict=False)], np.int64)
    f, off = f[ok], np.concatenate(([0], np.cumsum(kept)))
    del ok
    used = np.flatnonzero(chosen & (df > 0))
    number = np.zeros(1 << BITS, np.int64)
    number[used] = np.arange(len(used))
    f = number[f]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    share = np.bincount(grade, minlength=GRADES).cumsum()[:-1] / len(grade)
    cut = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    x = np.concatenate((np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 0.05))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    n, k = len(grade), len(used)
    for t in range(1, rounds + 1):
        s = np.bincount(row, x[:k][f], n)
        theta = x[k] + np.concatenate(([0], np.cumsum(np.exp(x[k + 1 :]))))
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = logistic(edge[grade + 1] - s), logistic(edge[grade] - s)
        hi[grade == GRADES - 1], lo[grade == 0] = 1, 0
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = dhi - dlo  # of the negative log likelihood
        dtheta = np.array([dlo[grade == j + 1].sum() - dhi[grade == j].sum() for j in range(GRADES - 1)]) / n
        dx = np.concatenate((np.bincount(f, ds[row], k) / n + decay * x[:k], [dtheta.sum()], np.exp(x[k + 1 :]) * np.cumsum(dtheta[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * dx, 0.99 * v + 0.01 * dx * dx
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w = np.zeros(1 << BITS, np.float32)
    w[used] = x[:k]
    return w, x[k] + np.concatenate(([0], np.cumsum(np.exp(x[k + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """(weights, thresholds), or None where the labels have a single grade or none."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    # at most sample rows of two numbers
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # one text for each id: an id may be there in any number of rows
    rows = text.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")

    def scan(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            f, o = features(data, off)
            lists = pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(f, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["grade", "f"])

    got = rows.mapInArrow(trimmed(scan), "grade int, f array<int>").toArrow()
    if got.num_rows == 0 or len(set(got["grade"].to_pylist())) < 2:
        return None
    lists, grade = got["f"].combine_chunks(), got["grade"].to_numpy()
    del got
    order = np.argsort([xxhash.xxh64_intdigest(x.values.to_numpy().tobytes()) for x in lists], kind="stable")
    lists, grade = lists.take(pa.array(order)), grade[order].astype(np.int64)
    try:
        return fit(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), grade)
    finally:
        del lists
        give_back(docs.sparkSession)


def _scorer(model):
    weights, theta = model if model is not None else (np.zeros(1 << BITS, np.float32), np.array([-40.0, -39.0]))

    def score(col):
        data, off = text_buffer(col)
        s = [np.zeros(0)]
        for a, b in row_blocks(off, BLOCK_BYTES):
            f, o = features(data[off[a] : off[b]], off[a : b + 1] - off[a])
            total = np.concatenate(([0.0], np.cumsum(weights[f], dtype=np.float64)))
            s.append(total[o[1:]] - total[o[:-1]])
        s = np.concatenate(s)
        return [1 - logistic(t - s) for t in theta]

    return score


def grades(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_good (grade 1 or more), p_clean (grade 2): one row for each row of df."""
    score = _scorer(model)

    def scan(batches):
        for batch in batches:
            good, clean = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good + clean), pa.array(good), pa.array(clean)], ["doc_id", "expected_grade", "p_good", "p_clean"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scan), "doc_id long, expected_grade double, p_good double, p_clean double")


def keep_good(df: DataFrame, model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df whose tail probability p_clean is at least least, with all their columns."""
    score, at = _scorer(model), df.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at).cast(pa.string()))[1] >= least))

    return df.mapInArrow(trimmed(scan), df.schema)
