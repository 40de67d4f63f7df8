"""Shards by jump consistent hashing (Lamping and Veach 2014): no ring table, and one more shard
takes rows only into itself.

The key is the row's id (null: a key of its own), so rows with one id share a shard. Null text
has size 16 and the checksum of no bytes. slot numbers a shard's rows from 0 without gaps, in any
order. Very long texts, empty tables and columns with clashing names need nothing special: only
the id and the text are read, and text never leaves the scan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NULL_ID, materialize, numbered, with_row

SHARDS = 40


def jump_hash(key: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of each 64-bit key, for all keys at once."""
    key = key.astype(np.uint64)
    b, j = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    while len(todo):
        b[todo] = j[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        j[todo] = ((b[todo] + 1) * (float(1 << 31) / ((key[todo] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        todo = todo[j[todo] < shards]
    return b.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Ids are scrambled first: neighbouring integers are poor keys for jump hashing."""

    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy().view(np.uint64), shards))

    return jump(F.xxhash64(key))


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of df."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(own, shards).alias("shard"),
        shard_of(own, shards + 1).alias("grown_shard"),
    )
    rows = numbered(materialize(with_row(rows), "sharded"), ["shard"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
