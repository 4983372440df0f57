"""Sharding by jump consistent hashing.

A key is a 64-bit integer (integers are taken as they are, other keys through xxhash64). The jump sequence of
a key is a chain of shard counts at which the key moves; the last jump below the number of shards is its
shard. Appending a shard moves exactly the keys whose next jump is the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from comarca.llm.common import documents, numbered

SHARDS = 40
ROW_BYTES = 16  # bytes counted for a row besides its text
LCG = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            state[moving] = state[moving] * LCG + np.uint64(1)
            step = float(1 << 31) / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
            to = np.floor((at[moving] + 1) * step)
            on = to < shards
            moving = moving[on]
            at[moving] = to[on].astype(np.int64)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard number of a long column; a null key counts as 0."""

    @F.pandas_udf("int")
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards), dtype="int32")

    return assign(F.coalesce(key, F.lit(0).cast("long")))


def stable_key(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, IntegralType):
        return F.col(column).cast("long")
    return F.xxhash64(F.col(column))


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row in a shard by its key alone, with the shard it has once one more shard is appended.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts have no bytes and the crc32 of
    nothing; null keys share one shard; repeated rows are placed side by side, each in a slot of its own; an
    empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        stable_key(docs, key).alias("_key"),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        shard_of(F.col("_key"), shards).alias("shard"),
        shard_of(F.col("_key"), shards + 1).alias("grown_shard"),
    )
    return numbered(placed, "shard", ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
