"""Weighted rendezvous hashing of stable keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read, text_of

SHARDS = 40
#: Bytes that a record needs beside its text.
RECORD_BYTES = 16


def _score(key: Column, shard: int, weight: float) -> Column:
    """weight / -ln(u), u in (0, 1) from 52 bits of the hash of key and shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12) + F.lit(0.5)) / F.lit(2.0**52)
    return F.lit(float(weight)) / -F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score for the key; equal scores go to the smaller shard.

    A shard's share of the keys is its weight's share. A shard added at the end takes keys only
    into itself, a shard removed gives up only its own: all other scores stay as they are.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one at least")
    ranked = [F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return (-F.array_max(F.array(*ranked))["shard"]).cast("int")


def rendezvous(df: DataFrame, key: str, weights: Sequence[float], added: Sequence[float] = ()) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 within the shard) and ``grown_shard``, the shard after ``added`` ones came.

    All shards' scores are column expressions; slots come from counts per part of a shard, so no
    shard is sorted in one task. A null key is a key like any other; rows that repeat a key
    share its shard and have slots of their own; an empty table stays empty. Columns named
    shard, slot or grown_shard are replaced.
    """
    placed = df.drop("shard", "slot", "grown_shard").withColumn("shard", shard_of(F.col(key), weights))
    placed = placed.withColumn("grown_shard", shard_of(F.col(key), [*weights, *added]) if added else F.lit(None).cast("int"))
    return numbered(placed, ["shard"], [key], "slot")


def op9_rendezvous_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(
        "doc_id", (F.octet_length(text_of()) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32")
    )
    out = rendezvous(docs, "doc_id", [1.0] * SHARDS, added=[1.0])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
