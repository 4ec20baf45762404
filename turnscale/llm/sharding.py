"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

#: Rows that are numbered together; a shard has as many such buckets as it needs.
BUCKET_ROWS = 20_000


def rendezvous_scores(key: Sequence[Column], weights: Sequence[float]) -> list[Column]:
    """A score for each shard, -ln(u) / weight with u uniform in (0, 1) by key and shard; the lowest wins.

    A score depends on nothing but key, shard number and weight, so a further shard, or a higher weight,
    moves rows into that shard alone. Null keys hash like any other value.
    """

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), *key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return -F.log(u) / F.lit(float(weight))

    return [score(i, w) for i, w in enumerate(weights)]


def assign_shards(df: DataFrame, key: Sequence[str], weights: Sequence[float], name: str = "shard") -> DataFrame:
    """Add the shard number of every row. Equal keys share a shard; no shuffle.

    An existing column of that name is replaced. Weights must be positive; ties go to the lower number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = rendezvous_scores([F.col(f"`{k}`") for k in key], weights)
    best = F.array_min(F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i")) for i, s in enumerate(scores)]))
    return df.withColumn(name, best["i"])


def number_slots(df: DataFrame, group: str, order: Sequence[str], n_groups: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `slot`, from 0 without gaps within each group, without ever sorting a whole group in one task.

    Rows of a group are dealt to buckets by the hash of the order columns; each bucket is numbered by itself
    and lifted by the count of the buckets before it. Rows equal in all order columns take their slots in any order.
    """
    n_buckets = max(1, math.ceil(df.count() / n_groups / bucket_rows))
    bucket, earlier, rank = (free_name(df, c) for c in ("bucket", "earlier", "rank"))
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(n_buckets)))
    counts = rows.groupBy(group, bucket).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, bucket, F.coalesce(before, F.lit(0)).alias(earlier))
    within = Window.partitionBy(group, bucket).orderBy(*order)
    numbered = rows.withColumn(rank, F.row_number().over(within)).join(offsets, [group, bucket])
    return numbered.withColumn("slot", F.col(earlier) + F.col(rank) - 1).drop(bucket, earlier, rank)


def shard_documents(documents: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    doc_id and shard count alone decide the shard (law `key`); grown_shard is the one with a further shard
    of the last weight. size is the UTF-8 bytes plus 8; a null text counts as no bytes. A null doc_id is a key
    like any other, repeated rows share their shard and take one slot each, an empty table gives no rows,
    and further columns of documents are not read.
    """
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, ["doc_id"], weights), ["doc_id"], [*weights, weights[-1]], "grown_shard")
    rows = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"], len(weights), bucket_rows)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
