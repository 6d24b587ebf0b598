"""Shards by jump consistent hashing of stable keys: no table of the ring, and
one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, mix

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key, after Lamping and Veach (2014); all keys step together."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = keys.astype(np.uint64).copy()
    bucket, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        ahead[live] = ((bucket[live] + 1) * ((1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def _key(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def shard_of(doc_id: Column, shards: int) -> Column:
    """Shard of an id; a null id counts as the least long."""

    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(_key(ids.to_numpy()), shards).astype(np.int32))

    return run(F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long")))


def _counted(batches):
    """Adds the task and the row's place among those of its shard in the task."""
    task, used = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        shard = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        n = int(shard.max()) + 1 if len(shard) else 0
        used = np.concatenate([used, np.zeros(max(0, n - len(used)), np.int64)])
        order = np.argsort(shard, kind="stable")
        counts = np.bincount(shard, minlength=len(used))
        place = np.empty(len(shard), np.int64)
        place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
        place += used[shard]
        used += counts
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), task)), pa.array(place)], ["doc_id", "size", "text_crc32", "shard", "grown_shard", "task", "place"])


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ("key"), shard, slot, grown_shard of each row.

    doc_id and the number of shards decide the shard; grown_shard is that with
    one more. Slots number a shard's rows from 0 without gaps, by tasks of the
    scan: each task counts its own rows, then gets an offset, so no shard's rows
    meet in one task. size is the text's UTF-8 bytes plus 16, of a null text 16
    (its crc32 is 0). A null doc_id goes where the least long goes. Repeated
    rows share a shard and have a slot each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "sharding")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    rows = scratch.keep(rows.mapInArrow(_counted, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, task long, place long"), "rows")
    counts = rows.groupBy("shard", "task").count()
    offsets = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("task")) - F.col("count")).select("shard", "task", "before")
    out = rows.join(offsets, ["shard", "task"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), "grown_shard")
    return out
