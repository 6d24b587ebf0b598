"""Mixing sources to target weights.

Documents get keys that are random but the same in every run (a digest of their
id), and are sorted by range within their source; the running sums of their
sizes come from sums within each range and offsets between ranges, so that a
source of any size is spread over all tasks. A source whose target is t takes
all of its documents t // size times, and of what is left of t the first
documents by key, the last of them cut where the budget ends.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, limit_batches, partitions, small_side

WORD = r"[^\x20\x09-\x0D]+"


def _running(group: int, values: list[int]):
    """Adds the task, and the sums of the values before each row within the task and its group; equal groups are neighbours."""

    def run(batches):
        task, last, totals = TaskContext.get().partitionId(), None, None
        for batch in batches:
            sums = [[] for _ in values]
            for g, *found in zip(batch.column(group).to_pylist(), *(batch.column(v).to_pylist() for v in values)):
                if totals is None or g != last:
                    last, totals = g, [0] * len(values)
                for k, v in enumerate(found):
                    sums[k].append(totals[k])
                    totals[k] += v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * batch.num_rows, pa.int64()), *(pa.array(x, pa.int64()) for x in sums)], [*batch.schema.names, "_task", *(f"_sum{k}" for k in range(len(values)))])

    return run


def sums_before(rows: DataFrame, group: str, order: list, values: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds ``before_<value>``: the sum of each of ``values`` over the rows of a group that come earlier in ``order``. No group meets in one task.

    Values are longs without nulls; rows that are alike in ``order`` come in any order.
    """
    by, columns = [F.col(group).asc_nulls_first(), *order], range(len(values))
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    schema = T.StructType([*rows.schema.fields, T.StructField("_task", T.LongType()), *(T.StructField(f"_sum{k}", T.LongType()) for k in columns)])
    dealt = scratch.keep(spread.mapInArrow(_running(rows.columns.index(group), [rows.columns.index(v) for v in values]), schema), name)
    parts = dealt.groupBy(group, "_task").agg(*(F.sum(v).alias(f"_part{k}") for k, v in enumerate(values)))  # a row a task, and one more a group
    at = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(group).alias("_group"), F.col("_task").alias("_at"), *(F.coalesce(F.sum(f"_part{k}").over(at), F.lit(0)).alias(f"_offset{k}") for k in columns))
    offsets = scratch.keep(offsets, f"{name}-offsets")
    joined = dealt.join(small_side(offsets), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_at")))
    return joined.select(*rows.columns, *((F.col(f"_sum{k}") + F.col(f"_offset{k}")).alias(f"before_{v}") for k, v in enumerate(values)))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int, scratch: Scratch) -> DataFrame:
    """source, source_size, target of each source, from its size.

    Sources in order of code points, null last, weigh ``weights``, repeating. A
    target is the source's share of all sizes by weight, but stops at ``most``
    times its size; what is over goes to the others by weight. In order of size
    by weight, those that stop come first, so running sums tell them.
    """
    numbered = sources.select("source", "source_size", F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"))
    numbered = sums_before(numbered, "all", [F.col("source").asc_nulls_last()], ["one"], scratch, "numbered")
    of = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("before_one"), F.lit(len(weights))) + 1).cast("int"))
    weighed = scratch.keep(numbered.select("source", "source_size", "all", of.alias("weight")), "weighed")
    whole = weighed.agg(F.coalesce(F.sum(F.col("source_size").cast("decimal(38,0)")), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    size, weight = int(whole["size"]), int(whole["weight"])
    number = lambda n: F.lit(n).cast("decimal(38,0)")
    dec = lambda c: F.col(c).cast("decimal(20,0)")
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    ranked = sums_before(weighed, "all", order, ["source_size", "weight"], scratch, "ranked")
    # Stops, if its share of what those before it leave is above its most.
    stops = (number(size) - most * dec("before_source_size")) * F.col("weight") > most * dec("source_size") * (F.lit(weight) - F.col("before_weight"))
    ranked = scratch.keep(ranked.select("source", "source_size", "weight", stops.alias("stops")), "stops")
    held = ranked.where("stops").agg(F.coalesce(F.sum(dec("source_size")), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left, shared = size - most * int(held["size"]), weight - int(held["weight"])
    share = (number(left) * F.col("weight")).cast("double") / F.lit(float(max(1, shared)))
    full = (F.col("source_size") * most).cast("double")
    return ranked.select("source", "source_size", F.when(F.col("stops"), full).otherwise(F.least(share, full)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs, part of each row, and the columns of ``carry``.

    A row's size is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).
    ``target`` is its source's (see ``targets``; all targets together are all
    sizes). Every row is taken ``epochs`` times and, of one more copy, its first
    ``part`` words; taken is epochs * size + part. A source's taken words are
    its target, rounded down. Rows are taken in order of the md5 of seed:doc_id,
    so reruns agree; rows of one id, null ids too, go by size, and alike ones
    are interchangeable. A null source is a source of its own, other than
    ''. Sources and texts without words take nothing. An empty table gives no rows.
    Columns may be named as they like: of others, only those in ``carry`` are read.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"), F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("boolean").alias("carried"))
    rows = scratch.keep(rows, "rows")
    sources = scratch.keep(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aims = scratch.keep(targets(sources, weights, most, scratch), "targets").withColumnRenamed("source", "_source")
    ordered = sums_before(rows, "source", [F.col("key"), F.col("size")], ["size"], scratch, "sorted")
    both = ordered.join(small_side(aims), F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.least(F.greatest(budget - epochs * F.col("source_size") - F.col("before_size"), F.lit(0)), F.col("size"))
    return both.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), epochs.alias("epochs"), part.alias("part"), *([F.col(f"carried.{c}").alias(f"carried_{c}") for c in carry] if carry else []))


@F.pandas_udf(T.StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """A text up to the end of its n-th word; null for null."""

    def cut(t: str, most: int) -> str:
        end = 0
        for _, found in zip(range(most), re.finditer(WORD, t)):
            end = found.end()
        return t[:end]

    return pd.Series([None if t is None else cut(t, int(k)) for t, k in zip(text, n)], dtype=object)


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, epoch, text: the mix itself, a row a copy; the last copy of a row that the budget cuts, one row a source, has its first words only."""
    rows = mix(docs, carry=["text"], **options).withColumn("text", F.col("carried_text").cast("string")).where("size > 0")
    whole = F.col("epochs") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)
    copies = rows.withColumn("cut", (F.col("part") > 0) & (F.col("part") < F.col("size"))).withColumn("whole", whole).where("whole > 0 or cut")
    cut_text = first_words(F.when(F.col("cut"), F.col("text")), F.col("part"))
    copies = copies.withColumn("cut_text", cut_text).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + F.col("cut").cast("long"))))
    return copies.select("doc_id", "source", "epoch", F.when(F.col("epoch") <= F.col("whole"), F.col("text")).otherwise(F.col("cut_text")).alias("text"))
