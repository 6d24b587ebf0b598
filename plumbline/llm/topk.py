"""Exact top-k inner products with a vector-approximation file.

Each vector's integer components are quantised to 8-bit cells, a grid a
dimension and block of rows; the cells are written to a table of their own, a
few bytes a component. For a query a cell's score is known up to
sum(|q| * width) / 2, so a scan of the cells alone gives every candidate a lower
and an upper bound. The kth lower bound of a query is a floor of its result:
candidates whose upper bound is under it are out, and the exact vectors of the
others are read and scored.

Queries are taken in blocks of a stated size; each block is broadcast and meets
the cells in one scan, in which a task already drops what its own kth lower
bounds exclude.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches

#: Queries in a broadcast block, rows whose cells share a grid, and queries that meet a grid's rows together.
QUERY_BLOCK, ROW_BLOCK, QUERY_TILE = 16_384, 8_192, 256
#: Components from here on have no cells: their rows are read for each query.
WILD = 1e300
CELLS = "n int, uids binary, ids binary, low binary, width binary, cells binary"
BOUNDED = "query int, query_id long, uid long, low double, high double"
SCORED = "query_id long, vec_id long, score long, beyond string"
LONG = 1 << 63


def whole_numbers(vectors: pa.Array) -> list[np.ndarray]:
    """floor(256 * x) of each vector's components, as doubles: these are whole, and infinite beyond a double."""
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    with np.errstate(over="ignore"):
        flat = np.floor(256.0 * flat)
    at = vectors.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def exact(component: float) -> int:
    """floor(256 * x) of a finite component, whatever its size."""
    return math.floor(256.0 * component) if abs(component) < 1e300 else int(component) * 256


class Grid:
    """8-bit cells of a block of rows of one length. Without a width there are none, and nothing is known of the scores."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells

    @classmethod
    def of(cls, x: np.ndarray) -> "Grid":
        low = x.min(0)
        width = (x.max(0) / 255.0 - low / 255.0) if len(low) else low
        cells = np.rint(np.divide(x - low, width, out=np.zeros_like(x), where=width > 0)) if x.size else x
        return cls(low, width, np.clip(cells, 0, 255).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle score of each (query, row), and how far the exact one may be from it."""
        scaled = queries * self.width
        unit = max(float(np.abs(scaled).max(initial=0)), 1e-300)
        middle = ((scaled / unit).astype(np.float32) @ self.cells.T.astype(np.float32)).astype(np.float64) * unit + (queries @ self.low)[:, None]
        spread = np.abs(scaled).sum(1)
        far = np.abs(queries) @ (np.abs(self.low) + 256 * self.width)
        n = len(self.low)
        return middle, spread * (0.5 + 1e-6) + n * 2.0**-22 * 256 * spread + n * 2.0**-48 * far + 1e-9


def _file(batches):
    """The rows' cells, a record for each grid."""
    held: dict[tuple[int, bool], list] = {}

    def record(key):
        uids, ids, rows = zip(*held.pop(key))
        grid = None if key[1] else Grid.of(np.array(rows).reshape(len(rows), key[0]))
        parts = (b"", b"", b"") if grid is None else (grid.low.tobytes(), grid.width.tobytes(), grid.cells.tobytes())
        blobs = (np.array(uids, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), *parts)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["n", "uids", "ids", "low", "width", "cells"])

    for batch in batches:
        for uid, vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), whole_numbers(batch.column(2))):
            key = len(x), bool(len(x)) and bool(np.abs(x).max() >= WILD)
            held.setdefault(key, []).append((uid, vec_id, x))
            if len(held[key]) >= ROW_BLOCK:
                yield record(key)
    for key in list(held):
        yield record(key)


def _scan(queries, k: int):
    """Candidates of each query with their bounds, as far as the task's own kth lower bounds leave them."""

    def run(batches):
        floors = {n: np.full((len(ids), k), -np.inf) for n, (_, ids, _, _) in queries.value.items()}  # a query's k best lower bounds so far
        for batch in batches:
            for n, uids, ids, low, width, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if n not in floors:
                    continue
                numbers, query_ids, vectors, _ = queries.value[n]
                uids, ids = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64)
                grid = Grid(np.frombuffer(low), np.frombuffer(width), np.frombuffer(cells, np.uint8).reshape(len(ids), n)) if width or not n else None
                for at in range(0, len(query_ids), QUERY_TILE):
                    tile = slice(at, at + QUERY_TILE)
                    if grid is None:
                        middle, slack = np.zeros((len(query_ids[tile]), len(ids))), np.full(len(query_ids[tile]), np.inf)
                    else:
                        middle, slack = grid.bounds(vectors[tile])
                    own = ids[None, :] == query_ids[tile][:, None]
                    lows = middle - slack[:, None]
                    lows[own | np.isnan(lows)] = -np.inf
                    best = np.concatenate([floors[n][tile], lows if lows.shape[1] <= k else np.partition(lows, lows.shape[1] - k, axis=1)[:, -k:]], axis=1)
                    floors[n][tile] = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
                    highs = middle + slack[:, None]
                    rows, cols = np.nonzero(~(highs < floors[n][tile].min(1)[:, None]) & ~own)
                    for i in range(0, len(rows), 65_536):
                        r, c = rows[i : i + 65_536], cols[i : i + 65_536]
                        high = highs[r, c]
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[tile][r], pa.int32()), pa.array(query_ids[tile][r]), pa.array(uids[c]), pa.array(lows[r, c]), pa.array(np.where(np.isnan(high), np.inf, high))], ["query", "query_id", "uid", "low", "high"])

    return run


def _scores(queries):
    """Exact scores of (query, vector); those beyond a long are its nearest end, with a string in their order."""

    def beyond(score: int) -> str:
        digits = str(abs(score))
        return f"9{len(digits):05}{digits}" if score > 0 else f"1{99_999 - len(digits):05}" + "".join(str(9 - int(d)) for d in digits)

    def run(batches):
        known = {int(q): own for numbers, _, vectors, raws in queries.value.values() for q, *own in zip(numbers, vectors, raws)}
        for batch in batches:
            scores, marks = [], []
            for q, x, raw in zip(batch.column(0).to_pylist(), whole_numbers(batch.column(3)), batch.column(3)):
                own, own_raw = known[q]
                if len(x) * float(np.abs(own).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2.0**62:
                    score = int(own.astype(np.int64) @ x.astype(np.int64))
                else:
                    score = sum(exact(a) * exact(b) for a, b in zip(own_raw.tolist(), raw.as_py()))
                scores.append(min(max(score, -LONG), LONG - 1))
                marks.append("5" if -LONG <= score < LONG else beyond(score))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(scores, pa.int64()), pa.array(marks, pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows by integer inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows of another vec_id and of the query's length, as vectors of unlike
    lengths have no inner product; each length is searched for itself, and
    empty vectors score 0 with one another. Components count as floor(256 * x);
    ties go to the smaller vec_id. Null ids, null vectors and vectors with a
    null or non-finite component take no part.
    Rows that repeat a query's id are one query if their vectors are equal;
    repeated candidates count each. No queries or no rows give no rows.
    Scores are exact; those beyond a long rank by their exact value and are
    shown as the long's nearest end. Other columns are ignored.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and embedding is not null").where(F.coalesce(finite, F.lit(False)))
    rows = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()), "exact")
    cells = scratch.keep(rows.select("uid", "vec_id", "embedding").mapInArrow(_file, CELLS), "cells")
    ids = rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding").distinct()
    ids = scratch.keep(ids.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-ids.count() // query_block))))), "queries")
    best = Window.partitionBy("query_id")
    out = None
    blocks = [r[0] for r in ids.select("block").distinct().orderBy("block").collect()]  # one number for query_block queries
    for block in blocks:
        own = ids.where(F.col("block") == block).orderBy("vec_id", "embedding").toArrow()
        own_ids, column = own.column("vec_id").to_numpy(), own.column("embedding").combine_chunks()
        found, raws = whole_numbers(column), [np.array(x.as_py(), np.float64) for x in column]
        lengths = np.array([len(x) for x in found])
        shared = {}
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            shared[n] = at, own_ids[at], np.array([found[q] for q in at]).reshape(len(at), n), [raws[q] for q in at]
        queries = spark.sparkContext.broadcast(shared)  # about query_block vectors
        bounded = scratch.keep(cells.mapInArrow(_scan(queries, k), BOUNDED), f"bounded-{block}")
        # The kth lower bound of all tasks together; a query with fewer candidates has none.
        ranked = bounded.withColumn("at", F.row_number().over(best.orderBy(F.desc("low")))).where(F.col("at") <= k)
        floors = ranked.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("low")).alias("least"))
        left = bounded.join(floors, "query_id").where("least is null or high >= least")
        scored = left.select("query", "query_id", "uid").join(rows.select("uid", "vec_id", "embedding"), "uid").select("query", "query_id", "vec_id", "embedding").mapInArrow(_scores(queries), SCORED)
        part = scored.withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))).where(F.col("rank") <= k)
        part = scratch.keep(part.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), f"block-{block}")
        scratch.drop(f"bounded-{block}")
        queries.unpersist()
        out = part if out is None else out.union(part)
    scratch.drop("exact", "cells", "queries")
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
