"""Centroid clustering of vectors by Hamerly's bounds, in whole numbers.

Every vector keeps one upper bound of the distance to its own centroid and one
lower bound of the distance to any other. When centroids move, the bounds are
loosened by the drift; a vector whose upper bound stays under its lower bound, or
under half the gap between its centroid and the next one, can't change its
cluster and is left alone. The others get their exact distance to their own
centroid, and where that doesn't settle it, exact distances to all.

A round is one pass over a written table of vectors and bounds. It writes the
next table; the sums of the clusters change only by the vectors that moved, so
only these are added up again, in each task before the shuffle. The driver holds
and broadcasts the centroids alone, a stated number of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches

#: A component further from 0 than this counts as this.
FAR = 1 << 62
LONG = (1 << 63) - 1
#: cluster and before are -1 where there is none yet.
STATE = "vec_id long, x array<long>, cluster int, before int, upper double, lower double, distance long"


def whole(components: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite doubles, FAR from 0 at most."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * components), -float(FAR), float(FAR)).astype(np.int64)


class Centroids:
    """Centroids with what a round needs of them: gaps between them and how far each has moved."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None = None):
        self.points = points
        k = len(points)
        apart = [[_squared(a, b) for b in points] for a in points]
        self.half_gap = np.array([_down(min((apart[i][j] for j in range(k) if j != i), default=0)) / 2 if k > 1 else np.inf for i in range(k)])
        moved = np.array([_up(_squared(a, b)) for a, b in zip(points, before)]) if before else np.zeros(k)
        self.drift = moved
        # The most that any centroid but the own one has moved.
        top = np.argsort(-moved, kind="stable")
        self.other_drift = np.full(k, moved[top[0]] if k else 0.0)
        if k:
            self.other_drift[top[0]] = moved[top[1]] if k > 1 else 0.0


def _squared(a, b) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def _up(squared) -> np.ndarray:
    """A double not under the root."""
    return np.sqrt(np.asarray(squared, np.float64)) * (1 + 2.0**-48)


def _down(squared) -> np.ndarray:
    """A double not above the root."""
    return np.sqrt(np.asarray(squared, np.float64)) * (1 - 2.0**-48)


def _kind(x: np.ndarray, points: np.ndarray):
    """A type that holds every step of squared distances exactly."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), int(points.max(initial=0)), -int(points.min(initial=0)))
    room = 4 * max(1, x.shape[1]) * most**2
    return np.float64 if room < 1 << 53 else np.int64 if room < 1 << 62 else object


def all_distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, (rows, centroids)."""
    kind = _kind(x, points)
    a, b = x.astype(kind), points.astype(kind)
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return out if kind is object else out.astype(np.int64)


def own_distances(x: np.ndarray, points: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own centroid."""
    kind = _kind(x, points)
    gap = x.astype(kind) - points.astype(kind)[cluster]
    out = (gap * gap).sum(1)
    return out if kind is object else out.astype(np.int64)


def step(x: np.ndarray, points: np.ndarray, cent: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """New cluster and bounds of each row, and how many rows met all centroids."""
    cluster = cluster.copy()
    upper, lower = upper + cent.drift[cluster], lower - cent.other_drift[cluster]
    bound = np.maximum(lower, cent.half_gap[cluster])
    placed = cluster >= 0
    unsure = np.flatnonzero(placed & ~(upper < bound))
    upper[unsure] = _up(own_distances(x[unsure], points, cluster[unsure]))
    unsure = np.flatnonzero(~placed | ~(upper < bound))
    if len(unsure):
        found, rows = all_distances(x[unsure], points), np.arange(len(unsure))
        best = found.argmin(1)  # the first of equals
        cluster[unsure], upper[unsure] = best, _up(found[rows, best])
        found[rows, best] = found.max(1)
        lower[unsure] = _down(found.min(1)) if found.shape[1] > 1 else np.inf
    return cluster, upper, lower, len(unsure)


def _rows(batch, n: int) -> np.ndarray:
    """(rows, n) of the vectors."""
    at = batch.column("x").offsets.to_numpy()
    return batch.column("x").values.to_numpy()[at[0] : at[-1]].reshape(-1, n)


def _started(n: int):
    """Vectors as whole numbers, without a cluster yet."""

    def run(batches):
        for batch in batches:
            at, rows = batch.column(1).offsets.to_numpy(), batch.num_rows
            x = whole(batch.column(1).values.to_numpy(zero_copy_only=False)[at[0] : at[-1]])
            none = pa.array(np.full(rows, -1, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(np.arange(0, rows * n + 1, n, dtype=np.int32), x), none, none, pa.array(np.full(rows, np.inf)), pa.array(np.full(rows, -np.inf)), pa.nulls(rows, pa.int64())],
                ["vec_id", "x", "cluster", "before", "upper", "lower", "distance"],
            )

    return run


def _assigned(shared, n: int, last: bool):
    """One round over written vectors; ``last``: with exact distances, the largest long at most."""

    def run(batches):
        cent = shared.value
        points = np.array(cent.points, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, old = _rows(batch, n), batch.column("cluster").to_numpy()
                cluster, upper, lower, _ = step(x, points, cent, old, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                far = pa.array([min(int(v), LONG) for v in own_distances(x, points, cluster)] if last else [None] * len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster), pa.array(old), pa.array(upper), pa.array(lower), far], ["vec_id", "x", "cluster", "before", "upper", "lower", "distance"])

    return run


def _moves(k: int, n: int):
    """What a task's moved vectors add to each cluster and take from it: a row a cluster, with sums as decimal text."""

    def run(batches):
        sums, counts = np.zeros((k, n), object), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch, n)
            x = x if max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) < FAR else x.astype(object)
            for which, sign in ((batch.column("cluster").to_numpy(), 1), (batch.column("before").to_numpy(), -1)):
                for c in np.unique(which[which >= 0]):
                    sums[c] += sign * x[which == c].sum(0).astype(object)
                    counts[c] += sign * int((which == c).sum())
        full = [c for c in range(k) if counts[c] or any(sums[c])]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array([[str(v) for v in sums[c]] for c in full], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    return run


def first_centroids(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` rows of the least sha256 of seed:vec_id; of equal ids the lesser vector first, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "embedding").orderBy(F.asc_nulls_last("key"), "embedding").limit(k).collect()
    return [whole(np.array(r.embedding, np.float64)).tolist() for r in rows]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``dimensions`` components.

    Components count as floor(256 * x); vectors of another length, null ones and
    those with a null or non-finite component are left out. The ``k`` centroids
    start as the vectors of the least sha256 of ``seed:vec_id`` (fewer, if there
    are fewer vectors), are moved ``rounds`` times to the floor of their vectors'
    mean, and then every vector is assigned once more. Ties go to the smaller
    number; an empty centroid stays where it is. distance is the squared
    Euclidean one; sums of it and distances beyond a long show as the largest
    long. Components beyond +-2**62 count as that.
    Null ids are vectors like others, but start no centroid while others can.
    Repeated rows count and are returned each. No vectors give no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "clustering")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.size("embedding") == dimensions).where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    points = first_centroids(kept, k, seed)
    if not points:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    cent = Centroids(points)
    state = scratch.keep(kept.mapInArrow(_started(dimensions), STATE), "state-start")
    sums, counts = np.zeros((len(points), dimensions), object), np.zeros(len(points), object)
    names = ["state-start"]
    for at in range(rounds + 1):
        shared = spark.sparkContext.broadcast(cent)  # k vectors
        state = scratch.keep(state.mapInArrow(_assigned(shared, dimensions, at == rounds), STATE), f"state-{at}")
        scratch.drop(names.pop())
        names.append(f"state-{at}")
        if at < rounds:
            moved = state.where("cluster <> before").select("x", "cluster", "before").mapInArrow(_moves(len(points), dimensions), "cluster int, n long, sums array<string>")
            total = moved.select("cluster", "n", F.posexplode("sums").alias("place", "sum")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
            for r in total.collect():  # k * dimensions numbers at most
                sums[r.cluster, r.place] += int(r["sum"])
                counts[r.cluster] += r.n if r.place == 0 else 0
            before, points = points, [[int(s) // int(c) for s in row] if c else old for row, c, old in zip(sums, counts, points)]
            cent = Centroids(points, before)
    short = lambda c: F.least(c, F.lit(LONG)).cast("long")
    inertia = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(points)], "cluster int, centroid_sha256 string")
    facts = inertia.withColumn("all", F.sum("sum").over(Window.partitionBy())).join(digests, "cluster")  # a row a cluster
    facts = facts.select("cluster", short(F.col("sum")).alias("cluster_inertia"), short(F.col("all")).alias("inertia"), "centroid_sha256")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
