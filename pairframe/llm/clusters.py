"""Exact k-means on integer vectors with geometric drift tightening.

Vectors are packed into blocks once. A block carries, for each vector, its cluster, an upper
bound of the distance to its own centroid and a lower bound of the distance to all others; one
pass over the blocks is one round of assignment and also yields the sums of the next centroids.

When centroids move, a lower bound must be loosened by at most the drift of another centroid.
Geometry allows less. Let a cluster's vectors lie in a ball around its centroid and let another
centroid move from p to q with midpoint M. For a vector x, |x-q| - |x-p| is
-2|q-p| s / (|x-q| + |x-p|), where s is the part of x-M along the move, and |x-q| + |x-p| is at
least 2|x-M|. So the distance shrinks by at most |q-p| cos(angle between x-M and the move). In
the plane of the ball's centre, p and q, the ball is seen from M within asin(radius / distance)
of its centre's direction, which bounds that angle for all its vectors at once.

A vector whose upper bound stays below its lower bound, or below half the way to the nearest
other centroid, keeps its cluster; all others are measured in integers against every centroid.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairframe.llm.common import Workspace

BLOCK = 4_096
#: Components are held below this size, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Bounds are floating point; they decide only with this relative and absolute distance.
MARGIN = 1e-9

_BLOCK_SCHEMA = (
    "ids array<bigint>, vectors binary, clusters binary, upper binary, lower binary, totals array<bigint>, scanned bigint"
)
_BLOCK = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("vectors", pa.binary()),
        ("clusters", pa.binary()),
        ("upper", pa.binary()),
        ("lower", pa.binary()),
        ("totals", pa.list_(pa.int64())),
        ("scanned", pa.int64()),
    ]
)


def loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """Most that the distance of any point of a ball can shrink when `old` moves to `new`."""
    move = new - old
    drift = float(np.linalg.norm(move))
    if drift == 0.0:
        return 0.0
    sight = centre - (old + new) / 2
    away = float(np.linalg.norm(sight))
    if radius >= away:  # the midpoint lies in the ball: no direction is excluded
        return drift
    turn = math.acos(max(-1.0, min(1.0, float(sight @ move) / (away * drift))))
    nearest = turn - math.asin(radius / away)
    return drift * max(0.0, math.cos(max(0.0, nearest)))


class Step:
    """What a round tells the blocks: centroids, their drifts and the loosening per cluster."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None, radii: list[float] | None = None):
        self.centroids = np.array(centroids, np.int64)
        new, k = self.centroids.astype(float), len(centroids)
        apart = np.linalg.norm(new[:, None] - new[None], axis=2) + np.diag(np.full(k, np.inf))
        self.half = apart.min(axis=1) / 2
        self.drift = self.loosen = np.zeros(k)
        if before is not None:
            old = np.array(before, float)
            self.drift = np.linalg.norm(new - old, axis=1)
            self.loosen = np.array(
                [max((loosening(old[i], radii[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) for i in range(k)]
            )


def _squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((vectors - centroids) ** 2).sum(axis=-1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, its distance, distance of the next one); ties go to the smaller number."""
    squares = np.stack([_squared(vectors, c) for c in centroids], axis=1)
    own = squares.argmin(axis=1)
    every = np.arange(len(vectors))
    upper = np.sqrt(squares[every, own].astype(float))
    if len(centroids) == 1:
        return own, upper, np.full(len(vectors), np.inf)
    return own, upper, np.sqrt(np.partition(squares, 1, axis=1)[:, 1].astype(float))


def reassign(vectors, own, upper, lower, step: Step) -> int:
    """Update clusters and bounds in place; returns how many vectors were measured in full."""
    upper += step.drift[own]
    lower -= step.loosen[own]

    def open_ones(rows):
        limit = np.maximum(lower[rows], step.half[own[rows]])
        return rows[~(upper[rows] * (1 + MARGIN) + MARGIN < limit)]

    rows = open_ones(np.arange(len(own)))
    upper[rows] = np.sqrt(_squared(vectors[rows], step.centroids[own[rows]]).astype(float))
    rows = open_ones(rows)
    if len(rows):
        own[rows], upper[rows], lower[rows] = nearest(vectors[rows], step.centroids)
    return len(rows)


def _block(ids, vectors: np.ndarray, own, upper, lower, k: int, scanned: int) -> pa.RecordBatch:
    """A row with the block's state and its totals: sums, sizes and radii of the clusters."""
    sums = np.zeros((k, vectors.shape[1]), np.int64)
    radii = np.zeros(k, np.int64)
    for j in range(k):
        members = own == j
        if members.any():
            sums[j] = vectors[members].sum(axis=0)
            radii[j] = math.ceil(upper[members].max() * (1 + MARGIN)) + 1
    totals = np.concatenate([sums.ravel(), np.bincount(own, minlength=k), radii])
    small = vectors.astype("<i2") if not len(vectors) or np.abs(vectors).max() < 1 << 15 else vectors.astype("<i8")
    return pa.RecordBatch.from_pydict(
        {
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "vectors": [small.tobytes()],
            "clusters": [own.astype("<i4").tobytes()],
            "upper": [upper.astype("<f8").tobytes()],
            "lower": [lower.astype("<f8").tobytes()],
            "totals": pa.array([totals.tolist()], pa.list_(pa.int64())),
            "scanned": [scanned],
        },
        schema=_BLOCK,
    )


def _unpacked(row: dict, dim: int):
    n = len(row["ids"])
    kind = "<i2" if len(row["vectors"]) == 2 * n * dim else "<i8"
    vectors = np.frombuffer(row["vectors"], kind).reshape(n, dim).astype(np.int64)
    own = np.frombuffer(row["clusters"], "<i4").astype(np.int64)
    return row["ids"], vectors, own, np.frombuffer(row["upper"], "<f8").copy(), np.frombuffer(row["lower"], "<f8").copy()


def _packed(rows: DataFrame, step: Step, scale: int, dim: int) -> DataFrame:
    """Blocks of the kept vectors after the first assignment; rows stay in their partition."""
    k = len(step.centroids)

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
                floors = np.floor(values * scale)
                if np.abs(floors).max(initial=0) >= LARGEST:
                    raise OverflowError(f"a component reaches {LARGEST} after scaling; squared distances need more than 64 bits")
                vectors = floors.astype(np.int64)
                own, upper, lower = nearest(vectors, step.centroids)
                yield _block(part.column(0).to_pylist(), vectors, own, upper, lower, k, len(own))

    return rows.mapInArrow(pack, _BLOCK_SCHEMA)


def _moved(blocks: DataFrame, step: Step, dim: int) -> DataFrame:
    """The blocks after one more assignment."""
    k = len(step.centroids)

    def move(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, own, upper, lower = _unpacked(batch.slice(i, 1).to_pylist()[0], dim)
                scanned = reassign(vectors, own, upper, lower, step)
                yield _block(ids, vectors, own, upper, lower, k, scanned)

    return blocks.mapInArrow(move, _BLOCK_SCHEMA)


def _members(blocks: DataFrame, step: Step, dim: int) -> DataFrame:
    """(vec_id, cluster, distance) of the state in the blocks."""

    def unfold(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, own, _, _ = _unpacked(batch.slice(i, 1).to_pylist()[0], dim)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(own.astype(np.int32)),
                        pa.array(_squared(vectors, step.centroids[own])),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    return blocks.select("ids", "vectors", "clusters", "upper", "lower").mapInArrow(
        unfold, "vec_id bigint, cluster int, distance bigint"
    )


def usable(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector has `dim` components, none null or non-finite."""
    x = F.col(vector_col)
    whole = (F.size(x) == dim) & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    )
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("vector")).filter(whole)


def _totals(blocks: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int], list[int]]:
    """Sums, sizes and radii of all clusters: k * (dim + 2) numbers, whatever the table's size."""
    pairs = blocks.select(F.posexplode("totals").alias("pos", "x"))
    rows = pairs.groupBy("pos").agg(F.sum("x").alias("sum"), F.max("x").alias("max")).collect()
    total = {r["pos"]: r["sum"] for r in rows}
    greatest = {r["pos"]: r["max"] for r in rows}
    sums = [[total[j * dim + i] for i in range(dim)] for j in range(k)]
    sizes = [total[k * dim + j] for j in range(k)]
    return sums, sizes, [greatest[k * dim + k + j] for j in range(k)]


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dim: int = 64,
    scale: int = 1024,
    seed: str = "3:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    history: list[tuple[int, int]] | None = None,
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), centroids) after `rounds` rounds and a last assignment.

    A component x is floor(scale * x). The first centroids are the k kept vectors with the
    smallest sha256 of seed and id (fewer, if fewer vectors are kept; equal ids by their
    vectors; null ids last). Vectors with another number of components, or a null or
    non-finite one, are left out. Rows that repeat are vectors of their own. `history` takes
    (vectors measured in full, all vectors) of each assignment.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "clusters")
    rows = usable(vectors, dim, id_col, vector_col)
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "vector").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    centroids = [[math.floor(float(x) * scale) for x in r["vector"]] for r in first]
    k = len(centroids)
    step = Step(centroids)
    blocks = work.save(_packed(rows, step, scale, dim), "assigned")
    for _ in range(rounds):
        sums, sizes, radii = _totals(blocks, k, dim)
        if history is not None:
            history.append((blocks.agg(F.sum("scanned")).first()[0], sum(sizes)))
        moved = [[s // n for s in row] if n else centroids[j] for j, (row, n) in enumerate(zip(sums, sizes))]
        step = Step(moved, centroids, radii)
        centroids = moved
        after = work.save(_moved(blocks, step, dim), "assigned")
        work.drop(blocks)
        blocks = after
    if history is not None:
        history.append((blocks.agg(F.sum("scanned")).first()[0], sum(sizes)))
    members = work.save(_members(blocks, step, dim), "members")
    work.drop(blocks)
    return members, centroids


def clustered_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors that are null, of another length than 64, or with a null or non-finite component
    are left out; repeated rows are kept each; a null vec_id stays null. Other columns are not
    read. An empty table gives an empty result.
    """
    members, centroids = cluster(vectors)
    sums = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    held = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}  # one row per cluster
    total = sum(held.values())
    rows = [
        (j, held.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for j, c in enumerate(centroids)
    ]
    facts = members.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return members.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
