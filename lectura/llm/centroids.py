"""Centroid clustering on integers, with a vantage-point tree over the centroids.

Each round builds the tree anew, broadcasts it, and every vector finds its nearest centroid in it by best-first
branch and bound. Distances are exact integers; bounds only decide what is looked at, and inclusively, so that ties
are always seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import ship, stored

# Fixed values of the contract.
SIZE = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
SCALE = 256

LEAF = 4  # centroids below which a subtree is a list
LARGEST = 1 << 27  # of a component; squared distances of 64 of these differences fit 63 bits
IN_DOUBLE = 1 << 22  # up to here sums of 64 products are exact in double precision too
SLACK = 1e-9  # relative; far more than the rounding of a bound
TOGETHER = 4096  # vectors searched at once


@dataclass
class Node:
    """A subtree: its own centroids, and for an inner node the distances of the first of them to each child's."""

    members: list[int]
    children: list[tuple[int, float, float]]  # (node, nearest, farthest)


class Tree:
    """Vantage-point tree over integer centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.nodes = centroids, []
        self._grow(np.arange(len(centroids)))

    def _grow(self, own: np.ndarray) -> int:
        """The first of a subtree's centroids is its vantage point; the others are halved by their distance to it."""
        at = len(self.nodes)
        self.nodes.append(Node(own.tolist(), []))
        if len(own) > LEAF:
            node, rest = self.nodes[at], own[1:]
            node.members = own[:1].tolist()
            away = squared(self.centroids[own[:1]], self.centroids[rest])[0]
            order = np.argsort(away, kind="stable")
            for half in np.array_split(order, 2):
                child = self._grow(rest[np.sort(half)])
                node.children.append((child, float(np.sqrt(away[half].min())), float(np.sqrt(away[half].max()))))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number.

        Every vector keeps a bound for each subtree that it has met, opens the one with the least bound, and is done
        when that bound is larger than its best distance. A bound that equals the best distance is still opened.
        Vectors that open the same subtree are measured together.
        """
        n = len(vectors)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        bounds = np.full((n, len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        todo = np.arange(n)
        while len(todo):
            opened = bounds[todo].argmin(axis=1)
            low = bounds[todo, opened]
            going = low <= np.sqrt(best[todo].astype(np.float64)) * (1 + SLACK)
            todo, opened, low = todo[going], opened[going], low[going]
            for k in np.unique(opened):
                rows, least, node = todo[opened == k], low[opened == k], self.nodes[k]
                bounds[rows, k] = np.inf
                away = squared(vectors[rows], self.centroids[node.members])
                first = away.argmin(axis=1)  # members are in ascending order
                found, which = away[np.arange(len(rows)), first], np.array(node.members)[first]
                better = (found < best[rows]) | ((found == best[rows]) & (which < number[rows]))
                best[rows[better]], number[rows[better]] = found[better], which[better]
                distance = np.sqrt(away[:, 0].astype(np.float64))
                for child, near, far in node.children:
                    bound = np.maximum(distance - far, near - distance) - SLACK * (distance + far)
                    bounds[rows, child] = np.maximum(least, bound)
            todo = todo[np.isfinite(bounds[todo]).any(axis=1)]
        return number, best


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= IN_DOUBLE:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def usable(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, as doubles."""
    vector = F.col("embedding").cast("array<double>")
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE > LARGEST))
    return rows.select("vec_id", vector.alias("embedding")).where((F.size(vector) == size) & ~unfit)


def whole(column: pa.Array, size: int) -> np.ndarray:
    """The integer vectors of an Arrow list column."""
    return np.floor(np.asarray(column.flatten()).reshape(-1, size) * SCALE).astype(np.int64)


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    Vectors with exactly `size` components, none null or non-finite, take part, as integers floor(256 * x); components
    of which that is beyond 2^27 are counted as non-finite, since their distances do not fit a long. The first centroids
    are the vectors with the smallest sha256 of `seed:vec_id` (no id: nothing after the colon), equal ids by their
    components. Repeated rows count as often as they occur; fewer vectors than clusters give fewer clusters; empty tables
    give no rows. Further columns are ignored.

    The driver holds the centroids, and gets one sum per cluster and component a round. Vectors are stored once and
    read by every round; inertias are null should they not fit a long.
    """
    spark = ship(rows.sparkSession)
    vectors = stored(usable(rows, size), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = vectors.orderBy(key, "embedding").limit(clusters).select("embedding").toArrow().column("embedding").to_pylist()
    centroids = whole(pa.array(seeds, pa.list_(pa.float64())), size)

    def batches_of(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple]:
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.slice(k, TOGETHER)
                ints = whole(part.column("embedding"), size)
                yield part, ints, *tree.nearest(ints)

    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(Tree(centroids))

        def add(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((clusters, size), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
            for _, ints, number, _ in batches_of(batches, tree.value):
                np.add.at(sums, number, ints)
                counts += np.bincount(number, minlength=clusters)
                if counts.sum() * LARGEST >= 1 << 60:
                    yield summed(sums, counts)
                    sums[:], counts[:] = 0, 0
            yield summed(sums, counts)

        total = (
            vectors.select("embedding").mapInArrow(add, "cluster int, n long, sums array<long>")
            .select("cluster", "n", F.posexplode("sums").alias("at", "value"))
            .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        )
        for r in total.collect():  # clusters x components at most
            centroids[r["cluster"], r["at"]] = int(r["value"]) // int(r["n"])
        tree.unpersist()

    tree = spark.sparkContext.broadcast(Tree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, distance in batches_of(batches, tree.value):
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    placed = stored(vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clustered")
    sums = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    per_cluster = spark.createDataFrame(
        [(k, fits(sums.get(k, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for k, c in enumerate(centroids.tolist())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per_cluster), "cluster").select(  # a row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def summed(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    held = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), pa.array(counts[held], pa.int64()), pa.array(sums[held].tolist(), pa.list_(pa.int64()))],
        names=["cluster", "n", "sums"])
