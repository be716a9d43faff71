import hashlib
import math
import random

import numpy as np
import pytest

from lectura.llm import centroids
from lectura.llm.centroids import Tree, cluster

ROWS = "vec_id long, embedding array<float>"


def plain(rows, clusters, rounds, size):
    """The contract, by all distances of Python integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for k, own in members.items():
            centers[k] = [sum(x) // len(own) for x in zip(*own)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {k: sum(d for _, c, d in placed if c == k) for k in range(len(centers))}
    return sorted(((i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest())
                   for i, k, d in placed), key=str)


def vectors(n, size, seed, spread=1.0, steps=0):
    rnd = random.Random(seed)
    value = lambda: rnd.choice(range(-steps, steps + 1)) / 256 if steps else rnd.gauss(0, spread)
    return [(k, [float(np.float32(value())) for _ in range(size)]) for k in range(n)]


@pytest.mark.parametrize("rows, clusters", [
    (vectors(300, 8, 1), 10),
    (vectors(300, 8, 2, steps=1), 12),  # many ties and equal centroids
    (vectors(200, 8, 3, spread=20_000.0), 9),  # beyond what a double holds
    (vectors(5, 8, 4), 40),
    ([(1, [0.5] * 8)] * 30 + [(2, [-0.5] * 8), (None, [0.1] * 8), (None, [0.2] * 8)], 6),
])
def test_rounds_match_all_distances(spark, rows, clusters):
    unfit = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [1.0] * 7 + [float("nan")]), (905, [1.0] * 7 + [float("inf")])]
    got = cluster(spark.createDataFrame(rows + unfit, ROWS).repartition(3), clusters, 4, 8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, clusters, 4, 8)


def test_empty_tables_own_columns_and_too_large_components(spark):
    assert cluster(spark.createDataFrame([], ROWS)).collect() == []
    assert cluster(spark.createDataFrame([(1, None)], ROWS)).collect() == []
    own = spark.createDataFrame([(1, [0.25, 1.0], 5, 6), (2, [1e30, 0.0], 7, 8)], "vec_id long, embedding array<float>, cluster int, distance int")
    got = cluster(own, size=2).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got] == [(1, 0, 0, 0)]


def test_the_tree_prunes_and_keeps_ties(monkeypatch):
    rng = np.random.default_rng(3)
    for size, top in ((1, 5), (2, 40), (3, 1 << 26)):
        centers = rng.integers(-top, top, (60, size))
        centers[30:40] = centers[:10]
        vectors = np.concatenate([rng.integers(-top, top, (500, size)), centers])
        away = ((vectors[:, None].astype(object) - centers[None].astype(object)) ** 2).sum(axis=2)
        number, distance = Tree(centers).nearest(vectors)
        assert [min(range(60), key=lambda k: (row[k], k)) for row in away.tolist()] == number.tolist()
        assert [min(row) for row in away.tolist()] == distance.tolist()
    measured = []
    whole = centroids.squared
    tree = Tree(np.array([[10 * k] for k in range(64)]))
    monkeypatch.setattr(centroids, "squared", lambda a, b: measured.append(len(a) * len(b)) or whole(a, b))
    tree.nearest(np.arange(0, 640, 7)[:, None])
    assert sum(measured) < 0.35 * 64 * 92
