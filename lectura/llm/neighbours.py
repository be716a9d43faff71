"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts, and a small classifier learns in which parts a
vector's neighbours lie. Every row is indexed under its most probable part; a query visits its most probable parts, as
many as a held-out share of the sample needed for the wanted recall, and ranks all their rows exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectura.session import ship, stored

from .common import map_rows

SAMPLE = 3000  # vectors that the graph, the parts and the classifier are made of, at most
PARTS = 16
LINKS = 10  # neighbours of a vector in the graph
HIDDEN, STEPS, RATE = 64, 300, 0.01
RECALL = 0.97  # wanted on the held-out part of the sample
NEAREST = 5
BLOCK = 16_384  # rows, or queries, of a part that meet in one task
MARGIN = 1e-9  # between the fast product and the exact measure


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector that is finite, complete and not zero."""
    vector = F.col("embedding").cast("array<double>")
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~unfit & F.exists(vector, lambda x: x != 0))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs of rows, in double precision; equal rows give equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


# --- fitting on the sample --------------------------------------------------------------------------------------------


def graph(similar: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Symmetric 0/1 adjacency of the nearest neighbours; `similar` has -inf on its diagonal."""
    near = np.argpartition(-similar, min(links, len(similar) - 1) - 1, axis=1)[:, :links]
    adjacent = np.zeros(similar.shape, dtype=np.float32)
    np.put_along_axis(adjacent, near, 1.0, axis=1)
    np.fill_diagonal(adjacent, 0)
    return np.maximum(adjacent, adjacent.T)


def halves(adjacent: np.ndarray, seed: int) -> np.ndarray:
    """Cut a graph into two equal halves with few edges between: a spectral order, then swaps that shrink the cut."""
    n = len(adjacent)
    degree = adjacent.sum(axis=1) + 1e-9
    x = np.random.default_rng(seed).standard_normal(n)
    for _ in range(60):
        x = 0.5 * (x + adjacent @ (x / np.sqrt(degree)) / np.sqrt(degree))
        x -= np.sqrt(degree) * (np.sqrt(degree) @ x) / degree.sum()
        x /= np.linalg.norm(x) + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(x, kind="stable")[n // 2:]] = True

    def cut(s: np.ndarray) -> float:
        return float((adjacent @ s.astype(np.float32))[~s].sum())

    best = cut(side)
    for _ in range(20):
        over = adjacent @ side.astype(np.float32)
        gain = np.where(side, degree - 2 * over, 2 * over - degree)
        zeros, ones = np.flatnonzero(~side), np.flatnonzero(side)
        zeros, ones = zeros[np.argsort(-gain[zeros], kind="stable")], ones[np.argsort(-gain[ones], kind="stable")]
        m = min(len(zeros), len(ones), max(1, n // 40))
        good = gain[zeros[:m]] + gain[ones[:m]] > 0
        trial = side.copy()
        trial[zeros[:m][good]], trial[ones[:m][good]] = True, False
        if not good.any() or (now := cut(trial)) >= best:
            break
        side, best = trial, now
    return side


def balanced_parts(adjacent: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Part of each node; sizes differ by one at most, as `parts` is a power of two."""
    label = np.zeros(len(adjacent), dtype=np.int64)
    for level in range(parts.bit_length() - 1):
        for k in range(1 << level):
            own = np.flatnonzero(label == k)
            if len(own) > 1:
                label[own[halves(adjacent[np.ix_(own, own)], level * parts + k)]] += 1 << level
    return label


class Router:
    """A network with one hidden layer: the chance that a vector's neighbours lie in each part."""

    def __init__(self, weights: list[np.ndarray], probes: int):
        self.weights, self.probes = weights, probes

    @classmethod
    def fit(cls, vectors: np.ndarray, parts: int = PARTS, recall: float = RECALL, nearest: int = NEAREST) -> "Router":
        """On unit vectors, of which every fifth is only used to choose the number of parts to visit."""
        n, size = vectors.shape
        parts = max(1, min(parts, 1 << max(0, (n // 8).bit_length() - 1)))
        if n < 2 or parts == 1:
            return cls([np.zeros((size, 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts)], parts)
        similar = vectors @ vectors.T
        np.fill_diagonal(similar, -np.inf)
        adjacent = graph(similar)
        label = balanced_parts(adjacent, parts)
        own = np.eye(parts)[label]
        wanted = adjacent @ own + own
        wanted /= wanted.sum(axis=1, keepdims=True)
        held = np.arange(n) % 5 == 4
        rng = np.random.default_rng(7)
        weights = [rng.standard_normal((size, HIDDEN)) * 2 / np.sqrt(size), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        mean, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        x, y = vectors[~held], wanted[~held]
        for step in range(1, STEPS + 1):
            hidden = np.tanh(x @ weights[0] + weights[1])
            wrong = (_softmax(hidden @ weights[2] + weights[3]) - y) / len(x)
            back = (wrong @ weights[2].T) * (1 - hidden**2)
            for k, slope in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0))):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                spread[k] = 0.999 * spread[k] + 0.001 * slope**2
                weights[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
        router = cls(weights, parts)
        order = router.order(vectors)
        place = np.empty_like(order)  # of each part in a vector's order
        np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(n, axis=0), axis=1)
        near = np.argpartition(-similar[held], min(nearest, n - 1) - 1, axis=1)[:, :nearest]
        visit = np.take_along_axis(place[held], order[near, 0], axis=1)
        shares = [(visit < m).mean() for m in range(1, parts + 1)]
        router.probes = next(m for m, s in enumerate(shares, 1) if s >= recall or m == parts)
        return router

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """All parts, most probable first, for unit vectors."""
        a, b, c, d = self.weights
        return np.argsort(-(np.tanh(vectors @ a + b) @ c + d), axis=1, kind="stable")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- searching over all rows ------------------------------------------------------------------------------------------


def nearest_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, nearest: int = NEAREST) -> pd.DataFrame:
    """Exact best rows of a block for each query: query_id, vec_id, score.

    Copies of a vector are compared once; of their ids the smallest stand for all, as many as can be wanted. A fast
    product chooses whatever lies within MARGIN of the best, and these are measured exactly.
    """
    sorted_by = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[sorted_by], row_ids[sorted_by]
    _, first, group = np.unique(rows.view(f"V{rows.dtype.itemsize * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    nth = np.arange(len(group)) - np.searchsorted(group[by_group], group[by_group])
    by_group = by_group[nth <= nearest]
    bounds = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    distinct, units = rows[first], unit(rows[first])
    found = []
    for k in range(0, len(queries), 256):
        q, ids = queries[k:k + 256], query_ids[k:k + 256]
        fast = unit(q) @ units.T
        kept = min(nearest + 1, fast.shape[1])
        least = np.partition(fast, fast.shape[1] - kept, axis=1)[:, fast.shape[1] - kept]
        at, col = np.nonzero(fast >= least[:, None] - MARGIN)
        score = cosine(q[at], distinct[col])
        n = bounds[col + 1] - bounds[col]
        each = np.repeat(np.arange(len(at)), n)
        member = by_group[np.repeat(bounds[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        frame = pd.DataFrame({"query_id": ids[at[each]], "vec_id": row_ids[member], "score": score[each]})
        frame = frame[frame["query_id"] != frame["vec_id"]].drop_duplicates()
        frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        found.append(frame.groupby("query_id").head(nearest))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(rows: DataFrame, every: int, nearest: int = NEAREST, sample: int = SAMPLE, parts: int = PARTS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found for every row whose vec_id is divisible by `every`.

    Candidates are all rows but the query's own; nearest first, ties to the smaller vec_id; all candidates if there are
    fewer. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or
    with another dimension than most of the sample. An id that occurs twice counts once, with its best score. Empty
    tables give no rows; further columns are ignored.

    Parts are searched in blocks of bounded size on both sides, so that neither a crowded part nor the number of
    queries decides what a task holds. The driver sees the sample and two counts per part.
    """
    spark = ship(rows.sparkSession)
    fit = usable(rows)
    taken = fit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("embedding").to_pylist()
    sizes = pd.Series([len(v) for v in taken])
    size = int(sizes.mode()[0]) if len(sizes) else 1
    vectors = np.array([v for v in taken if len(v) == size], dtype=np.float64).reshape(-1, size)
    router = Router.fit(unit(vectors) if len(vectors) else vectors, parts, recall, nearest)

    def route(ids: list[int], embeddings: list[list[float]]) -> dict:
        order = router.order(unit(np.array(embeddings, dtype=np.float64).reshape(-1, size))) if ids else np.zeros((0, 1), dtype=np.int64)
        return {"parts": [o[:router.probes] if i % every == 0 else o[:1] for i, o in zip(ids, order.tolist())]}

    routed = stored(
        map_rows(fit.where(F.size("embedding") == size), route, "parts array<int>", ["vec_id", "embedding"], ["vec_id", "embedding"])
        .withColumn("_hash", F.xxhash64("vec_id")), "routed-vectors")
    is_query = F.col("vec_id") % every == 0
    indexed = routed.withColumn("part", F.element_at("parts", 1))
    asked = routed.where(is_query).withColumn("part", F.explode("parts"))
    n_rows = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    n_asked = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = spark.createDataFrame(
        [(p, -(-n // block), -(-n_asked[p] // block)) for p, n in n_rows.items() if p in n_asked], "part int, _row_blocks int, _query_blocks int")
    placed = [
        side.join(F.broadcast(blocks), "part")
        .withColumn("rb", rb).withColumn("qb", qb).select("part", "rb", "qb", "vec_id", "embedding", F.lit(kind).alias("kind"))
        for side, kind, rb, qb in (
            (indexed, 0, F.pmod("_hash", "_row_blocks"), F.explode(F.sequence(F.lit(0), F.col("_query_blocks") - 1))),
            (asked, 1, F.explode(F.sequence(F.lit(0), F.col("_row_blocks") - 1)), F.pmod("_hash", "_query_blocks")),
        )
    ]

    def rank(frame: pd.DataFrame) -> pd.DataFrame:
        asks = (frame["kind"] == 1).to_numpy()
        ids, vectors = frame["vec_id"].to_numpy(), np.stack(frame["embedding"].to_numpy()).astype(np.float64)
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})
        return nearest_of_block(vectors[asks], ids[asks], vectors[~asks], ids[~asks], nearest)

    local = placed[0].unionByName(placed[1]).groupBy("part", "rb", "qb").applyInPandas(rank, "query_id long, vec_id long, score double")
    best = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
