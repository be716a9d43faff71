"""Sharding by vector bin packing: bytes, tokens and rows balanced together, groups of equal texts kept whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import stored

from .common import numbered, whole_text, word_count

SHARDS = 8
BUNDLES = 4096  # small groups are placed in bundles, by the first three digits of their text's hash
HEAVY_SHARE = 1 / 512  # of a shard, in any dimension: groups above are placed one by one
WEIGHTS = (1.0, 0.5, 0.5)  # of bytes, tokens and rows in the dot product
ROWS_PER_PART = 200_000


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item, given its share of all (bytes, tokens, rows).

    Items go largest first, each to the shard where the dot product of the item with what the shard has left is
    highest, among the shards where its bytes fit if there are any. A last pass moves or swaps items between the
    fullest and the emptiest shard while that brings their bytes closer.
    """
    vectors, scale = items * shards, np.array(weights)
    left, where = np.ones((shards, items.shape[1])), np.zeros(len(items), dtype=np.int32)
    for k in np.lexsort((np.arange(len(items)), -vectors[:, 0])):
        gain = left @ (vectors[k] * scale)
        fits = left[:, 0] >= vectors[k, 0]
        where[k] = int(np.argmax(np.where(fits, gain, gain - 1e6) if fits.any() else left[:, 0]))
        left[where[k]] -= vectors[k]
    for _ in range(16 * shards):
        full, empty = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        gap = left[empty, 0] - left[full, 0]
        own, other = np.flatnonzero(where == full), np.flatnonzero(where == empty)
        move = vectors[own, 0]
        better = np.abs(gap - 2 * move)
        best = int(np.argmin(better)) if len(own) else -1
        swap = None
        if len(own) and len(other):
            theirs = other[np.argsort(vectors[other, 0], kind="stable")]
            at = np.searchsorted(vectors[theirs, 0], move - gap / 2).clip(0, len(theirs) - 1)
            swapped = np.abs(gap - 2 * (move - vectors[theirs[at], 0]))
            if swapped.min() < (better[best] if best >= 0 else gap):
                swap = (own[int(np.argmin(swapped))], theirs[at[int(np.argmin(swapped))]])
        after = min(better[best] if best >= 0 else gap, swapped.min() if swap else gap)
        if not after < gap * 0.999:
            break
        for k, to in ([(swap[0], empty), (swap[1], full)] if swap else [(own[best], empty)]):
            left[where[k]] += vectors[k]
            left[to] -= vectors[k]
            where[k] = to
    return where


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1; null text has none and equals the empty text. Equal texts share a shard, so
    a group larger than a shard's fair part makes its shard the larger one; otherwise sizes are near equal (law
    `bytes`), and tokens and rows follow as far as they can. slot numbers a shard's rows from 0. Rows repeated as a
    whole have slots of their own; an empty table gives no rows; further columns are ignored.

    A group is placed on its own if it has over 1/512 of a shard in any dimension: at most 3 * 512 * shards groups,
    however large the table. The others are placed in 4,096 bundles. So the table of items has a fixed bound, and is
    all that the driver and the broadcasts hold.
    """
    spark = docs.sparkSession
    text = whole_text(docs)
    narrow = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), word_count(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("_sha"),
    ).withColumn("_bundle", F.conv(F.substring("_sha", 1, 3), 16, 10).cast("int")), "shard-sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = narrow.agg(*sums).first()
    totals = [max(1, total[k] or 0) for k in ("bytes", "tokens", "rows")]
    limit = [t / shards * HEAVY_SHARE for t in totals]
    groups = narrow.groupBy("_sha", "_bundle").agg(*sums)
    heavy = (F.col("bytes") > limit[0]) | (F.col("tokens") > limit[1]) | (F.col("rows") > limit[2])
    items = (
        groups.groupBy(F.when(heavy, F.col("_sha")).alias("sha"), F.when(~heavy, F.col("_bundle")).alias("bundle"))
        .agg(*[F.sum(k).alias(k) for k in ("bytes", "tokens", "rows")]).orderBy("sha", "bundle").collect()
    )
    vectors = np.array([[r[k] / t for k, t in zip(("bytes", "tokens", "rows"), totals)] for r in items]).reshape(-1, 3)
    placed = [(r["sha"], r["bundle"], int(s)) for r, s in zip(items, place(vectors, shards))]
    alone = spark.createDataFrame([(a, s) for a, _, s in placed if a], "_sha string, _alone int")
    together = spark.createDataFrame([(b, s) for a, b, s in placed if not a], "_bundle int, _together int")
    rows = (
        narrow.join(F.broadcast(alone), "_sha", "left").join(F.broadcast(together), "_bundle", "left")
        .select("doc_id", "size", "tokens", "text_crc32", F.coalesce("_alone", "_together").alias("shard"))
    )
    slots = numbered(rows, "shard", ["doc_id", "text_crc32"], "slot", "doc_id", max(64, totals[2] // ROWS_PER_PART))
    return slots.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
