"""Near-deduplication for the pipeline: texts of which the sets of five-word shingles have a Jaccard similarity of 0.8.

Fingerprints of the shingles meet in the self-join on the binary trie of `simhash`, which says what to compare at its
budget of bits. Texts at 0.8 whose fingerprints differ by more are found by bands of minimum hashes; neither decides: a
link is a comparison of the whole sets. Texts that the trie or a band links, directly or through others, are dealt to the
same tasks, which link what is similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import ship, stored

from .common import keep_named, map_rows, text_key, whole_text
from .components import components
from .simhash import MAX_BITS, majority, rooted_prints

# Fixed values of the contract.
SHINGLE = 5
SIMILAR = (4, 5)  # 0.8 as a fraction, so that the comparison is exact
SEED = 42

BANDS, ROWS = 32, 5  # two texts at 0.8 share no band with a chance of 3 in a million
BLOCK = 512  # shingles hashed at once, which stay in the processor's cache
LARGEST = 1 << 21  # shingles in one block of a task; a text counts as OVERHEAD more
OVERHEAD = 256

_draw = np.random.default_rng(SEED)
TURN = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
SPREAD = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
MIX = _draw.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
MARK = _draw.integers(0, 2**64, BANDS, dtype=np.uint64)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, also if it has no word."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: A-Z and the six white space characters only
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([one(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - width]
    hashes = [one(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1:].tolist())]
    return np.unique(np.array(hashes, dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number per band, equal for two sets if the band's minimum hashes are."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[k:k + BLOCK, None] ^ TURN) * SPREAD).min(axis=0), out=least)
    mixed = (least.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + MARK
    return ((mixed ^ (mixed >> np.uint64(32))) * SPREAD[0]).view(np.int64)


def set_links(sets: list[np.ndarray], keys: np.ndarray, prints: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links (position, position) that connect exactly what all similar pairs connect which have a common band key or
    fingerprints at MAX_BITS or fewer differing bits.

    Each text is compared with those that nothing has reached yet.
    """
    sizes, (over, under) = np.array([len(s) for s in sets], dtype=np.int64), SIMILAR
    todo = np.arange(len(sets))
    while len(todo):
        front, todo = [int(todo[0])], todo[1:]
        while front and len(todo):
            at = front.pop()
            own, n = sets[at], sizes[at]
            small, large = np.minimum(sizes[todo], n), np.maximum(sizes[todo], n)
            met = (keys[todo] == keys[at]).any(axis=1)
            if prints is not None:
                met |= np.bitwise_count(prints[todo] ^ prints[at]) <= MAX_BITS
            near = todo[(small * under >= large * over) & met]
            if not len(near):
                continue
            held = np.concatenate([sets[k] for k in near])
            found = own[np.minimum(np.searchsorted(own, held), n - 1)] == held
            starts = np.concatenate(([0], np.cumsum(sizes[near])[:-1]))
            both = np.add.reduceat(found.astype(np.int64), starts)
            hits = near[both * under >= (sizes[near] + n - both) * over]
            yield from ((at, int(k)) for k in hits)
            front += hits.tolist()
            todo = np.setdiff1d(todo, hits, assume_unique=True)


def trie_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) from every node to the smallest one that the trie links its `fingerprint` with, itself left out."""
    distinct = stored(nodes.groupBy("fingerprint").agg(F.min("node").alias("_first")), "near-prints")
    rooted = rooted_prints(distinct)
    least = rooted.groupBy("_root").agg(F.min("_first").alias("b"))
    of = rooted.join(least, "_root").select("fingerprint", "b")
    return nodes.select(F.col("node").alias("a"), "fingerprint").join(of, "fingerprint").where("a <> b").select("a", "b")


def similar_forest(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the numbers of `nodes` (node, text_key, size, keys, fingerprint), which connect what is similar.

    Texts are compared inside components of the trie's links and the common band keys together. Small components are bundled; a large one is cut into
    blocks, and every pair of its blocks is a task, so memory is bounded and no pair of texts is left out.
    """
    ship(docs.sparkSession)
    at = nodes.select("node", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    met = components(at.join(shared, "key").select(F.col("node").alias("a"), "b").union(trie_edges(nodes)))
    weighed = stored(nodes.join(met, "node").withColumn("weight", F.col("size") + OVERHEAD), "near-candidates")
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    blocks = weighed.groupBy("root").agg(F.ceil(F.sum("weight") / LARGEST).cast("int").alias("blocks"))
    bundles = 8 * max(1, -(-total // LARGEST))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = weighed.join(blocks, "root").withColumn("block", own).withColumn(
        "other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
            F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("block")))))
    alone = F.col("blocks") == 1
    task = F.struct(
        F.when(alone, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root")).alias("of"), alone.alias("alone"),
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    dealt = cut.groupBy("text_key").agg(F.collect_list(task).alias("tasks"), *(F.first(c).alias(c) for c in ("node", "root", "keys", "fingerprint")))

    def sets(texts: list[str]) -> dict:
        return {"shingles": [shingles(t).tobytes() for t in texts]}

    texts = docs.select(whole_text(docs).alias("text"), text_key(docs).alias("text_key"))
    found = texts.join(dealt, "text_key").dropDuplicates(["text_key"])
    rows = map_rows(found, sets, "shingles binary", ["text"], ["node", "root", "keys", "fingerprint", "tasks"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), dtype=np.int64)]
        for _, part in rows.groupby("root", sort=False):
            if len(part) > 1:
                held = [np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]]
                links = list(set_links(held, np.stack(part["keys"].to_list()), part["fingerprint"].to_numpy().view(np.uint64)))
                if links:
                    out.append(part["node"].to_numpy()[np.array(links)])
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    each = rows.select("node", "root", "keys", "fingerprint", "shingles", F.explode("tasks").alias("task"))
    return each.groupBy("task").applyInPandas(link, "a long, b long")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) that stay: of each group of near copies the row with the smallest doc_id
    (null last), once. Groups are what links of SIMILAR or more connect. Null text counts as empty; texts without words
    are copies of each other. Rows without an id, or of one id, stay if their groups differ.
    """
    def of_texts(texts: list[str]) -> dict:
        held = [shingles(t) for t in texts]
        prints = np.array([majority(h) for h in held], dtype=np.uint64).view(np.int64)
        return {"size": [len(h) for h in held], "keys": [band_keys(h) for h in held], "fingerprint": prints}

    texts = docs.select("doc_id", text_key(docs).alias("text_key"), whole_text(docs).alias("text"))
    rows = map_rows(texts, of_texts, "size long, keys array<long>, fingerprint long", ["text"], ["doc_id", "text_key"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    each = rows.groupBy("text_key").agg(first.alias("_first"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fingerprint").alias("fingerprint"))
    nodes = stored(each.select(F.monotonically_increasing_id().alias("node"), "*"), "near-texts")
    root = components(similar_forest(docs, nodes))
    named = nodes.select("node", "_first").join(root, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("_first").alias("_first"))
    return keep_named(docs, named.select("_first.doc_id", "_first.text_key"))
