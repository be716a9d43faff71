"""SimHash near-deduplication: fingerprints, and their self-join on a binary trie of the bits.

The trie is cut into subtrees of bounded size by counts of prefixes. Pairs of subtrees are traversed from the root:
differing bits add up, and a pair is dropped with all below it when they exceed the budget. What remains are pairs of
subtrees that one task each traverses to the leaves in the same way.
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

SHINGLE = 3
MAX_BITS = 2
SEED = 42
TOP_BITS = 16  # depth of the first count of prefixes; dense subtrees are counted 8 bits deeper, again and again
STEP_BITS = 8
SUBTREES = 64  # wanted at least
SMALLEST, LARGEST = 1024, 1 << 21  # fingerprints in a subtree
FRONT = 1 << 18  # node pairs that a task expands at once


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64 bits of a whole text, unsigned; a bit is set if it is in over half of the shingles' hashes."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: A-Z and the six white space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    first = starts[: len(last)]
    set_bits, block, one = np.zeros(64, dtype=np.int64), 1 << 16, xxhash.xxh64_intdigest
    for k in range(0, len(last), block):
        hashes = [one(joined[a:b], SEED) for a, b in zip(first[k:k + block].tolist(), last[k:k + block].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(last), bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """64 bits, unsigned: those set in over half of the hashes."""
    set_bits, block = np.zeros(64, dtype=np.int64), 1 << 16
    for k in range(0, len(hashes), block):
        part = np.ascontiguousarray(hashes[k:k + block], dtype="<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the fingerprint of every row, as a signed 64-bit number, stored."""
    def of_texts(texts: list[str]) -> dict:
        return {"fingerprint": np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)}

    texts = docs.select(*keep, whole_text(docs).alias("text"))
    return stored(map_rows(texts, of_texts, "fingerprint long", ["text"], list(keep)), "fingerprints")


# --- the trie inside one task -----------------------------------------------------------------------------------------


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of all pairs at `budget` or fewer differing bits, in blocks.

    `a` and `b` are sorted, distinct and unsigned. Without `b`, all pairs inside `a`, once each. Nodes are ranges of the
    sorted numbers. A front of node pairs steps down one bit at a time; fronts wait on a stack, so memory stays bounded.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    stack = [(0, *(np.array([x], dtype=np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        few = (ahi - alo) * (bhi - blo) <= 8
        if depth == 64:
            few[:] = True
        if few.any():
            yield from _leaf_pairs(a, b, own, budget, *(x[few] for x in (alo, ahi, blo, bhi)))
            alo, ahi, blo, bhi, err = (x[~few] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        amid, bmid = _split(a, alo, ahi, depth), _split(b, blo, bhi, depth)
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), dtype=bool)
        nexts = []
        for left in (0, 1):
            for right in (0, 1):
                part = np.stack([
                    amid if left else alo, ahi if left else amid, bmid if right else blo, bhi if right else bmid,
                    err + (left != right),
                ])
                held = (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= budget)
                if left and not right:
                    held &= ~same
                nexts.append(part[:, held])
        front = np.concatenate(nexts, axis=1)
        for k in range(0, front.shape[1], FRONT):
            stack.append((depth + 1, *front[:, k:k + FRONT]))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where in each range [lo, hi), whose numbers agree in the bits above, the bit at `depth` turns to 1."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    high = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    return np.clip(np.searchsorted(values, (values[lo] & high) | bit), lo, hi)


def _leaf_pairs(a, b, own, budget, alo, ahi, blo, bhi) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small ranges, compared whole."""
    wide = bhi - blo
    n = (ahi - alo) * wide
    for k in range(0, len(n), FRONT):
        m = n[k:k + FRONT]
        at = np.repeat(np.arange(k, k + len(m)), m)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
        x, y = alo[at] + inside // wide[at], blo[at] + inside % wide[at]
        near = np.bitwise_count(a[x] ^ b[y]) <= budget
        if own:
            near &= x < y
        yield x[near], y[near]


def forest(values: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each position, the smallest position that the links connect it with."""
    label = np.arange(len(values))
    for x, y in links:
        while True:
            while not np.array_equal(up := label[label], label):
                label = up
            p, q = label[x], label[y]
            if not (apart := p != q).any():
                break
            np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
    return label


# --- the trie over all fingerprints -----------------------------------------------------------------------------------


def cut_nodes(distinct: DataFrame, total: int) -> list[tuple[int, int]]:
    """Subtrees (prefix, depth) that cover all fingerprints, in order; only counts of prefixes reach the driver.

    A node is opened while it holds more fingerprints than one of SUBTREES equal parts, or than LARGEST.
    """
    limit = min(LARGEST, max(SMALLEST, -(-total // SUBTREES)))
    nodes, level, dense = [], 0, None
    while True:
        deeper = min(64, level + (STEP_BITS if level else TOP_BITS))
        prefix = F.shiftrightunsigned("fingerprint", 64 - deeper)
        above = distinct if dense is None else distinct.where(F.shiftrightunsigned("fingerprint", 64 - level).isin(dense))
        counts = {int(r["p"]) & (2**64 - 1): r["n"] for r in above.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
        sums = [counts]  # by height above `deeper`
        for _ in range(deeper - level):
            up: dict[int, int] = {}
            for p, n in sums[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            sums.append(up)
        stack, dense = [(p, level) for p in sums[-1]], []
        while stack:
            p, depth = stack.pop()
            n = sums[deeper - depth].get(p, 0)
            if not n:
                continue
            if n <= limit or depth == 64:
                nodes.append((p, depth))
            elif depth == deeper:
                dense.append(p)
            else:
                stack += [(2 * p, depth + 1), (2 * p + 1, depth + 1)]
        if not dense:
            return sorted(nodes, key=lambda x: x[0] << (64 - x[1]))
        level = deeper


def node_pairs(nodes: list[tuple[int, int]], budget: int = MAX_BITS) -> list[tuple[int, int]]:
    """Pairs of subtrees (positions in `nodes`) whose prefixes differ in at most `budget` bits, itself included.

    The trie above the subtrees is traversed in pairs from the root, like the trie inside a task.
    """
    starts = [p << (64 - d) for p, d in nodes]
    bounds = np.array(starts, dtype=np.uint64)

    def below(prefix: int, depth: int) -> tuple[int, int]:
        lo = np.searchsorted(bounds, np.uint64(prefix << (64 - depth)))
        end = (prefix + 1) << (64 - depth)
        return int(lo), len(nodes) if end >= 2**64 else int(np.searchsorted(bounds, np.uint64(end)))

    found, stack = [], [((0, 0), (0, 0), 0)]
    while stack:
        (p, d), (q, e), err = stack.pop()
        (plo, phi), (qlo, qhi) = below(p, d), below(q, e)
        if plo == phi or qlo == qhi:
            continue
        p_leaf, q_leaf = nodes[plo] == (p, d), nodes[qlo] == (q, e)
        if p_leaf and q_leaf:
            found.append((plo, qlo))
            continue
        # Step down both where both are open, else the open one, along the bits of the other as far as they reach.
        depth = max(d, e) if p_leaf or q_leaf else d
        lefts = [(p, d)] if p_leaf else [(2 * p, d + 1), (2 * p + 1, d + 1)]
        rights = [(q, e)] if q_leaf else [(2 * q, e + 1), (2 * q + 1, e + 1)]
        for x in lefts:
            for y in rights:
                if (p, d) == (q, e) and x > y:
                    continue
                shared = min(x[1], y[1])
                differ = ((x[0] >> (x[1] - shared)) ^ (y[0] >> (y[1] - shared))).bit_count()
                if differ <= budget:
                    stack.append((x, y, differ))
    return sorted(set(found))


def near_forest(distinct: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which links of `budget` or fewer bits connect.

    Every link is found; each pair of subtrees hands on a spanning forest of its links, not the links themselves.
    """
    spark = ship(distinct.sparkSession)
    nodes = cut_nodes(distinct, distinct.count())
    pairs = node_pairs(nodes, budget)
    starts = np.array([p << (64 - d) for p, d in nodes], dtype=np.uint64)
    sides = sorted([(a, k, 0) for k, (a, _) in enumerate(pairs)] + [(b, k, 1) for k, (a, b) in enumerate(pairs) if a != b])
    of_node = np.searchsorted([s[0] for s in sides], np.arange(len(nodes) + 1))
    pair_of, side_of = np.array([s[1] for s in sides], dtype=np.int32), np.array([s[2] for s in sides], dtype=np.int8)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 4096):
                values = rows["fingerprint"].to_numpy()[k:k + 4096]
                node = np.searchsorted(starts, values.view(np.uint64), side="right") - 1
                n = of_node[node + 1] - of_node[node]
                at = np.repeat(of_node[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"pair": pair_of[at], "side": side_of[at], "fingerprint": np.repeat(values, n)})

    def traverse(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fingerprint"].to_numpy().view(np.uint64)
        right = rows["side"].to_numpy() == 1
        a, b = np.sort(values[~right]), np.sort(values[right])
        if len(b):
            both = np.concatenate([a, b])
            label = forest(both, ((x, y + len(a)) for x, y in trie_links(a, b, budget)))
        else:
            both = a
            label = forest(both, trie_links(a, None, budget))
        hung = np.flatnonzero(label != np.arange(len(both)))
        return pd.DataFrame({"a": both[hung].view(np.int64), "b": both[label[hung]].view(np.int64)})

    dealt = distinct.select("fingerprint").mapInPandas(deal, "pair int, side byte, fingerprint long")
    return dealt.groupBy("pair").applyInPandas(traverse, "a long, b long")


def rooted_prints(distinct: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """`distinct` (fingerprint, ...) with `_root`, the fingerprint that stands for its component, stored."""
    root = components(near_forest(distinct, budget)).withColumnRenamed("node", "fingerprint")
    return stored(distinct.join(root, "fingerprint", "left").withColumn("_root", F.coalesce("root", "fingerprint")), "fingerprint-roots")


def near_groups(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links of `budget` or fewer differing bits reach, itself included. Null
    texts and texts without words have fingerprint zero and link like any other. Copies share a fingerprint and meet
    in the trie once. Repeated rows stay; a null doc_id takes the smallest doc_id of its group, null if there is none.
    An empty table gives no rows; further columns are ignored.
    """
    rows = fingerprints(docs)
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")), "fingerprint-groups")
    rooted = rooted_prints(distinct, budget)
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(smallest, "_root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` that stay: of each group of near copies the row with the smallest doc_id (null last), once.

    A row is named by doc_id and text together, so rows without an id, or of one id, stay if their groups differ.
    """
    rows = fingerprints(docs.select("doc_id", "text", text_key(docs).alias("text_key")), ("doc_id", "text_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    distinct = stored(rows.groupBy("fingerprint").agg(first.alias("_first")), "fingerprint-groups")
    stays = rooted_prints(distinct, budget).groupBy("_root").agg(F.min("_first").alias("_first"))
    return keep_named(docs, stays.select("_first.doc_id", "_first.text_key"))
