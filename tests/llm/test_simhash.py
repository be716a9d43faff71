import random

import numpy as np
import xxhash

from lectura.llm.components import components
from lectura.llm.simhash import cut_nodes, fingerprint, forest, keep_one_of_each, near_groups, node_pairs, trie_links

DOCS = "doc_id long, text string, source string, fingerprint string"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints):
    """{doc_id: smallest doc_id reachable} by comparing all pairs."""
    parent = {d: d for d, _ in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (d, f) in enumerate(prints):
        for e, g in prints[:i]:
            if (f ^ g).bit_count() <= 2:
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return {d: top(d) for d, _ in prints}


def clustered(n, seed):
    """Numbers of which many lie within a few bits of each other."""
    rnd = random.Random(seed)
    seen = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(seen) < n:
        x = rnd.choice(seen)
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        seen.append(x)
    return seen


def test_fingerprint_is_the_plain_one():
    for text in ("", " \n", "Ein Wort", "a b c", "À B\tc  d\x0be É", "x " * 70_000, "\x1c\x85 \xa0 b c d"):
        assert fingerprint(text) == plain_fingerprint(text), text[:20]


def test_trie_finds_exactly_the_near_pairs():
    for seed in range(4):
        values = np.unique(np.array(clustered(400, seed), dtype=np.uint64))
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
        got = {(int(x), int(y)) for xs, ys in trie_links(values, None) for x, y in zip(xs, ys)}
        assert got == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
        a, b = values[::2], values[1::2]
        got = {(int(x), int(y)) for xs, ys in trie_links(a, b) for x, y in zip(xs, ys)}
        assert got == set(zip(*np.nonzero(near[::2, 1::2])))


def test_forest_joins_chains():
    x, y = np.array([5, 4, 3, 8]), np.array([4, 3, 2, 9])
    assert forest(np.arange(10), iter([(x, y)])).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]


def test_node_pairs_lose_no_link():
    rnd = random.Random(1)
    nodes = [(0, 1), (0b100, 3), (0b1010, 4), (0b10110, 5), (0b10111, 5), (0b11, 2)]
    pairs = set(node_pairs(nodes))

    def of(v):
        return next(k for k, (p, d) in enumerate(nodes) if v >> (64 - d) == p)
    for _ in range(3000):
        v = rnd.getrandbits(64)
        w = v
        for _ in range(2):
            w ^= 1 << rnd.randrange(58, 64)
        assert (of(v), of(w)) in pairs or (of(w), of(v)) in pairs


def test_dense_subtrees_are_cut_deeper(spark, monkeypatch):
    from lectura.llm import simhash
    monkeypatch.setattr(simhash, "SMALLEST", 4)
    values = sorted({(0xABCD << 48) | (k << 20) for k in range(600)} | {k << 40 for k in range(40)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = cut_nodes(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), len(values))
    held = [sum(v >> (64 - d) == p for v in values) for p, d in nodes]
    assert sum(held) == len(values) and max(held) <= -(-len(values) // simhash.SUBTREES)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_match_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    base = [[rnd.choice(words) for _ in range(400)] for _ in range(6)]
    rows, n = [], 0
    for text in base:
        for k in range(8):
            copy = list(text)
            for _ in range(k):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            n += 1
            rows.append((n, " ".join(copy), None, "x"))
    rows += [(100, None, "a", "x"), (101, "", None, "x"), (102, " \t", "b", None), (3, rows[0][1], "c", "x"), (103, "long " * 30_000, None, None)]
    got = near_groups(spark.createDataFrame(rows, DOCS)).collect()
    prints = [(i, plain_fingerprint(t or "")) for i, t, *_ in rows]
    # a doc_id that occurs twice reaches what either row reaches
    want = plain_groups([(k, f) for k, (_, f) in enumerate(prints)])
    smallest = {}
    for k, (i, _) in enumerate(prints):
        smallest[want[k]] = min(i, smallest.get(want[k], i))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (i, f"{f:016x}", smallest[want[k]]) for k, (i, f) in enumerate(prints))
    kept = keep_one_of_each(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "source", "fingerprint"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(smallest.values()))


def test_empty_table_and_null_ids(spark):
    assert near_groups(spark.createDataFrame([], DOCS)).count() == 0
    got = near_groups(spark.createDataFrame([(None, "a b c d", None, None), (4, "a b c d", None, None), (None, "z", None, None)], DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got if r["component_id"] is not None) == [(False, 4), (True, 4)]
    assert sum(r["component_id"] is None for r in got) == 1


def test_rows_without_an_id_or_of_one_id_are_kept_apart(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, t, "n", None) for t in texts[:5]] + [(7, texts[5], "a", None), (7, texts[6], "b", None), (8, texts[7], "c", None), (None, texts[7], "d", None)]
    rows += [(None, texts[0], "n", None)]
    got = [tuple(r) for r in keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted(rows[:8], key=str)
