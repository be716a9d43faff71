import random

import corpus_pipeline
from lectura.llm import near_copies
from lectura.llm.near_copies import keep_one_of_each, set_links, shingles, band_keys

DOCS = "doc_id long, text string, source string"


def plain_kept(rows):
    """doc_ids that stay, by comparing the five-word sets of all pairs."""
    sets, top = [], list(range(len(rows)))
    for _, text, _ in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})

    def find(k):
        while top[k] != k:
            k = top[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = {}
    for k, (d, *_) in enumerate(rows):
        groups.setdefault(find(k), []).append(d)
    least = [min(g, key=lambda d: (d is None, d or 0)) for g in groups.values()]
    return sorted(-1 if d is None else d for d in least)


def edited(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows, n = [], 0
    for length in (8, 40, 100, 400, 2000):
        for _ in range(4):
            text = [word() for _ in range(length)]
            for changes in (0, 1, 2, length // 50, length // 40, length // 20, length // 8):
                copy = list(text)
                for _ in range(changes):
                    copy[rnd.randrange(length)] = word()
                n += 1
                rows.append((n, " ".join(copy), "s"))
    return rows


def test_the_stage_links_edited_copies(spark):
    rows = edited(3) + [(900, None, "a"), (901, " ", "b"), (902, "one", "c"), (903, "One\n", "d"), (None, "un deux", "e")]
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert got.columns == ["doc_id", "text", "source"]
    got = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect())
    assert got == plain_kept(rows) and len(got) < 0.8 * len(rows)


def test_a_large_component_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGEST", 1500)
    rows = edited(4)[-70:]
    got = keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == plain_kept(rows)


def test_rows_without_an_id_stay(spark):
    rows = [(None, f"text number {k} of some that have no id at all {k * k}", "s") for k in range(6)] + [(1, "a b", "s"), (1, "c d", "t")]
    got = keep_one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(rows, key=str)
    assert keep_one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_chains_are_followed():
    import numpy as np
    words = [f"w{k}" for k in range(1200)]
    sets = [shingles(" ".join(words[k * 60:k * 60 + 600])) for k in range(10)]
    links = list(set_links(sets, np.zeros((10, 1), dtype=np.int64)))
    assert len(links) == 9 and band_keys(sets[0]).shape == (near_copies.BANDS,)


def test_the_trie_links_without_any_band(spark):
    """The stage's candidates come from the trie of fingerprints too: texts that share no band are still compared and linked."""
    import numpy as np
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(words), "s"), (2, " ".join(words[:-1]), "s"), (3, " ".join(reversed(words)), "s")]
    hashes = [shingles(t) for _, t, _ in rows]
    prints = np.array([near_copies.majority(h) for h in hashes], dtype=np.uint64)
    assert np.bitwise_count(prints[0] ^ prints[1]) <= 2 < np.bitwise_count(prints[0] ^ prints[2])
    nodes = spark.createDataFrame([(k, int(p.view(np.int64))) for k, p in enumerate(prints)], "node long, fingerprint long")
    assert [tuple(r) for r in near_copies.trie_edges(nodes).collect()] == [(1, 0)]
    apart = np.arange(3 * near_copies.BANDS).reshape(3, -1)
    assert list(set_links(hashes, apart)) == [] and list(set_links(hashes, apart, prints)) == [(0, 1)]
