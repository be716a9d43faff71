import random
import re

import numpy as np
import pytest

from lectura.llm.factors import least_at, parsed, pieces, remove_repeats, word_hashes

DOCS = "doc_id long, text string"


def plain(rows, window):
    """The contract, by a table of all windows. Rows with unique ids."""
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def corpus(seed, vocabulary=3000, n=120):
    rnd = random.Random(seed)
    some = lambda k: [f"w{rnd.randrange(vocabulary)}" for _ in range(k)]
    passage, line, rows = some(70), some(22), []
    for k in range(n):
        words = some(rnd.choice([0, 3, 19, 20, 21, 50, 200]))
        if k % 3 == 0:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        if k % 4 == 0:
            words += line + some(rnd.randrange(3)) + line
        if rows and k % 5 == 0:  # a copy with a slip
            words = (rnd.choice(rows)[1] or "").split()
            if words and k % 2:
                words[rnd.randrange(len(words))] = "slip"
        if rows and k % 7 == 0:  # parts of two documents
            words += rnd.choice(rows)[1].split()[5:60] + rnd.choice(rows)[1].split()[:33]
        rows.append((k, rnd.choice([" ", "\n", " \t "]).join(words)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows, window", [
    (corpus(1), 20), (corpus(2, vocabulary=40), 20), (corpus(3, vocabulary=2, n=60), 20), (corpus(4, vocabulary=3), 8),
    ([(1, "a " * 100), (2, "a " * 30), (3, "a " * 19), (4, "b a " * 40), (5, None), (6, ""), (7, " \n")], 20),
    ([(1, "x\xa0y é 漢 " * 30), (2, "X\xa0y é 漢 " * 30), (3, "x\xa0y é 漢 " * 6)], 20),
    ([(k, " ".join(f"p{j}" for j in range(40))) for k in range(300)], 20),
])
def test_rows_match_the_table_of_all_windows(spark, rows, window):
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept", "factors"]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["factors"]) for r in got.collect())
    assert [r[:4] for r in got] == plain(rows, window)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    for doc_id, _, removed, _, factors in got:
        covered = set()
        for f in factors:
            n, at, other = f["length"], f["start"], f["ref_doc_id"]
            assert n >= window and (other, f["ref_start"]) < (doc_id, at)
            assert words[doc_id][at:at + n] == words[other][f["ref_start"]:f["ref_start"] + n]
            covered.update(range(at, at + n))
        assert len(covered) == removed


def test_a_copy_is_one_factor(spark):
    text = " ".join(f"w{k}" for k in range(5000))
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame([(4, text), (9, "new " + text + " end")], DOCS)).collect()}
    assert got[4]["n_removed"] == 0 and got[9]["kept"] == "new end"
    assert [tuple(f) for f in got[9]["factors"]] == [(1, 5000, 4, 0)]


def test_rows_without_ids_repeated_rows_empty_tables_and_own_columns(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(None, a), (None, a + " tail"), (1, a), (1, a), (1, "head " + a), (2, b), (2, b), (None, None)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    of = lambda d, n: sorted(r["n_removed"] for r in got if r["doc_id"] == d and r["n_words"] == n)
    assert of(2, 30) == [0, 0]  # a row repeated as a whole is one document
    assert of(None, 30) == [30] and of(None, 31) == [30] and of(None, 0) == [0]
    first = of(1, 30), of(1, 31)
    assert first in (([0, 0], [30]), ([30, 30], [0]))
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    own = spark.createDataFrame([(1, a, "x", 3), (2, a, "y", 4)], "doc_id long, text string, doc string, start int")
    assert sorted((r["doc_id"], r["n_removed"]) for r in remove_repeats(own).collect()) == [(1, 0), (2, 30)]


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200_000))
    half = " ".join(text.split()[70_000:170_000])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], len(r["factors"])) for r in remove_repeats(spark.createDataFrame([(1, text), (2, half)], DOCS)).collect()}
    assert got == {1: (200_000, 0, 0), 2: (100_000, 100_000, 1)}


def test_pieces_hold_every_window_once_and_equal_windows_share_anchors():
    rnd = random.Random(1)
    for n in (19, 20, 21, 34, 35, 300):
        hashes = word_hashes([b"%d" % rnd.randrange(5) for _ in range(n)])
        _, anchor, _, start, windows = pieces(hashes, np.array([n]))
        assert np.concatenate([np.arange(s, s + w) for s, w in zip(start, windows)] or [[]]).tolist() == list(range(max(0, n - 19)))
        by = {}
        for k, a in enumerate(np.repeat(anchor, windows)):
            assert by.setdefault(hashes[k:k + 20].tobytes(), a) == a
    lengths = [40, 0, 19, 20, 3, 100]
    texts = [word_hashes([b"%d" % rnd.randrange(9) for _ in range(n)]) for n in lengths]
    together = list(zip(*pieces(np.concatenate(texts), np.array(lengths))))
    alone = [(k, *p) for k, t in enumerate(texts) for p in list(zip(*pieces(t, np.array([len(t)]))))]
    assert together == [(k, *p[1:]) for k, *p in alone]
    values = np.array([3, 1, 1, 2, 0, 5, 0])
    assert least_at(values, 3).tolist() == [1, 1, 4, 4, 4] and least_at(values, 1).tolist() == list(range(7))


def test_factors_follow_the_reference():
    parts = [(5, 3, 1, 15), (0, 5, 1, 10), (8, 2, 2, 18), (12, 1, 2, 22)]
    assert parsed(*zip(*parts), 20) == [(0, 27, 1), (8, 21, 2), (12, 20, 3)]
