import numpy as np
import pytest

from lectura.llm.neighbours import balanced_parts, cosine, graph, nearest_of_block, search, unit

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, part string"


def plain(ids, vectors, every, nearest=5):
    """(query_id, rank, vec_id, score) by comparing all pairs."""
    out = []
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = cosine(np.repeat(vectors[q:q + 1], len(ids), axis=0), vectors)
            best = sorted((-s, i) for s, i in zip(score, ids) if i != ids[q])[:nearest]
            out += [(ids[q], k, i, -s) for k, (s, i) in enumerate(best, 1)]
    return out


def clusters(n, size, seed, spread):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((12, size))[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, size))).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_recall_and_scores(spark, spread):
    vectors = clusters(2500, 24, 3, spread)
    rows = [(k, v.tolist(), 0, "x", None) for k, v in enumerate(vectors)]
    got = [tuple(r) for r in search(spark.createDataFrame(rows, SCHEMA), 50, sample=1200, block=300).collect()]
    want = plain(list(range(2500)), vectors, 50)
    assert len(got) == len(want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    for q, k, i, s in got:
        assert s == cosine(vectors[q:q + 1], vectors[i:i + 1])[0]
    by_query = {}
    for q, k, i, s in sorted(got):
        by_query.setdefault(q, []).append((-s, i))
    assert all(v == sorted(v) and len(v) == 5 for v in by_query.values())


def test_block_is_exact_with_copies_and_ties():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 8))
    vectors = np.concatenate([base, np.repeat(base[:1], 60, axis=0), 2 * base[:5]])
    ids = rng.permutation(len(vectors)) * 3
    frame = nearest_of_block(vectors, ids, vectors, ids)
    got = sorted(zip(frame.query_id, -frame.score, frame.vec_id))
    assert got == sorted((q, -s, i) for q, _, i, s in plain(ids.tolist(), vectors, 1))


def test_parts_are_balanced_and_follow_the_graph():
    vectors = unit(clusters(400, 16, 1, 0.1))
    similar = vectors @ vectors.T
    np.fill_diagonal(similar, -np.inf)
    adjacent = graph(similar, 5)
    label = balanced_parts(adjacent, 4)
    assert np.ptp(np.bincount(label, minlength=4)) <= 1
    inside = adjacent[label[:, None] == label[None, :]].sum()
    assert inside > 0.7 * adjacent.sum()


def test_unfit_rows_few_rows_and_no_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [1.0, None]), (250, [inf, 1.0]), (3, [1.0, 1.0]),
            (None, [1.0, 0.1]), (7, [2.0, 2.0]), (9, [-1.0, 0.0]), (11, [1.0, 2.0, 3.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", None) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in search(frame, 50).orderBy("query_id", "rank").collect()]
    assert [(q, k, i) for q, k, i, _ in got] == [(0, 1, 3), (0, 2, 7), (0, 3, 9)]
    assert got[0][3] == got[1][3] and got[2][3] == -1.0
    assert search(spark.createDataFrame([], SCHEMA), 50).count() == 0
    assert search(spark.createDataFrame([(50, [1.0], 1, "", "")], SCHEMA), 50).count() == 0
