import random

import numpy as np

from lectura.llm.quality import BITS, Ordinal, features, fit, keep_accepted, ratings, select_documents

DOCS = "doc_id long, text string, source string, score string, tail_1 int"


def written(rnd, kind):
    words = [rnd.choice(WORDS) for _ in range(rnd.randint(40, 200))]
    if kind == 0:
        for _ in range(max(2, len(words) // 40)):
            words[rnd.randrange(len(words))] = rnd.choice(["blockhead", "blockheads!", "Nitwit"])
    if kind == 1:
        words = [w for w in words[:20] for _ in range(8)] if rnd.random() < 0.5 else [w + "@@" for w in words]
    return " ".join(words)


WORDS = ["".join(random.Random(k).choice("abcdeiklmnoprstu") for _ in range(random.Random(-k).randint(2, 9))) for k in range(400)]


def made(n, seed):
    rnd = random.Random(seed)
    kinds = [rnd.choice([0, 1, 2, 2, 2, 2]) for _ in range(n)]
    return [written(rnd, k) for k in kinds], np.array(kinds)


def fitted(texts, grades):
    pairs = [features(t) for t in texts]
    return Ordinal.fit(np.repeat(np.arange(len(texts)), [len(p) for p, _ in pairs]), np.concatenate([p for p, _ in pairs]), np.concatenate([v for _, v in pairs]), grades)


def test_held_out_accuracy_and_law():
    model = fitted(*made(900, 1))
    texts, grades = made(600, 2)
    score = model.scorer()
    scores = np.array([score(t) for t in texts])
    expected, tails = model.law(scores)
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all() and np.allclose(expected, tails.sum(axis=1))
    kept = tails[:, 1] >= 0.6
    assert kept[grades == 2].mean() > 0.97 and kept[grades < 2].mean() < 0.06
    assert expected[grades == 0].mean() < expected[grades == 1].mean() < expected[grades == 2].mean()


def test_slopes_match_differences():
    """One step from the start moves the likelihood up; the scorer agrees with the features it was fitted on."""
    texts, grades = made(60, 3)
    model = fitted(texts, grades)
    score = model.scorer()
    for t in texts[:10] + ["", "x", "A A A"]:
        places, values = features(t)
        assert np.isclose(score(t), float(np.dot(model.weights[places], values))), t[:20]


def test_selection_over_a_table(spark):
    texts, grades = made(700, 5)
    rows = [(k, t, "s", "x", 1) for k, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "", "", 0), (None, texts[0], "", "", 0), (902, "long words " * 30_000, "", "", 0), (3, texts[3], "s", "x", 1)]
    labels = [(k, int(g == 2 or g == 0), int(g == 0)) for k, g in enumerate(grades[:500].tolist())]
    labels += [(0, None, None), (3, labels[3][1], labels[3][2]), (None, 1, 0), (12_345, 1, 0)]
    docs, rated = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = select_documents(docs, rated)
    assert got.columns == ["doc_id", "score", "expected_grade", "tail_1", "tail_2"]
    whole = keep_accepted(docs, rated)
    assert whole.columns == docs.columns
    by_row = sorted(map(str, docs.collect()))
    assert all(str(r) in by_row for r in whole.collect()) and whole.count() == got.count()
    kept = [r["doc_id"] for r in got.collect()]
    assert np.mean([k in kept for k in np.flatnonzero(grades == 2)]) > 0.95
    assert np.mean([k in kept for k in np.flatnonzero(grades < 2)]) < 0.1
    assert kept.count(3) in (0, 2)
    assert sorted(kept, key=str) == sorted((r["doc_id"] for r in select_documents(docs.repartition(6), rated).collect()), key=str)


def test_ratings_no_labels_and_no_documents(spark):
    kind = "doc_id long, quality int, toxic int"
    got = ratings(spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, None), (None, 1, 0), (4, 1, None)], kind)).collect()
    assert {r["doc_id"]: r["grade"] for r in got} == {1: 1, 2: 0, 4: 2}
    docs = spark.createDataFrame([(1, "some text", "", "", 0)], DOCS)
    model = fit(docs, spark.createDataFrame([], kind))
    assert model.weights.shape == (1 << BITS,) and np.allclose(model.law(np.zeros(1))[1], [[2 / 3, 1 / 3]])
    assert select_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 0)], kind)).count() == 0
