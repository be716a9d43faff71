"""Matching of songs against a plain comparison of all pairs, and slips planted in names."""

import random

import pytest
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.operators import songs as X

TRACKS = "track_id long, artist string, title string, duration_sec int"
CATALOG = "lyric_id long, artist string, title string, duration_sec int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def similarity(a, b):
    longest = max(len(a), len(b))
    return 1 - distance(a, b) / longest if longest else 1.0


def score(track, entry):
    left, right = set(track[2].split(" ")), set(entry[2].split(" "))
    words = lambda x: " ".join(sorted(x))
    shared = words(left & right)
    first, second = (f"{shared} {words(x)}".strip() for x in (left - right, right - left))
    title = similarity(first, second)
    if shared:
        title = max(title, similarity(shared, first), similarity(shared, second))
    near = None not in (track[3], entry[3]) and abs(track[3] - entry[3]) <= K.DURATION_TOLERANCE_SEC
    return round(0.5 * title + 0.35 * similarity(track[1], entry[1]) + (0.15 if near else 0), 6)


def plain(tracks, catalog):
    out = {}
    for t in tracks:
        best = max(((score(t, c), -c[0]) for c in catalog), default=(0, 0))
        out[t[0]] = (-best[1], best[0], "accept" if best[0] >= 0.85 else "manual") if best[0] >= 0.7 else (None, None, "reject")
    return out


def slipped(rnd, word):
    k = rnd.randrange(1, len(word) - 1)
    return rnd.choice([word[:k] + word[k + 1:], word[:k] + "q" + word[k:], word[:k] + "q" + word[k + 1:], word[:k] + word[k + 1] + word[k] + word[k + 2:]])


def library(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(90)]
    some = lambda n: " ".join(rnd.sample(words, n))
    catalog = [(k, some(rnd.choice([1, 2])), some(rnd.choice([1, 2, 3])), rnd.choice([None, 150 + rnd.randrange(90)])) for k in range(60)]
    tracks = []
    for k in range(120):
        _, artist, title, duration = rnd.choice(catalog)
        if k % 4 in (1, 3):
            title = " ".join(slipped(rnd, w) for w in title.split())
        if k % 4 in (2, 3):
            artist = " ".join(slipped(rnd, w) for w in artist.split())
        tracks.append((k, artist, title, duration if k % 3 else None))
    return tracks + [(900, some(2), some(2), 170), (901, "", "", None)], catalog


@pytest.mark.parametrize("seed", [1, 2])
def test_accepted_pairs_are_those_of_all_pairs(spark, seed):
    tracks, catalog = library(seed)
    got = X.score_matches(X.with_match_keys(spark.createDataFrame(tracks, TRACKS)), X.with_match_keys(spark.createDataFrame(catalog, CATALOG))).collect()
    want = plain(tracks, catalog)
    got = {r["track_id"]: (r["lyric_id"], r["score"], r["verdict"]) for r in got}
    assert {k: v for k, v in got.items() if v[2] == "accept"} == {k: v for k, v in want.items() if v[2] == "accept"}
    assert sum(v[2] == "accept" for v in want.values()) > 40
    found = sum(got[k] == v for k, v in want.items() if v[2] == "manual")
    assert found >= 0.9 * sum(v[2] == "manual" for v in want.values())


def test_slips_in_the_rarest_words_of_both(spark):
    tracks = [(1, "Los Lobos", "La bamba", 170), (2, "Los Lobos", "La bammba", None), (3, "Los Lbos", "Labamba loca", 170), (4, "Loz Lobos", "La bamba", None)]
    catalog = [(1, "Los Lobox", "La bamba", 171), (2, "Nobody", "Silence", 171)]
    table = lambda rows, kind: X.with_match_keys(spark.createDataFrame(rows, kind))
    got = {r["track_id"]: (r["lyric_id"], r["verdict"]) for r in X.score_matches(table(tracks, TRACKS), table(catalog, CATALOG)).collect()}
    assert got[1] == (1, "accept") and got[2] == (1, "manual") and got[4] == (1, "manual")
    assert X.score_matches(table([], TRACKS), table(catalog, CATALOG)).collect() == []
    assert [r["verdict"] for r in X.score_matches(table(tracks[:1], TRACKS), table([], CATALOG)).collect()] == ["reject"]


def test_near_words(spark):
    words = ["bamba", "bama", "bmaba", "bammba", "bomba", "la", "le", "guitarra", "gitara", "guitar", "xyz"]
    pairs = {(r["word"], r["near"]) for r in X.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {("bamba", w) for w in ("bamba", "bama", "bmaba", "bammba", "bomba")} <= pairs
    assert ("guitarra", "gitara") in pairs and ("guitarra", "guitar") in pairs
    assert {p for p in pairs if "la" in p or "xyz" in p} == {("la", "la"), ("xyz", "xyz")}
    assert pairs == {(b, a) for a, b in pairs}


def test_no_product_in_the_plan_and_buckets(spark):
    tracks, catalog = library(3)
    a, b = X.with_match_keys(spark.createDataFrame(tracks, TRACKS)), X.with_match_keys(spark.createDataFrame(catalog, CATALOG))
    plan = X.score_matches(a, b)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    names = X.numbered_names(a), X.numbered_names(b)
    mine, other = X.match_keys(*names, X.timed_rows(a, names[0]), X.timed_rows(b, names[1]))
    rows = {r["kind"]: r for r in X.match_buckets(a, b).collect()}
    assert set(rows) == {"both", "words", "title", "artist"}
    joined = mine.join(other.withColumnRenamed("id", "oid"), X.MATCH_KEYS).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["kind"]: r["n"] for r in joined} == {k: r["pairs"] for k, r in rows.items()}


def test_languages_are_told_by_trigrams(spark):
    from pyspark.sql import functions as F

    from lectura.operators import songs as X

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").filter("text IS NOT NULL")
    untold = spark.createDataFrame([(1, None, "no language"), (2, "xx", None), (3, "xx", "")], "doc_id long, lang string, text string")
    model = X.learn_languages(X.count_words(docs.filter("doc_id % 2 = 0").union(untold), "lang"))
    assert model.languages == ["de", "en", "es", "fr"]
    held = docs.filter("doc_id % 2 = 1")
    scores = X.language_scores(X.count_words(held, "doc_id"), model).join(held, "doc_id").select((F.col("language") == F.col("lang")).alias("ok"), "confidence").collect()
    assert len(scores) == held.count() and sum(r.ok for r in scores) >= 0.99 * len(scores)
    assert sum(r.ok and r.confidence >= 0.8 for r in scores) >= 0.98 * len(scores)

    words = {r.lang: r.text.split()[:40] for r in held.filter("size(split(text, ' ')) > 60").collect()}
    spanish, english = " ".join(words["es"]), " ".join(words["en"])
    rows = [(1, spanish), (2, english), (3, None), (4, "1234 !?"), (5, ""), (6, "xq"), (7, spanish.upper()), (1, spanish)]
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.language_gate(mine, X.language_scores(X.count_words(mine, "doc_id"), model)).collect()
    routes = {r.doc_id: (r.language, r.route) for r in got}
    assert len(got) == len(rows) and routes[1] == routes[7] == ("es", "accept") and routes[2] == ("en", "reject")
    assert [routes[k] for k in (3, 4, 5)] == [(None, "review")] * 3 and routes[6][1] == "review"
    nothing = X.learn_languages(X.count_words(untold.filter("lang IS NULL"), "lang"))
    scores = X.language_scores(X.count_words(docs, "doc_id"), nothing)
    assert {r.route for r in X.language_gate(docs.limit(3), scores).collect()} == {"review"}


def test_language_weights_are_those_of_a_plain_model(spark):
    import math
    from collections import Counter

    from lectura import constants as K
    from lectura.operators import songs as X

    texts = [("a", "Abba baba, abba."), ("b", "coco abc"), ("b", "abc"), ("c", "ñandú")]
    model = X.learn_languages(X.count_words(spark.createDataFrame(texts, "lang string, text string"), "lang"))
    cut = lambda text: [f" {w} "[i:i + 3] for w in "".join(c if c.isalpha() else " " for c in text.lower()).split() for i in range(len(w))]
    seen = {lang: Counter(t for x, text in texts if x == lang for t in cut(text)) for lang in "abc"}
    different = len(set().union(*seen.values()))
    new = "abba coco zzz"
    evidence = {}
    for lang, counts in seen.items():
        total = sum(math.log((counts[t] + 1) / (counts.total() + different)) for t in cut(new))
        evidence[lang] = K.LANGUAGE_SHARPNESS * total / (len(cut(new)) + K.LANGUAGE_PRIOR)
    top = max(evidence, key=lambda k: (evidence[k], k))
    want = 1 / sum(math.exp(e - evidence[top]) for e in evidence.values())
    got = X.language_scores(X.count_words(spark.createDataFrame([(1, new)], "doc_id long, text string"), "doc_id"), model).first()
    assert got.language == top and abs(got.confidence - want) < 1e-5
