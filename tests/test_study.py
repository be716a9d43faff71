import pytest
from pyspark.sql import functions as F

from lectura.operators import coverage as G
from lectura.operators import teach as C
from lectura.operators.ranking import in_ranges, ordered_rank

LEX = "book_id string, key string, lemma string, pos string, book_count long, zipf double, mexicanism boolean"


def teachable(spark, pos="NOUN", count=1, zipf=0.0, regional=False):
    df = spark.createDataFrame([("b", "m0", "x", pos, count, zipf, regional)], LEX)
    return df.select(C.teach_reason().alias("r")).first()["r"]


def test_teach_rules(spark):
    assert teachable(spark, count=3) == "bookCount"
    assert teachable(spark, count=2) is None
    assert teachable(spark, zipf=3.5) == "zipf"
    assert teachable(spark, zipf=3.49) is None
    assert teachable(spark, count=2, regional=True) == "mexicanism"
    assert teachable(spark, count=1, regional=True) is None
    assert teachable(spark, pos="PROPN", count=300) is None
    assert teachable(spark, pos="DET", count=300) is None
    assert teachable(spark, pos="INTJ", count=3) == "bookCount"


def tables(spark, entries, known=(), carded=()):
    lexicon = spark.createDataFrame([("b", k, l, p, n, 0.0, False) for k, l, p, n in entries], LEX)
    vocab = spark.createDataFrame([(1, "b", 0, k, 1) for k, *_ in entries], "user_id long, book_id string, chapter_index long, key string, n long")
    state = lambda ws: spark.createDataFrame([(1, w) for w in ws], "user_id long, lemma_id string")
    return vocab, lexicon, state(known), state(carded)


def test_teach_set(spark):
    entries = [("m1", "Casa ", "NOUN", 5), ("m2", "sol", "NOUN", 9), ("m3", "raro", "NOUN", 1), ("m4", "de", "ADP", 90),
               ("m5", "visto", "VERB", 7), ("m6", "visto", "NOUN", 1), ("m7", "luz", "NOUN", 5), ("m8", "Ana", "PROPN", 9)]
    live = C.select_teach_set(*tables(spark, entries, known=["sol"], carded=["visto"]))
    rows = [(r.part, r.key) for r in live.orderBy("part", "ord").collect()]
    # A carded word that is not teachable is still gloss-only; a known one is in no list.
    assert rows == [("gloss_only", "m3"), ("gloss_only", "m4"), ("gloss_only", "m6"), ("teach", "m1"), ("teach", "m7")]


def segments(spark, debut_of, paragraphs, cap=18):
    teach = spark.createDataFrame(
        [(1, "b", 0, "teach", k, k, c) for k, (_, c) in debut_of.items()],
        "user_id long, book_id string, chapter_index long, part string, key string, lemma_id string, book_count long")
    seen = spark.createDataFrame([("b", 0, k, p) for k, (p, _) in debut_of.items() if p is not None],
                                 "book_id string, chapter_index long, key string, debut int")
    chapters = spark.createDataFrame([("b", 0, paragraphs)], "book_id string, chapter_index long, paragraph_count int")
    out = C.split_segments(teach, seen, chapters, cap).orderBy("segment").collect()
    return [(r.paragraph_start, r.paragraph_end, [c.key for c in r.cards]) for r in out]


def test_segments_tile_the_chapter(spark):
    out = segments(spark, {f"k{p}{i}": (p, i) for p in range(10) for i in range(5)}, 10)
    assert [len(c) for _, _, c in out] == [15, 15, 15, 5]
    assert [(a, b) for a, b, _ in out] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert out[0][2][:3] == ["k04", "k14", "k24"]


def test_segment_overflow_and_orphans(spark):
    out = segments(spark, {f"k{i:02}": (1, 1) for i in range(20)}, 4)
    assert [(a, b, len(c)) for a, b, c in out] == [(0, 2, 20), (2, 4, 0)]
    out = segments(spark, {"a": (0, 1), "o1": (None, 5), "o2": (None, 4), "o3": (None, 3)}, 1, cap=3)
    assert out == [(0, 1, ["o1", "o2", "o3"])]


def test_a_chapter_with_nothing_to_teach_is_one_segment(spark):
    teach = spark.createDataFrame([], "user_id long, book_id string, chapter_index long, part string, key string, lemma_id string, book_count long")
    seen = spark.createDataFrame([], "book_id string, chapter_index long, key string, debut int")
    chapters = spark.createDataFrame([("b", 0, 6)], "book_id string, chapter_index long, paragraph_count int")
    opened = spark.createDataFrame([(1, "b", 0)], "user_id long, book_id string, chapter_index long")
    out = C.split_segments(teach, seen, chapters, opened=opened).collect()
    assert [(r.segment, r.paragraph_start, r.paragraph_end, r.cards) for r in out] == [(0, 0, 6, [])]


@pytest.mark.parametrize("cards,sessions", [(0, 0), (1, 1), (18, 1), (19, 2), (3226, 180)])
def test_sessions_remaining(spark, cards, sessions):
    assert spark.range(1).select(C.sessions_remaining(F.lit(cards)).alias("s")).first()["s"] == sessions


def test_coverage(spark):
    vocab, lexicon, known, carded = tables(spark, [("m1", "sol", "NOUN", 5), ("m2", "sol", "VERB", 1), ("m3", "luz", "NOUN", 9)], known=["sol"])
    extra = spark.createDataFrame([(1, "b", 0, "gone", 4)], vocab.schema)
    open_ = spark.createDataFrame([(1, "b", 0, 10, 3), (1, "b", 1, 0, 0)],
                                  "user_id long, book_id string, chapter_index long, token_count long, propn_tokens long")
    rows = G.coverage(open_, vocab.union(extra), lexicon, known).orderBy("chapter_index").collect()
    assert [r.coverage for r in rows] == [0.5, 1.0]
    study = G.chapter_study(open_, vocab, lexicon, known, carded)
    assert [(r.coverage, r.projected) for r in G.projected_coverage(study).orderBy("chapter_index").collect()] == [(0.5, 0.6), (1.0, 1.0)]


def test_rank_matches_a_plain_window(spark):
    words = [("b%d" % (i % 2), "w%05d" % (i * 7919 % 5000)) for i in range(3000)] + [("b0", "zz"), ("b0", "z"), ("b0", "")]
    df = spark.createDataFrame(words, "book_id string, lemma string").distinct()
    got = {(r.book_id, r.lemma): r.n for r in ordered_rank(df, ["book_id"], ["lemma"], "n").collect()}
    for book in ("b0", "b1"):
        ordered = sorted(l for b, l in set(words) if b == book)
        assert [got[(book, l)] for l in ordered] == list(range(len(ordered)))


def test_ranges_follow_the_rows_and_not_their_prefix(spark):
    """A million lemmas that share their first characters, in one book, beside a small book."""
    same = spark.range(1_000_000).select(F.lit("b").alias("book_id"), F.concat(F.lit("prefix"), F.lpad("id", 7, "0")).alias("lemma"), "id")
    df = same.union(spark.range(5).select(F.lit("a"), F.concat(F.lit("x"), "id"), "id"))
    sizes = [r["count"] for r in in_ranges(df, ["book_id"], ["lemma"]).groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    ranked = ordered_rank(df, ["book_id"], ["lemma"], "n")
    assert ranked.filter("n <> id").count() == 0 and ranked.count() == 1_000_005


def test_whole_books_match_the_plain_classification(spark):
    """Per-chapter sums corrected by each reader's words equal the table of readers times vocabulary."""
    entries = [("m1", "Casa", "NOUN", 5), ("m2", "sol", "NOUN", 9), ("m3", "raro", "NOUN", 1), ("m4", "de", "ADP", 90), ("m5", "visto", "VERB", 7), ("m6", "visto", "NOUN", 1)]
    lexicon = spark.createDataFrame([("b", k, l, p, n, 0.0, False) for k, l, p, n in entries], LEX)
    words = [(c, i, 2 + c + i) for c in range(3) for i in range(len(entries)) if (c + i) % 3]
    counts = spark.createDataFrame([("b", c, entries[i][1], entries[i][2], n) for c, i, n in words] + [("b", 0, "Ana", "PROPN", 4)],
                                   "book_id string, chapter_index long, lemma string, pos string, n long")
    readers = {1: (["sol"], ["visto"]), 2: ([], []), 3: (["visto", "de"], ["casa", "sol"])}
    state = lambda k: spark.createDataFrame([(u, w) for u, s in readers.items() for w in s[k]], "user_id long, lemma_id string")
    listed = spark.createDataFrame([(u, "b", c, 60, 4 if c == 0 else 0) for u in readers for c in range(4)],
                                   "user_id long, book_id string, chapter_index long, token_count long, propn_tokens long")
    vocab = spark.createDataFrame([(u, "b", c, entries[i][0], n) for u in readers for c, i, n in words],
                                  "user_id long, book_id string, chapter_index long, key string, n long")
    plain = G.chapter_study(listed, vocab, lexicon, state(0), state(1))
    got = G.listed_study(listed, counts, lexicon, state(0), state(1))
    order = ["user_id", "chapter_index"]
    assert got.select(plain.columns).orderBy(order).collect() == plain.orderBy(order).collect()
    parts = C.classify_vocabulary(vocab, lexicon, state(0), state(1)).filter("part = 'gloss_only'").groupBy("user_id", "chapter_index").count()
    gloss = {(r.user_id, r.chapter_index): r["count"] for r in parts.collect()}
    assert {(r.user_id, r.chapter_index): r.gloss_only for r in got.collect() if r.gloss_only} == gloss


def test_the_corpus_meets_no_dictionary_in_a_shuffle(spark):
    from lectura.plans import stand_ins as S

    plan = S.counts_once(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("BroadcastHashJoin" in j for j in joins)
    assert not any("SortMergeJoin" in j and ("word#" in j or "[s#" in j) for j in joins)


def test_sums_of_readers_in_small_blocks(spark, monkeypatch):
    import random

    from lectura.operators import coverage as G

    for name, value in (("READERS_TOGETHER", 3), ("CHAPTERS_TOGETHER", 2), ("LEMMAS_TOGETHER", 4)):
        monkeypatch.setattr(G, name, value)
    rnd = random.Random(4)
    words = [(f"b{b}", c, f"w{k}", rnd.randrange(1, 9), rnd.random() < 0.5, rnd.randrange(3), rnd.randrange(2))
             for b in range(3) for c in range(7) for k in range(30) if rnd.random() < 0.4]
    state = [(u, f"w{k}", rnd.random() < 0.6, rnd.random() < 0.8) for u in range(11) for k in range(40) if rnd.random() < 0.3]
    readers = [(u, f"b{b}") for u in range(13) for b in range(4) if rnd.random() < 0.7]
    got = G.reader_sums(
        spark.createDataFrame(readers, "user_id long, book_id string"),
        spark.createDataFrame(words, "book_id string, chapter_index long, lemma_id string, n long, _ok boolean, _cards long, _gloss long"),
        spark.createDataFrame(state, "user_id long, lemma_id string, is_known boolean, is_carded boolean")).collect()
    want = {}
    for user, book in readers:
        for b, chapter, lemma, n, ok, cards, gloss in words:
            for u, w, known, _ in state:
                if (u, b, w) == (user, book, lemma):
                    add = (n, 0 if ok else n, cards, gloss) if known else (0, -n if ok else 0, cards, 0)
                    want[user, b, chapter] = tuple(x + y for x, y in zip(want.get((user, b, chapter), (0,) * 4), add))
    sums = {(r["user_id"], r["book_id"], r["chapter_index"]): (r["_known"], r["_after_fix"], r["_cards_fix"], r["_gloss_fix"]) for r in got}
    assert len(sums) == len(got) and {k: v for k, v in sums.items() if any(v)} == {k: v for k, v in want.items() if any(v)}


def test_stratified_sample_in_one_pass_against_three_lists(spark):
    import hashlib
    import random

    from lectura.operators.report import stratified_sample

    rnd = random.Random(6)
    rows = [(f"b{b}", f"m{k:04}", f"w{k}", "NOUN", rnd.randint(1, 5), rnd.random() < share, rnd.choice(("TEACH", "TEACH", "GLOSS_ONLY")))
            for b, (n, share) in enumerate([(300, 0.2), (300, 0.0), (25, 0.5), (4, 1.0), (1, 0.0), (300, 1.0)]) for k in range(n)]
    names = ["book_id", "key", "lemma", "pos", "book_count", "mexicanism"]
    df = spark.createDataFrame(rows, "book_id string, key string, lemma string, pos string, book_count long, mexicanism boolean, class string")
    want = []
    for book in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == book and r[-1] == "TEACH"]
        drawn = sorted(mine, key=lambda r: (hashlib.md5(f"42:{r[1]}".encode()).hexdigest(), r[1]))
        chosen = sorted(mine, key=lambda r: (-r[4], r[1]))[:10] + [r for r in drawn if r[5]][:10]
        rest = [r for r in drawn if r not in chosen][: 30 - len(chosen)]
        want += {r[:6] for r in chosen + rest}
    got = stratified_sample(df.repartition(7), 30, 42)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Scan ExistingRDD") == 1
