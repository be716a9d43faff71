"""Words of opened chapters: the shared step of the study plans, against the plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from lectura.functions.text import lemma_id
from lectura.operators import coverage as G
from lectura.operators import teach as C
from lectura.operators import vocab as V
from lectura.operators.ranking import ordered_rank


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(11)
    words = [(f"b{b}", c, f"w{k}", rnd.choice(("NOUN", "VERB", "DET", "PROPN")), rnd.randrange(1, 4), rnd.randrange(6))
             for b in range(3) for c in range(5) for k in range(60) if rnd.random() < 0.5]
    words.append(("b0", 9, "Ana", "PROPN", 2, 0))
    counts = spark.createDataFrame(words, "book_id string, chapter_index long, lemma string, pos string, n long, debut int").groupBy(
        "book_id", "chapter_index", "lemma", "pos").agg(F.sum("n").alias("n"), F.min("debut").alias("debut")).localCheckpoint()
    state = lambda share: spark.createDataFrame(
        [(u, f"w{k}") for u in range(3) for k in range(60) if rnd.random() < share], "user_id long, lemma_id string")
    pairs = [(u, f"b{b}", c) for u in range(4) for b in range(3) for c in range(5) if rnd.random() < 0.6] + [(3, "b0", 9)]
    opened = spark.createDataFrame(pairs, "user_id long, book_id string, chapter_index long")
    return counts, opened, state(0.2), state(0.3)


def entries_of(counts):
    return V.entries(counts).withColumns({"zipf": F.lit(0.0), "mexicanism": F.lit(False)})


def words_of(counts):
    return V.in_chapters(entries_of(counts).select(
        "book_id", "key", lemma_id(F.col("lemma")).alias("lemma_id"), "pos", "book_count", "first_chapter", C.is_teachable().alias("teachable"), "places"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_entries_are_the_lexicon_with_its_chapters(spark, tables):
    counts = tables[0]
    lexicon, found = V.build_lexicon(counts), V.entries(counts)
    assert rows(found, *lexicon.columns) == rows(lexicon, *lexicon.columns)
    vocab = V.chapter_vocabulary(counts, lexicon)
    assert rows(V.in_chapters(found), *vocab.columns) == rows(vocab, *vocab.columns)


def test_opened_words_match_the_plain_joins(spark, tables):
    counts, opened, known, carded = tables
    lexicon = entries_of(counts).drop("places")
    vocab = V.chapter_vocabulary(counts, lexicon).join(opened, ["book_id", "chapter_index"])
    plain = C.classify_vocabulary(vocab, lexicon, known, carded)
    found = C.classify_opened(words_of(counts), opened, known, carded)
    columns = ["user_id", "book_id", "chapter_index", "key", "n", "is_known", "is_carded", "part"]
    assert rows(found, *columns) == rows(plain, *columns) and found.count() > 200
    live = C.select_teach_set(vocab, lexicon, known, carded)
    assert rows(C.order_teach_set(found), *live.columns) == rows(live, *live.columns)
    full = C.classify_opened(words_of(counts), opened, known, carded, empty=True)
    chapters = counts.select("book_id", "chapter_index").distinct().withColumn("paragraph_count", F.lit(7))
    for cap in (2, 18):
        cut = C.split_segments(live, V.debuts(counts, lexicon), chapters, cap, opened)
        assert rows(C.segments_of(full, chapters, cap), *cut.columns) == rows(cut, *cut.columns)
    baked = C.assign_to_chapters(C.classify_all(lexicon, known.filter("user_id = 9"))).select("book_id", "chapter_index", F.explode("teach_set").alias("key"))
    drift = C.teach_drift(live, baked)
    got = C.drift_of(found, F.col("teachable") & (F.col("first_chapter") == F.col("chapter_index")))
    assert rows(got, *drift.columns) == rows(drift, *drift.columns)
    open_ = opened.join(V.chapter_totals(counts), ["book_id", "chapter_index"])
    share = G.coverage(open_, vocab, lexicon, known)
    assert rows(G.covered_share(open_, found), *share.columns) == rows(share, *share.columns)


def plain_of(tables):
    counts, opened, known, carded = tables
    return C.classify_opened(words_of(counts), opened, known, carded, empty=True), words_of(counts), (opened, known, carded)


def test_sets_of_opened_chapters_match_their_rows(spark, tables):
    """Arrays per chapter give what the rows per reader give; nobody knows what a reader without any state is shown."""
    counts = tables[0]
    full, words, state = plain_of(tables)
    found = full.filter("key IS NOT NULL")
    live = C.order_teach_set(found)
    assert rows(C.select_opened(words, *state), *live.columns) == rows(live, *live.columns) and live.filter("user_id = 3").count() > 50
    for fixed in (F.col("first_chapter") == F.col("chapter_index"), F.lit(None).cast("boolean")):
        drift = C.drift_of(found, F.col("teachable") & fixed)
        assert rows(C.drift_of_opened(words, *state, F.col("teachable") & fixed), *drift.columns) == rows(drift, *drift.columns)
    chapters = counts.select("book_id", "chapter_index").distinct().withColumn("paragraph_count", F.lit(7))
    first_only = F.when(F.col("debut") == 0, 0)
    for cap in (2, 18):
        cut = C.segments_of(full, chapters, cap)
        assert rows(C.opened_segments(words, *state, chapters, cap, empty=True), *cut.columns) == rows(cut, *cut.columns)
        cut = C.segments_of(found.filter("part = 'teach'").withColumn("debut", first_only), chapters, cap)
        assert rows(C.opened_segments(words.withColumn("debut", first_only), *state, chapters, cap), *cut.columns) == rows(cut, *cut.columns)


def test_last_offered_entry_of_every_lemma(spark, tables, monkeypatch):
    monkeypatch.setattr(C, "CHAPTERS_TOGETHER", 2)
    full, words, state = plain_of(tables)
    want = full.filter("key IS NOT NULL AND NOT is_carded").groupBy("user_id", "lemma_id").agg(F.max(F.struct("book_id", "key", "pos")).alias("_r"))
    got = C.last_offered(words, state[0], state[2], ("pos",))
    columns = ["user_id", "lemma_id", "book_id", "key", "pos"]
    assert rows(got, *columns) == rows(want.select("user_id", "lemma_id", "_r.*"), *columns) and got.count() > 100


def test_rows_of_readers_are_not_sorted(spark, tables):
    """A reader's words come out of the chapters' arrays: above the join with the readers nothing sorts, shuffles or gathers them."""
    counts = tables[0]
    _, words, state = plain_of(tables)
    chapters = counts.select("book_id", "chapter_index", F.lit(7).alias("paragraph_count")).distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (C.select_opened(words, *state), C.drift_of_opened(words, *state, F.col("teachable")), C.opened_segments(words, *state, chapters)):
            above = df._jdf.queryExecution().executedPlan().toString().split("user_id#", 1)[0]
            assert "Join" in df._jdf.queryExecution().executedPlan().toString()
            assert not any(f"{step} " in above for step in ("Sort", "Exchange", "Window", "ObjectHashAggregate"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_words_are_shuffled_by_chapter_only(spark, tables):
    """Readers meet the words where the chapters lie: nothing above that join deals out rows of readers and words."""
    counts, opened, known, carded = tables
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = C.classify_opened(words_of(counts), opened, known, carded, empty=True)
        for df in (C.order_teach_set(found), C.segments_of(found, counts.select("book_id", "chapter_index", F.lit(7).alias("paragraph_count")).distinct())):
            plan = df._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert not any("key#" in line or "lemma_id#" in line.split("hashpartitioning", 1)[1] and "user_id#" not in line for line in dealt)
            assert sum("user_id#" in line and "book_id#" in line for line in dealt) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_counts_and_ranks_shuffle_no_words(spark):
    """Texts are dealt out by chapter once, and ranked rows lie in their ranges already."""
    from lectura.plans import stand_ins as S

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = S.counts_once(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") == 1
        df = spark.range(100).select(F.lit("b").alias("book_id"), F.col("id").cast("string").alias("lemma"))
        plan = ordered_rank(df, ["book_id"], ["lemma"], "n")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ceilings_and_sweeps_of_places_match_the_plain_joins(spark, tables):
    counts, _, known, _ = tables
    lexicon = entries_of(counts).drop("places")
    vocab, totals = V.chapter_vocabulary(counts, lexicon), V.chapter_totals(counts)
    ceiling, left = G.coverage_ceiling(totals, vocab, lexicon)
    words = V.in_chapters(V.places(counts).withColumns({"zipf": F.lit(0.0), "mexicanism": F.lit(False)}))
    for parts in (None, 5):
        assert rows(G.ceiling_of(totals, words, parts), *ceiling.columns) == rows(ceiling, *ceiling.columns)
    assert rows(G.left_over_of(lexicon), *left.columns) == rows(left, *left.columns) and left.count() > 3
    plain = G.token_partition(vocab, totals)
    assert rows(G.token_partition(words, totals), *plain.columns) == rows(plain, *plain.columns)
    classes = C.classify_all(lexicon, known)
    over = C.over_cap(C.assign_to_chapters(classes), 3)
    assert rows(C.cards_over_cap(classes, 3), *over.columns) == rows(over, *over.columns) and over.count() > 2


def test_large_tables_are_dealt_to_tasks_of_bounded_size(spark, tables, monkeypatch):
    """Parts are named by the size of what they become, which adaptive execution then does not join."""
    from lectura import session

    texts = spark.range(40).select(F.col("id").alias("book_id"), F.repeat(F.lit("x"), F.lit(100)).alias("text"))
    assert session.parts_of_texts(texts) is None and session.parts_of_rows(texts) is None
    assert session.parts_of_texts(texts.limit(0)) is None
    monkeypatch.setattr(session, "CHARACTERS_TOGETHER", 100)
    monkeypatch.setattr(session, "ROWS_TOGETHER", 4)
    assert session.parts_of_texts(texts) == 40 and session.parts_of_rows(texts) == 10
    assert session.deal(texts, ["book_id"], 40).rdd.getNumPartitions() == 40
    monkeypatch.setattr(session, "ROWS_TOGETHER", 20)
    counts = tables[0]
    lexicon, found = V.build_lexicon(counts), V.entries(counts)
    assert found.count() == lexicon.count() and rows(found, *lexicon.columns) == rows(lexicon, *lexicon.columns)


def test_shelves_match_the_plain_joins(spark, tables, monkeypatch):
    for name, value in (("READERS_TOGETHER", 2), ("CHAPTERS_TOGETHER", 2), ("LEMMAS_TOGETHER", 7)):
        monkeypatch.setattr(G, name, value)
    counts, opened, known, carded = tables
    lexicon = entries_of(counts).drop("places")
    readers = opened.select("user_id", "book_id").distinct()
    chapters = counts.select("book_id", "chapter_index").distinct().union(spark.createDataFrame([("b1", 77)], "book_id string, chapter_index long"))
    chapters = chapters.withColumn("title", F.concat(F.lit("T"), "chapter_index"))
    places = opened.withColumn("fraction", F.when(F.col("chapter_index") != 2, F.col("chapter_index") / 8))
    listed = readers.join(chapters.drop("title"), "book_id").join(V.chapter_totals(counts), ["book_id", "chapter_index"], "left").fillna(0)
    plain = G.listed_study(listed, counts, lexicon, known, carded)
    found = G.shelf_study(readers, chapters, counts, lexicon, known, carded, places)
    assert rows(found, *plain.columns) == rows(plain, *plain.columns) and found.count() == listed.count()
    full = G.chapter_list(plain, chapters, places)
    assert rows(G.list_of(found), *full.columns) == rows(full, *full.columns)
    held = counts.groupBy("book_id", "lemma", "pos").agg(F.count(F.lit(1)).alias("chapters"))
    books = G.book_coverage(plain)
    got = G.book_share(G.book_sums(readers, counts, lexicon.join(held, ["book_id", "lemma", "pos"]), known, carded))
    assert rows(got, *books.columns) == rows(books, *books.columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange"), "no row of the finished table is shuffled"


def test_texts_meet_their_keys_by_chapter(spark):
    """Shapes and runs equal the joins of all tokens with the lexicon, and no token is shuffled."""
    from lectura.operators import tokens as T
    from lectura.session import literal_table

    texts = [("b", 0, 0, "  El sol, la luna; El Sol 12 Ana."), ("b", 0, 2, "¿Qué? sol"), ("b", 1, 0, "Ana ve la Luna y el mar"), ("c", 0, 0, "sol sol"), ("c", 4, 0, "12 ;")]
    paragraphs = spark.createDataFrame(texts, "book_id string, chapter_index long, paragraph_index int, text string")
    forms = literal_table(spark, [("el", "el", "DET"), ("la", "el", "DET")], "form, lemma, pos")
    entries = V.entries(V.count_forms(T.words(paragraphs), forms)).withColumn("de", F.concat(F.lit("de:"), "lemma"))
    lexicon = entries.drop("places")
    plain = T.shape_tokens(T.annotate(T.mark_first_words(T.tokenize(paragraphs)), forms), lexicon)
    vocab = V.in_chapters(entries).withColumn("marked", (F.col("lemma") != "el") & (F.col("first_chapter") == F.col("chapter_index")))
    found = T.shape_texts(paragraphs, vocab, forms, ("marked", "de"))
    assert rows(found, *plain.columns) == rows(plain, *plain.columns) and plain.filter("t IS NOT NULL").count() > 8
    listed = vocab.filter("marked").select("book_id", "chapter_index", "key")
    runs = T.merge_runs(plain, listed, lexicon)
    assert rows(T.runs_of(found), *runs.columns) == rows(runs, *runs.columns)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = T.runs_of(T.shape_texts(paragraphs, vocab, forms, ("marked", "de")))._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and ("token_index" in line or "run_index" in line) for line in plan.splitlines())
        assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_example_sentences_by_place(spark):
    """First sentences equal those found among all sentences of every word, and no shuffled row of a word holds its sentence."""
    from lectura.operators import tokens as T
    from lectura.session import literal_table

    texts = [("b", 0, 0, "El sol sale. La luna no. Ana ve el sol."), ("b", 0, 2, "Otra vez la luna. Y el mar azul."), ("b", 3, 0, "El mar. Ana ve la Luna."), ("c", 1, 0, "Sol. Mar y sol.")]
    paragraphs = spark.createDataFrame(texts, "book_id string, chapter_index long, paragraph_index int, text string")
    forms = literal_table(spark, [("el", "el", "DET"), ("la", "el", "DET")], "form, lemma, pos")
    counts = V.count_forms(T.words(paragraphs), forms).localCheckpoint()
    entries = V.entries(counts)
    lexicon, places = entries.drop("places"), V.first_places(entries)
    held = V.keyed_sentences(T.annotate(T.sentence_words(paragraphs), forms), places, lexicon)
    plain = V.example_sentences(held, lexicon)
    got = V.first_sentences(paragraphs, places, forms)
    assert rows(got, *plain.columns) == rows(plain, *plain.columns) and got.count() == lexicon.count()
    assert rows(got.filter("book_id = 'b'").join(lexicon.filter("lemma = 'mar'"), ["book_id", "key"]), "es") == [("Y el mar azul.",)]
