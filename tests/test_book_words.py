import pytest
from pyspark.sql import functions as F

from lectura.operators import known as N
from lectura.operators import tokens as T
from lectura.operators import vocab as V
from lectura.operators.book_words import book_entries
from lectura.plans import stand_ins as S
from lectura.plans.all_queries import QUERIES

FORMS = {"la": ("el", "DET"), "las": ("el", "DET"), "casas": ("casa", "NOUN"), "van": ("ir", "VERB")}
TEXTS = [
    ("b", 3, "La Casa y las casas\n\nla casa de Ana, Ana"), ("b", 1, "Casa La LA casas\nÉl van Van é1é ÉL"), ("b", 3, "Otra casa\nvez"),
    ("b", 2, "\U0001d400\U0001d41a x\U00010400 \U00010400x 漢字 ño Õ ΟΔΟΣ Οδος ǅ aǅ _ 12 ² ٣"), ("b", None, "casa Zeta zeta"), ("c", 1, ""),
    ("c", 2, None), (None, 7, "sin Libro"), ("c", 9, "Solo"), ("c", 4, "- solo Solo"), ("", 4, "vacío"),
]


@pytest.mark.parametrize("parts", [None, 3])
def test_book_entries_are_the_counts_of_the_chapters(spark, parts):
    texts = spark.createDataFrame(TEXTS, "book_id string, chapter_index long, text string")
    got = book_entries(texts, FORMS, parts)
    paragraphs = texts.select("book_id", "chapter_index", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text")).filter("text <> ''")
    forms = spark.createDataFrame([(k, *v) for k, v in FORMS.items()], "form string, lemma string, pos string")
    counts = V.count_forms(T.words(paragraphs), forms)
    want = counts.groupBy("book_id", "lemma", "pos").agg(F.sum("n"), F.min("chapter_index"), F.count(F.lit(1)))
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(map(tuple, want.collect()), key=repr)
    assert ("b", "casa", "NOUN", 6, 1, 3) in rows and ("b", "ana", "PROPN", 2, 3, 1) in rows


def test_book_entries_hold_nothing_without_words(spark):
    texts = spark.createDataFrame([("b", 1, None), ("b", 2, "12 ...")], "book_id string, chapter_index long, text string")
    assert book_entries(texts, FORMS).collect() == []


def test_words_are_found_across_runs_of_words(spark, monkeypatch):
    from lectura.operators import book_words as B

    import pyarrow as pa

    monkeypatch.setattr(B, "WORDS_TOGETHER", 2)
    batch = pa.record_batch({"b": ["b"] * 3, "c": [2, 1, 3], "t": ["uno Dos tres\nuno cuatro", "cinco uno", "Dos\ndos Dos uno"]})
    rows = [r for found in B.count_entries([batch], {}) for r in found.to_pylist()]
    found = {(r["lemma"], r["pos"]): (r["book_count"], r["first_chapter"], r["chapters"]) for r in rows}
    assert found == {("uno", "NOUN"): (4, 1, 3), ("dos", "PROPN"): (2, 2, 2), ("dos", "NOUN"): (2, 3, 1), ("tres", "NOUN"): (1, 2, 1),
                     ("cuatro", "NOUN"): (1, 2, 1), ("cinco", "NOUN"): (1, 1, 1)}


def test_state_of_is_the_reader_state(spark):
    fsrs = "fsrs struct<state: int, stability: double>"
    cards = spark.createDataFrame([(1, "a", (2, 30.0)), (1, "b", (2, 3.0)), (2, "a", (0, None)), (2, "c", None)], f"user_id long, lemma_id string, {fsrs}")
    marks = spark.createDataFrame([(1, "b"), (3, "z"), (2, "a")], "user_id long, lemma_id string")
    want = N.reader_state(*N.known_state(cards, marks))
    assert sorted(N.state_of(cards, marks).collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["g3_book_coverage", "g5_coverage_band", "d9_reading_statistics", "r7_stratified_sample"])
def test_whole_books_need_no_row_per_chapter_and_word(spark, monkeypatch, name):
    def none(*_):
        raise AssertionError("words were counted per chapter")

    monkeypatch.setattr(S, "counts", none)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
