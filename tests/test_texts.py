"""Sentences by rule, compatibility forms, and cards added by hand."""

import unicodedata

import regex
from pyspark.sql import functions as F

from lectura.functions import text as T
from lectura.operators import teach as C
from lectura.operators import tokens

CASES = {
    "El Sr. Pérez vino. ¿Qué dijo J. R. R. Tolkien? Nada… pero 3.5 sí! 7 años. Fin": [
        "El Sr. Pérez vino.", "¿Qué dijo J. R. R. Tolkien?", "Nada… pero 3.5 sí!", "7 años.", "Fin"],
    "«Ven.» Dijo ella.  «¿Ya?» —Sí. —No…\tY se fue": ["«Ven.»", "Dijo ella.", "«¿Ya?»", "—Sí.", "—No…", "Y se fue"],
    "Er kam, z. B. gestern. Dr. Braun (Nr. 4) sah ihn!? Ja.": ["Er kam, z. B. gestern.", "Dr. Braun (Nr. 4) sah ihn!?", "Ja."],
    "one sentence without end": ["one sentence without end"],
    "... y luego. etc. sigue": ["... y luego. etc. sigue"],
    "": [], " \n ": [], "No. Sí.": ["No.", "Sí."],
}


def test_sentences(spark):
    got = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", T.sentences(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == CASES
    rows = spark.createDataFrame([(1, "1. Casa. Casa Blanca")], "id long, text string")
    found = tokens.sentence_words(rows).collect()
    assert [(r["sentence_index"], r["s"], r["first_word"]) for r in found] == [(0, "Casa", True), (1, "Casa", False), (1, "Blanca", False)] \
        or [(r["s"], r["first_word"]) for r in found] == [("Casa", True), ("Casa", False), ("Blanca", False)]


def test_compatibility_forms(spark):
    plain = regex.compile(f"[{T.PLAIN_CHARACTERS}]")
    kept = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and plain.match(chr(c)))
    assert unicodedata.normalize("NFKC", kept) == kept and len(kept) > 350
    titles = ["Ｌａ Ｂａｍｂａ", "ﬁn del mundo", "Café ①", "plain", None, "ｶﾞ ½"]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(T.compatible(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [t and unicodedata.normalize("NFKC", t) for t in titles]
    assert spark.createDataFrame([("Ｌａ Ｂａｍｂａ（Live）",)], "t string").select(T.title_key(F.col("t")).alias("k")).first()["k"] == "la bamba"


def test_added_cards(spark):
    lexicon = spark.createDataFrame(
        [("b", "m1", "sol", "NOUN", "Sonne", None), ("c", "m9", "Sol", "VERB", "sonnen", None), ("b", "m2", "de", "ADP", "von", None), ("b", "m3", "luz", "NOUN", None, None)],
        "book_id string, key string, lemma string, pos string, de string, en string",
    ).withColumns({"example": F.lit(None).cast("string"), "region_note": F.lit(None).cast("string"), "mexicanism": F.lit(False)})
    requests = spark.createDataFrame([(1, "b", "m1", 1), (1, "c", "m9", 2), (1, "b", "m2", 3), (1, "b", "m3", 4), (1, "b", "m3", 5), (2, "b", "m1", 6), (2, "b", "zz", 7)],
                                     "user_id long, book_id string, key string, at long")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    from lectura.operators.srs import new_cards

    old = new_cards(spark.createDataFrame([(1, "luz"), (9, "mar")], "user_id long, lemma_id string"), now)
    later = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    got = C.add_cards(requests, lexicon, old, later, ["at"]).select("user_id", "lemma_id", F.month("created_at").alias("m"), "face.de", "face.pos").collect()
    assert sorted(tuple(r) for r in got) == [(1, "luz", 1, None, None), (1, "sol", 2, "sonnen", "VERB"), (2, "sol", 2, "Sonne", "NOUN"), (9, "mar", 1, None, None)]
    assert C.add_cards(requests.limit(0), lexicon, old, later, ["at"]).count() == 2


def test_words_are_counted_before_their_case_is_looked_at(spark):
    from lectura.operators import tokens as T
    from lectura.operators import vocab as V

    rows = [("b", 1, 0, "Maison maison Maison MAISON \U0001d400b ǅa"), ("b", 1, 1, "Le le Le maison"), ("b", 2, 0, "maison Maison")]
    paragraphs = spark.createDataFrame(rows, "book_id string, chapter_index long, paragraph_index int, text string")
    forms = spark.createDataFrame([("le", "der", "DET")], "form string, lemma string, pos string")
    counted = V.count_forms(T.words(paragraphs), forms)
    found = {(r.chapter_index, r.lemma, r.pos): (r.n, r.debut) for r in counted.collect()}
    assert found == {
        (1, "maison", "NOUN"): (3, 0), (1, "maison", "PROPN"): (2, 0), (1, "\U0001d400b", "PROPN"): (1, 0), (1, "ǆa", "NOUN"): (1, 0),
        (1, "der", "DET"): (3, 1), (2, "maison", "NOUN"): (1, 0), (2, "maison", "PROPN"): (1, 0)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[plan.rindex("Aggregate"):].partition("\n")[2]
