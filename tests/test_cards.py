from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectura.functions import srs
from lectura.operators import sessions as E
from lectura.operators import srs as D
from lectura.sources import seeds as I

T0 = datetime(2026, 1, 5, 8)
US = srs.DAY_US


def study(grades):
    """Answer a card each time it falls due, in plain Python; returns the log and the card."""
    start = int((T0 - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    card, log = srs.empty_card(start), []
    for g in grades:
        log.append((card[0], g))
        card = srs.answer_py(card, g, card[0])
    return log, card


def test_first_answers():
    waits = [srs.answer_py(srs.empty_card(0), g, 0)[0] for g in (1, 2, 3, 4)]
    assert waits == [60_000_000, 360_000_000, 600_000_000, 8 * US]


def test_schedule_over_weeks():
    _, good = study([3] * 6)
    assert (good[8], good[6], good[7]) == (2, 6, 0) and good[1] > 21
    _, again = study([1] * 6)
    assert (again[8], again[7]) == (1, 0)
    _, lapsed = study([3] * 6 + [1])
    assert (lapsed[8], lapsed[7]) == (3, 1)


def test_column_fold_equals_the_python_step(spark):
    rows = []
    for number, grades in enumerate(([3] * 6 + [1, 2, 3], [1, 2, 3, 3, 4], [4, 4, 2, 1, 1, 3], [2, 2, 3, 3, 2])):
        log, card = study(grades)
        rows += [(1, f"c{number}", us, i, ("again", "hard", "good", "easy")[g - 1]) for i, (us, g) in enumerate(log)]
    log = spark.createDataFrame(rows, "user_id long, lemma_id string, us long, seq long, grade string").withColumn(
        "ts", srs.from_micros(F.col("us")))
    for run_length in (20_000, 7, 1):
        got = {r.lemma_id: r.fsrs for r in D.replay_reviews(log, run_length=run_length).collect()}
        for number, grades in enumerate(([3] * 6 + [1, 2, 3], [1, 2, 3, 3, 4], [4, 4, 2, 1, 1, 3], [2, 2, 3, 3, 2])):
            card, fsrs = study(grades)[1], got[f"c{number}"]
            assert (fsrs.stability, fsrs.difficulty, fsrs.reps, fsrs.lapses, fsrs.state) == (card[1], card[2], card[6], card[7], card[8])
            assert fsrs.due == datetime(1970, 1, 1) + timedelta(microseconds=card[0])


def test_any_run_length_gives_the_same_cards(spark):
    """A null reader, ids above 2^53 and a stored card without its time of creation."""
    readers = (2**53 + 1, 2**53, None)
    rows = [(u, "w", 1_000_000 * (i * 90_000 + 7), i, g) for u in readers for i, g in enumerate(("good", "easy", "again", "hard", "good"))]
    log = spark.createDataFrame(rows, "user_id long, lemma_id string, us long, seq long, grade string").withColumn("ts", srs.from_micros(F.col("us")))
    stored_card = D.replay_reviews(log.filter("user_id is null and seq < 2")).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    found = {}
    for run_length in (1, 7, 20_000):
        got = D.replay_reviews(log.filter("user_id is not null or seq >= 2"), initial=stored_card, run_length=run_length)
        found[run_length] = sorted(map(str, got.collect()))
        assert len(found[run_length]) == 3
        assert all(r.fsrs.reps == 5 and r.created_at is not None for r in got.collect())
    assert found[1] == found[7] == found[20_000]


def replay(spark, cards, actions, run_length):
    queue = spark.createDataFrame([(1, "b", 0, i, k, k) for i, k in enumerate(cards)] or [(1, "b", 0, 0, None, None)],
                                  "user_id long, book_id string, chapter_index long, ord int, key string, lemma_id string")
    log = spark.createDataFrame([(1, "b", 0, i, T0 + timedelta(seconds=i), a) for i, a in enumerate(actions)],
                                "user_id long, book_id string, chapter_index long, seq long, ts timestamp_ntz, action string")
    done, effects = E.replay_sessions(E.start_sessions(queue), log, run_length=run_length)
    row = done.first()
    return row.phase, [c.key for c in row.queue], row.passed, row.dismissed, [(e.kind, e.lemma_id) for e in effects.orderBy("seq").collect()]


def test_sessions(spark):
    for run_length in (20_000, 2):
        out = replay(spark, ["a", "b"], ["weiter", "ichKenneDas", "good"], run_length)
        assert out == ("complete", [], ["a"], ["b"], [("markKnown", "b"), ("saveCard", "a")])
        # A grade before recall and an introduction after it change nothing.
        out = replay(spark, ["a", "b"], ["good", "weiter", "weiter", "weiter", "again"], run_length)
        assert out == ("recall", ["b", "a"], [], [], [("saveCard", "a")])
        out = replay(spark, ["a"], ["weiter"], run_length)
        assert out[:2] == ("recall", ["a"])


def test_empty_session_is_complete(spark):
    assert replay(spark, [], ["weiter"], 2000)[0] == "complete"


def test_cards_by_week(spark):
    days = [(1, "a", datetime(2026, 1, 7)), (1, "b", datetime(2026, 1, 8)), (1, "c", datetime(2026, 1, 13))]
    df = spark.createDataFrame(days, "user_id long, lemma_id string, created_at timestamp_ntz")
    assert [(str(r.week_start), r.n) for r in D.cards_by_week(df).orderBy("week_start").collect()] == [("2026-01-05", 2), ("2026-01-12", 1)]


def test_anki_export(spark):
    face = lambda de, ex=None: ("NOUN", de, None, ex, None, False)
    df = spark.createDataFrame(
        [(0, "sol", face("Sonne\tx", "El sol\r\nsale.")), (1, "luz", face("Licht")), (2, "no", face(None)), (3, "bare", None)],
        "ord long, lemma_id string, face " + D.FACE_TYPE)
    lines = [r.line for r in I.anki_export(df, "D").orderBy("ord").collect()]
    assert lines == ["#separator:tab", "#html:true", "#notetype:Basic", "#deck:D",
                     "sol\tSonne x<br><i>El sol sale.</i>", "luz\tLicht"]
