"""Cards: creation, replay of review logs, what is due, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectura.functions import srs
from lectura.operators.folds import RUN_LENGTH, ended, fold_runs, in_runs
from lectura.operators.known import READER_LEMMA

FACE_TYPE = "struct<pos:string,de:string,en:string,example:string,region_note:string,mexicanism:boolean>"


def new_cards(df: DataFrame, now: Column) -> DataFrame:
    """An empty card, due now, for every (user_id, lemma_id); a ``face`` column is kept."""
    face = F.col("face") if "face" in df.columns else F.lit(None).cast(FACE_TYPE)
    return df.select(
        *READER_LEMMA, now.cast("timestamp_ntz").alias("created_at"),
        srs.to_fsrs(srs.new_state(srs.to_micros(now))).alias("fsrs"), face.alias("face"),
    )


def replay_reviews(
    log: DataFrame, initial: DataFrame | None = None, run_length: int = RUN_LENGTH
) -> DataFrame:
    """Fold ``log(user_id, lemma_id, ts, seq, grade)`` into one card per (reader, word).

    Answers apply in (ts, seq) order; a card in ``initial(user_id, lemma_id, created_at, fsrs)``
    continues, any other starts new at its first answer. A card without ``created_at`` gets the time
    of that answer. Only words in the log are returned; a null reader is a reader.
    """
    reviews = log.select(
        *READER_LEMMA, srs.to_micros(F.col("ts")).alias("us"),
        (F.col("seq") if "seq" in log.columns else F.lit(0)).cast("long").alias("seq"),
        srs.grade_number(F.col("grade")).alias("g"),
    ).filter(F.col("g").isNotNull())
    return replay_answers(reviews, initial, run_length)


def replay_answers(reviews: DataFrame, initial: DataFrame | None = None, run_length: int = RUN_LENGTH) -> DataFrame:
    """``replay_reviews`` of answers ``reviews(user_id, lemma_id, us, seq, g)`` with their times in microseconds and grades 1 to 4."""
    runs = in_runs(reviews, READER_LEMMA, ["us", "seq", "g"], run_length)
    begun = _with_initial(runs.filter(F.col("run") == 0), initial)
    first_us = F.get("items", F.lit(0))["us"]
    begun = begun.withColumn("created_at", F.coalesce("created_at", srs.from_micros(first_us)))
    rounds = fold_runs(
        runs, begun, READER_LEMMA, ["created_at"], F.coalesce("start", srs.new_state(first_us)), lambda card: card,
        lambda card, answers: F.aggregate(answers, card, lambda c, a: srs.answer(c, a["g"], a["us"])),
    )
    return ended(rounds).select(*READER_LEMMA, "created_at", srs.to_fsrs(F.col("end")).alias("fsrs"))


def _with_initial(df: DataFrame, initial: DataFrame | None) -> DataFrame:
    if initial is None:
        return df.withColumn("created_at", F.lit(None).cast("timestamp_ntz")).withColumn(
            "start", F.lit(None).cast(srs.STATE_TYPE)
        )
    start = initial.select(
        F.col("user_id").alias("_user"), F.col("lemma_id").alias("_lemma"), "created_at",
        srs.from_fsrs(F.col("fsrs")).alias("start"),
    )
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("lemma_id").eqNullSafe(F.col("_lemma"))
    return df.join(start, same, "left").drop("_user", "_lemma")


def due_cards(cards: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Cards due now, soonest first, ties by word; ``limit`` cuts per reader."""
    order = Window.partitionBy("user_id").orderBy("fsrs.due", "lemma_id")
    due = cards.filter(F.col("fsrs.due") <= now).withColumn("ord", F.row_number().over(order))
    return due if limit is None else due.filter(F.col("ord") <= limit)


def due_counts(cards: DataFrame, now: Column) -> DataFrame:
    return cards.groupBy("user_id").agg(F.count_if(F.col("fsrs.due") <= now).alias("due"))


def cards_by_state(cards: DataFrame) -> DataFrame:
    """Per reader one row per state, zero counts kept."""
    states = ("new", "learning", "review", "relearning")
    counts = cards.groupBy("user_id").agg(
        *[F.count_if(F.col("fsrs.state") == i).alias(s) for i, s in enumerate(states)]
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in states])
    return counts.select("user_id", F.explode(pairs).alias("_p")).select("user_id", "_p.state", "_p.n")


def next_due(cards: DataFrame) -> DataFrame:
    return cards.groupBy("user_id").agg(F.min("fsrs.due").alias("next_due"))


def cards_by_week(cards: DataFrame) -> DataFrame:
    """Cards created per week, weeks starting on Monday in UTC."""
    week = F.to_date(F.date_trunc("week", F.col("created_at")))
    return cards.groupBy("user_id", week.alias("week_start")).agg(F.count(F.lit(1)).alias("n"))


def reading_statistics(
    provenance: DataFrame, cards: DataFrame, book_rows: DataFrame, positions: DataFrame
) -> DataFrame:
    """Per (reader, book): words known and cards of the reader, coverage, chapters opened, and the
    reader's cards by week, as an array of (week_start, n) in order.
    """
    weeks = cards_by_week(cards).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("week_start", "n"))).alias("by_week")
    )
    totals = cards.groupBy("user_id").agg(F.count(F.lit(1)).alias("cards_total"))
    opened = positions.groupBy("user_id", "book_id").agg(F.count(F.lit(1)).alias("chapters_opened"))
    known = provenance.select("user_id", F.col("total").alias("vocabulary_known"))
    zero = F.lit(0).cast("long")
    return (
        book_rows.select("user_id", "book_id", "coverage")
        .join(opened, ["user_id", "book_id"], "left")
        .join(known, "user_id", "left")
        .join(totals, "user_id", "left")
        .join(weeks, "user_id", "left")
        .select(
            "user_id", "book_id", "coverage",
            *[F.coalesce(c, zero).alias(c) for c in ("chapters_opened", "vocabulary_known", "cards_total")], "by_week",
        )
    )


def due_by_chapter(cards: DataFrame, vocab: DataFrame, lexicon: DataFrame, now: Column) -> DataFrame:
    """Due cards whose word occurs in each chapter the reader has open.

    ``vocab(user_id, book_id, chapter_index, key)``.
    """
    due = cards.filter(F.col("fsrs.due") <= now).select(*READER_LEMMA)
    words = vocab.join(
        lexicon.select("book_id", "key", F.lower(F.trim("lemma")).alias("lemma_id")), ["book_id", "key"]
    )
    return words.join(due, list(READER_LEMMA), "left_semi").groupBy(
        "user_id", "book_id", "chapter_index"
    ).agg(F.count_distinct("lemma_id").alias("due"))


def card_view(cards: DataFrame) -> DataFrame:
    """What the review screen shows; a card without face falls back to its bare word."""
    face = F.col("face")
    return cards.select(
        *READER_LEMMA, F.col("lemma_id").alias("lemma"),
        F.coalesce(face["pos"], F.lit("")).alias("pos"),
        *[face[c].alias(c) for c in ("de", "en", "example", "region_note")],
        F.coalesce(face["mexicanism"], F.lit(False)).alias("mexicanism"),
    )


def get_cards(cards: DataFrame, ids: DataFrame) -> DataFrame:
    return cards.join(ids, list(READER_LEMMA), "left_semi")
