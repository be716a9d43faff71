"""What a reader knows: set operations over ``cards`` and ``known_lemmas``.

``cards(user_id, lemma_id, created_at, fsrs, face)`` ·
``known_lemmas(user_id, lemma_id, marked_at, source)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions import srs
from lectura.functions.text import lemma_id

READER_LEMMA = ("user_id", "lemma_id")


def known_state(
    cards: DataFrame, known: DataFrame, min_days: float = K.KNOWN_MIN_STABILITY_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(known, carded): marked or matured words; every word that has a card at all."""
    matured = cards.filter(srs.is_known(F.col("fsrs"), min_days)).select(*READER_LEMMA)
    return (
        known.select(*READER_LEMMA).union(matured).distinct(),
        cards.select(*READER_LEMMA).distinct(),
    )


def reader_state(known: DataFrame, carded: DataFrame) -> DataFrame:
    """Both tests side by side, one row per (reader, word), so that later plans join once."""
    flags = known.select(*READER_LEMMA, F.lit(True).alias("k"), F.lit(False).alias("c")).union(
        carded.select(*READER_LEMMA, F.lit(False).alias("k"), F.lit(True).alias("c"))
    )
    return flags.groupBy(*READER_LEMMA).agg(
        F.max("k").alias("is_known"), F.max("c").alias("is_carded")
    )


def state_of(cards: DataFrame, known: DataFrame, min_days: float = K.KNOWN_MIN_STABILITY_DAYS) -> DataFrame:
    """``reader_state`` of ``known_state``, where each table is read once."""
    matured = F.coalesce(srs.is_known(F.col("fsrs"), min_days), F.lit(False))
    flags = cards.select(*READER_LEMMA, matured.alias("k"), F.lit(True).alias("c")).union(
        known.select(*READER_LEMMA, F.lit(True).alias("k"), F.lit(False).alias("c")))
    return flags.groupBy(*READER_LEMMA).agg(F.max("k").alias("is_known"), F.max("c").alias("is_carded"))


def known_provenance(
    cards: DataFrame, known: DataFrame, min_days: float = K.KNOWN_MIN_STABILITY_DAYS
) -> DataFrame:
    """Per reader: seed / manual / legacy / matured-only / total; the stored row wins."""
    stored = known.select(*READER_LEMMA, "source", F.lit(True).alias("_stored"))
    matured = (
        cards.filter(srs.is_known(F.col("fsrs"), min_days)).select(*READER_LEMMA).distinct()
    )
    merged = stored.join(matured, list(READER_LEMMA), "full_outer")
    has_row, source = F.col("_stored").isNotNull(), F.col("source")
    named = F.coalesce(source.isin("seed", "manual"), F.lit(False))
    return merged.groupBy("user_id").agg(
        F.count_if(source == "seed").alias("seed"),
        F.count_if(source == "manual").alias("manual"),
        F.count_if(has_row & ~named).alias("legacy"),
        F.count_if(~has_row).alias("matured_only"),
        F.count(F.lit(1)).alias("total"),
    )


def merge_seed(known: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged table, report): idempotent upsert by word, later write wins.

    ``seed(user_id, lemma_id, marked_at)``; the report has in_file, added and total per reader.
    """
    incoming = seed.select(*READER_LEMMA, "marked_at", F.lit("seed").alias("source"))
    incoming = incoming.groupBy(*READER_LEMMA).agg(
        F.max("marked_at").alias("marked_at"), F.first("source").alias("source")
    )
    kept = known.join(incoming, list(READER_LEMMA), "left_anti")
    merged = kept.unionByName(incoming.select(*kept.columns))
    before = known.select(*READER_LEMMA, F.lit(1).alias("old"))
    report = (
        incoming.select(*READER_LEMMA, F.lit(1).alias("new"))
        .join(before, list(READER_LEMMA), "full_outer")
        .groupBy("user_id")
        .agg(
            F.count("new").alias("in_file"),
            F.count_if(F.col("old").isNull()).alias("added"),
            F.count(F.lit(1)).alias("total"),
        )
        .filter(F.col("in_file") > 0)
    )
    return merged, report


def to_lemma_ids(keys: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Book-scoped keys to global words; unknown keys drop out."""
    entries = lexicon.select("book_id", "key", lemma_id(F.col("lemma")).alias("lemma_id"))
    return keys.join(entries, ["book_id", "key"])


def known_overlap(cards: DataFrame, known: DataFrame) -> DataFrame:
    """Per reader: words only marked, only carded, and both."""
    marked = known.select(*READER_LEMMA).distinct()
    mined = cards.select(*READER_LEMMA).distinct()
    parts = (
        marked.subtract(mined).withColumn("part", F.lit("seed_only"))
        .union(mined.subtract(marked).withColumn("part", F.lit("mined_only")))
        .union(marked.intersect(mined).withColumn("part", F.lit("both")))
    )
    return parts.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))
