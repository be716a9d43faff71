"""The event-shaped tables as streams: live cards, rolling candidates, deduplication, sittings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lectura.functions import srs
from lectura.operators.srs import replay_answers
from lectura.session import ship

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CARD_STATE = srs.STATE_TYPE.removeprefix("struct<").removesuffix(">").replace(":", " ")


class CardProcessor(StatefulProcessor):
    """One card per (reader, word); answers wait until the watermark has passed them.

    Waiting answers are applied in event-time order, so a batch replay of the same log gives the
    same card. The waiting list holds the answers of one card inside one watermark delay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", CARD_STATE)
        self.waiting = handle.getListState("waiting", "us bigint, seq bigint, g int")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            for us, seq, g in zip(pdf["us"], pdf["seq"], pdf["g"]):
                self.waiting.appendValue((int(us), int(seq), int(g)))
                earliest = int(us) // 1000 if earliest is None else min(earliest, int(us) // 1000)
        self._wake(earliest)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        limit = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(w) for w in self.waiting.get())
        ready = [w for w in waiting if w[0] // 1000 <= limit]
        later = waiting[len(ready):]
        if later:
            self.waiting.put(later)
            self._wake(later[0][0] // 1000)
        else:
            self.waiting.clear()
        if not ready:
            return
        card = tuple(self.card.get()) if self.card.exists() else srs.empty_card(ready[0][0])
        for us, _, g in ready:
            card = srs.answer_py(card, g, us)
        self.card.update(card)
        names = ["user_id", "lemma_id", *srs.FIELDS]
        yield pd.DataFrame([(*key, *card)], columns=names)

    def _wake(self, ms: int | None) -> None:
        """One timer per card, at its earliest waiting answer."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if ms is None or held is not None and held <= ms:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


def stream_card_state(reviews: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Live card state from ``reviews(user_id, lemma_id, ts, seq, grade)``, one row per update.

    Runs on the RocksDB state store; ``run_to_table`` sets it for the time of the run.
    """
    ship(reviews.sparkSession)
    prepared = (
        reviews.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        .select("user_id", "lemma_id", "ts", F.unix_micros("ts").alias("us"),
                F.col("seq").cast("long").alias("seq"), srs.grade_number(F.col("grade")).alias("g"))
        .filter(F.col("g").isNotNull())
    )
    types = dict(prepared.dtypes)
    schema = f"user_id {types['user_id']}, lemma_id {types['lemma_id']}, " + CARD_STATE
    return prepared.groupBy("user_id", "lemma_id").transformWithStateInPandas(
        statefulProcessor=CardProcessor(),
        outputStructType=schema, outputMode="Update", timeMode="EventTime",
    )


def run_cards(reviews: DataFrame, folder: str, delay: str = "1 hour") -> DataFrame:
    """The rows of ``stream_card_state``, with answers waiting in the state of an aggregation and cards folded in the JVM.

    Answers of a card are given out, by the millisecond, once the watermark has reached them. Each micro-batch folds
    them onto the newest row that earlier batches wrote of that card; ``folder`` holds one table per batch, written anew
    if the batch is repeated.
    """
    spark, out = reviews.sparkSession, f"{folder}/table"
    waiting = (
        reviews.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{delay} -1 milliseconds")
        .select("user_id", "lemma_id", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), srs.grade_number(F.col("grade")).alias("g"))
        .filter(F.col("g").isNotNull())
        .groupBy(F.window("ts", "1 millisecond"), "user_id", "lemma_id").agg(F.collect_list(F.struct("us", "seq", "g")).alias("answers"))
        .select("user_id", "lemma_id", F.inline("answers"))
    )
    types = dict(waiting.dtypes)
    schema = f"user_id {types['user_id']}, lemma_id {types['lemma_id']}, " + CARD_STATE
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def fold(batch: DataFrame, number: int) -> None:
        earlier = batch.sparkSession.read.schema(schema + ", batch long").parquet(out).filter(F.col("batch") < number)
        newest = earlier.groupBy("user_id", "lemma_id").agg(F.max_by(F.struct(*srs.FIELDS), "reps").alias("c")).select(
            "user_id", "lemma_id", F.lit(None).cast("timestamp_ntz").alias("created_at"), srs.to_fsrs(F.col("c")).alias("fsrs"))
        cards = replay_answers(batch, newest).select("user_id", "lemma_id", srs.from_fsrs(F.col("fsrs")).alias("c"))
        cards.select("user_id", "lemma_id", "c.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _rocksdb(spark):
        query = waiting.writeStream.foreachBatch(fold).outputMode("append").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(schema + ", batch long").parquet(out)


def stream_candidates(plays: DataFrame, min_plays: int = 3, days: int = 30, slide: int = 1, delay: str = "1 day") -> DataFrame:
    """Tracks played at least ``min_plays`` times in a rolling window of days."""
    return (
        plays.filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{days} days", f"{slide} day").alias("w"), "user_id", "track_key")
        .agg(F.count(F.lit(1)).alias("plays"))
        .filter(F.col("plays") >= min_plays)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "track_key", "plays")
    )


def stream_days(plays: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Plays of a track by day, newest count last: one row of state per reader, track and day instead of one per window.

    A day takes plays for as long as one of the windows of ``days`` days that hold it may be open.
    """
    return (
        plays.filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", f"{delay} {days - 1} days")
        .groupBy(F.window("ts", "1 day").alias("w"), "user_id", "track_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("day"), "user_id", "track_key", "n")
    )


def run_candidates(plays: DataFrame, folder: str, min_plays: int = 3, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Run ``stream_days`` over what is there now and roll the days up: the windows of ``stream_candidates`` that have closed.

    A play that comes after some of its windows have closed counts in all of them, as they are made anew from the days.
    """
    updates, mark = run_until(stream_days(plays, days, delay), folder, "update")
    daily = updates.groupBy("user_id", "track_key", "day").agg(F.max("n").alias("n"))
    return rolling_candidates(daily, mark + F.make_dt_interval(F.lit(days - 1)), min_plays, days)


def rolling_candidates(daily: DataFrame, until: Column, min_plays: int = 3, days: int = 30) -> DataFrame:
    """The rows of ``stream_candidates`` from the plays per day: windows that end by ``until``.

    Only tracks that a reader has played often enough are looked at window by window. A track's list holds one number per day.
    """
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    played = daily.groupBy("user_id", "track_key").agg(F.sum("n").alias("_all"), F.collect_list(F.struct(day.alias("d"), "n")).alias("_days"))
    often = played.filter(F.col("_all") >= min_plays).withColumn(
        "_s", F.explode(F.array_distinct(F.flatten(F.transform("_days", lambda x: F.sequence(x["d"] - (days - 1), x["d"]))))))
    inside = F.filter("_days", lambda x: (x["d"] >= F.col("_s")) & (x["d"] < F.col("_s") + days))
    start = lambda k: F.date_add(F.lit("1970-01-01").cast("date"), k).cast("timestamp")
    return (
        often.select(start(F.col("_s")).alias("window_start"), start(F.col("_s") + days).alias("window_end"), "user_id", "track_key",
                     F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("plays"))
        .filter((F.col("plays") >= min_plays) & (F.col("window_end") <= until))
    )


def stream_dedupe(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each answer or play once, however often it is delivered inside the delay."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def stream_cards_by_week(cards: DataFrame, delay: str = "1 day") -> DataFrame:
    """New cards per week; the epoch is a Thursday, so weeks start four days later."""
    return (
        cards.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "7 days", "7 days", "4 days").alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.to_date("w.start").alias("week_start"), "n")
    )


def stream_sittings(reviews: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of answers of one reader without a pause longer than ``gap``."""
    return (
        reviews.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("answers"))
        .select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "answers")
    )


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files.

    The pattern matches the path itself: a folder is then listed, a file is taken as it is.
    """
    return spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table below ``folder`` and read it."""
    return run_until(stream, folder, mode)[0]


def run_until(stream: DataFrame, folder: str, mode: str = "append") -> tuple[DataFrame, Column]:
    """As ``run_to_table``, with the watermark that the stream has reached."""
    with _rocksdb(stream.sparkSession):
        return _run(stream.sparkSession, stream, folder, mode)


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _run(spark: SparkSession, stream: DataFrame, folder: str, mode: str) -> tuple[DataFrame, Column]:
    out, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")
        writer = stream.writeStream.foreachBatch(save).outputMode(mode)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    mark = F.to_timestamp(F.lit(max(marks, default="1970-01-01T00:00:00.000Z")))
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out), mark
