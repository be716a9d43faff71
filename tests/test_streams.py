import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectura.session import shared_folder
from lectura.streaming import streams as W

SCHEMA = "event_id long, user_id long, ts timestamp_ntz"


def test_a_table_is_read_as_one_file_or_as_a_folder(spark, tmp_path):
    rows = [(k, k % 3, datetime(2026, 1, 5) + timedelta(minutes=k)) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(4).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "events.parquet")
    assert Path(tmp_path / "file" / "events.parquet").is_file()
    found = []
    for form in ("folder", "file"):
        stream = W.read_table(spark, f"{tmp_path}/{form}/events.parquet", df.schema)
        out = W.run_to_table(W.stream_dedupe(stream.union(stream)), shared_folder(spark, "test"))
        found.append(sorted(r.event_id for r in out.collect()))
    assert found[0] == found[1] == list(range(40))


def test_no_silent_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://somewhere:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session(), "x")


def streamed(spark, path, rows, schema, files=1):
    """The rows as a stream that reads one file per micro-batch."""
    df = spark.createDataFrame(rows, schema)
    for k in range(files):
        part = df.filter(F.floor(F.col("seq") * files / len(rows)) == k)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def logged(n, seconds, words):
    draw = random.Random(5)
    return [(draw.randrange(3) or None, f"w{draw.randrange(words)}", datetime(2026, 1, 5) + timedelta(seconds=seconds * k, microseconds=draw.randrange(10**6)),
             k, draw.choice(["again", "hard", "good", "easy", None])) for k in range(n)]


REVIEWS = "user_id long, lemma_id string, ts timestamp_ntz, seq long, grade string"


@pytest.mark.parametrize("files", [1, 3])
def test_cards_folded_by_batch_are_those_of_the_stateful_stream(spark, tmp_path, files):
    rows = [(user or 9, *rest) for user, *rest in logged(300, 600, 12)]  # the stateful stream mixes up readers if one is null
    found = []
    for name, run in (("batches", W.run_cards), ("state", lambda s, folder: W.run_to_table(W.stream_card_state(s), folder, "update"))):
        out = run(streamed(spark, tmp_path / name, rows, REVIEWS, files), shared_folder(spark, "test"))
        last = out.groupBy("user_id", "lemma_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "batch"]), "reps").alias("c"))
        found.append(sorted((tuple(r.c) for r in last.collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) > 20


def test_no_python_state_is_kept_for_cards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "stream_card_state", None)
    from lectura.plans.all_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["w1_stream_card_state"](spark, sf).count() > 0


@pytest.mark.parametrize("files", [1, 3])
def test_windows_rolled_up_from_days_are_those_of_the_stream(spark, tmp_path, files):
    rows = logged(400, 15_000, 8)
    found = []
    for name, run in (("days", W.run_candidates), ("windows", lambda s, folder: W.run_to_table(W.stream_candidates(s), folder))):
        plays = streamed(spark, tmp_path / name, rows, REVIEWS, files).withColumnRenamed("lemma_id", "track_key")
        columns = ["window_start", "window_end", "user_id", "track_key", "plays"]
        found.append(sorted(map(tuple, run(plays, shared_folder(spark, "test")).select(*columns).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) > 100


def test_streams_without_rows_have_no_rows(spark, tmp_path):
    spark.createDataFrame([], REVIEWS).write.parquet(str(tmp_path / "none"))
    empty = spark.readStream.schema(REVIEWS).parquet(str(tmp_path / "none"))
    assert W.run_cards(empty, shared_folder(spark, "test")).count() == 0
    assert W.run_candidates(empty.withColumnRenamed("lemma_id", "track_key"), shared_folder(spark, "test")).count() == 0
