"""Study sessions and review sittings replayed from their answer logs.

Both are a queue consumed from the front. A session introduces its cards first: ``weiter`` sends
the card to the back as introduced, ``ichKenneDas`` removes it. In recall a passing grade removes
the card and a failing one sends it to the back. Actions of the wrong phase change nothing. A
sitting is a session whose cards are all introduced already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectura.functions import srs
from lectura.operators.folds import RUN_LENGTH, ended, fold_runs, in_runs, union

SESSION = ("user_id", "book_id", "chapter_index")
_CARD = "struct<key:string,lemma_id:string,introduced:boolean>"
_EFFECT = "struct<seq:bigint,us:bigint,kind:string,lemma_id:string,grade:string>"
_STATE = (
    f"struct<queue:array<{_CARD}>,passed:array<string>,dismissed:array<string>,"
    f"effects:array<{_EFFECT}>,updated:bigint>"
)


def start_sessions(cards: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Queues in the given order from ``cards(…keys, ord, key, lemma_id)``, nothing introduced."""
    card = F.struct("ord", "key", "lemma_id", F.lit(False).alias("introduced"))
    return _queues(cards, keys, card)


def start_sittings(due: DataFrame) -> DataFrame:
    """Review queues per reader from ``due(user_id, ord, lemma_id)``."""
    card = F.struct("ord", F.col("lemma_id").alias("key"), "lemma_id", F.lit(True).alias("introduced"))
    return _queues(due, ("user_id",), card)


def _queues(cards: DataFrame, keys: Sequence[str], card: Column) -> DataFrame:
    present = F.when(F.col("lemma_id").isNotNull(), card)
    queue = F.transform(
        F.array_sort(F.collect_list(present)),
        lambda c: F.struct(c["key"].alias("key"), c["lemma_id"].alias("lemma_id"), c["introduced"].alias("introduced")),
    )
    return cards.groupBy(*keys).agg(queue.cast(f"array<{_CARD}>").alias("queue")).select(
        *keys, "queue", F.size("queue").alias("total"), phase(F.col("queue")).alias("phase")
    )


def phase(queue: Column) -> Column:
    return (
        F.when(F.size(queue) == 0, "complete")
        .when(F.get(queue, F.lit(0))["introduced"], "recall")
        .otherwise("introduction")
    )


def _act(s: Column, a: Column) -> Column:
    """One logged action applied to the fold state."""
    front, rest = F.get(s["queue"], F.lit(0)), F.slice(s["queue"], 2, F.greatest(F.size(s["queue"]), F.lit(1)))
    now = phase(s["queue"])
    introduced = F.struct(
        front["key"].alias("key"), front["lemma_id"].alias("lemma_id"), F.lit(True).alias("introduced")
    )
    graded = (now == "recall") & a["action"].isin("again", "hard", "good", "easy")
    passing = graded & srs.is_passing(a["action"])
    dismissing = (now == "introduction") & (a["action"] == "ichKenneDas")
    seen = (now == "introduction") & (a["action"] == "weiter")
    effect = F.struct(
        a["seq"].alias("seq"), a["us"].alias("us"),
        F.when(dismissing, "markKnown").otherwise("saveCard").alias("kind"),
        front["lemma_id"].alias("lemma_id"), F.when(graded, a["action"]).alias("grade"),
    ).cast(_EFFECT)
    return F.struct(
        F.when(passing | dismissing, rest)
        .when(seen, F.array_append(rest, introduced))
        .when(graded, F.array_append(rest, front))
        .otherwise(s["queue"]).alias("queue"),
        F.when(passing, F.array_append(s["passed"], front["key"])).otherwise(s["passed"]).alias("passed"),
        F.when(dismissing, F.array_append(s["dismissed"], front["key"])).otherwise(s["dismissed"]).alias("dismissed"),
        F.when(graded | dismissing, F.array_append(s["effects"], effect)).otherwise(s["effects"]).alias("effects"),
        F.when(graded | dismissing | seen, a["us"]).otherwise(s["updated"]).alias("updated"),
    ).cast(_STATE)


def replay_sessions(
    sessions: DataFrame, log: DataFrame, keys: Sequence[str] = SESSION, run_length: int = RUN_LENGTH
) -> tuple[DataFrame, DataFrame]:
    """(sessions after their log, effects in order).

    ``log(…keys, seq, ts, action)`` applies in ``seq`` order. An effect is ``markKnown`` or
    ``saveCard`` with the word, the grade and the time.
    """
    keys = list(keys)
    actions = log.select(
        *keys, F.col("seq").cast("long").alias("seq"), srs.to_micros(F.col("ts")).alias("us"), "action"
    )
    runs = in_runs(actions, keys, ["seq", "us", "action"], run_length)
    first = runs.filter(F.col("run") == 0).select(*[F.col(k).alias(f"_{k}") for k in keys], "items", "run", "last")
    none = F.array().cast("array<struct<seq:bigint,us:bigint,action:string>>")
    begun = sessions.join(first, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").select(
        *keys, "queue", "total", F.coalesce("items", none).alias("items"),
        F.coalesce("run", F.lit(0)).alias("run"), F.coalesce("last", F.lit(0)).alias("last"),
    )
    start = F.struct(
        F.col("queue"), F.array().cast("array<string>").alias("passed"),
        F.array().cast("array<string>").alias("dismissed"),
        F.array().cast(f"array<{_EFFECT}>").alias("effects"), F.lit(None).cast("bigint").alias("updated"),
    ).cast(_STATE)
    rounds = fold_runs(
        runs, begun, keys, ["total"], start,
        lambda s: s.withField("effects", F.array().cast(f"array<{_EFFECT}>")),
        lambda s, taken: F.aggregate(taken, s, _act),
    )
    done = ended(rounds).select(
        *keys, "total", phase(F.col("end.queue")).alias("phase"), "end.queue", "end.passed",
        "end.dismissed", srs.from_micros(F.col("end.updated")).alias("updated_at"),
    )
    effects = union([r.select(*keys, F.explode("end.effects").alias("_e")) for r in rounds]).select(
        *keys, "_e.seq", srs.from_micros(F.col("_e.us")).alias("ts"), "_e.kind", "_e.lemma_id", "_e.grade"
    )
    return done, effects


def replay_sittings(sittings: DataFrame, log: DataFrame, run_length: int = RUN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Review sittings per reader; ``log(user_id, seq, ts, grade)``."""
    return replay_sessions(
        sittings, log.withColumnRenamed("grade", "action"), ("user_id",), run_length
    )


def effect_reviews(effects: DataFrame) -> DataFrame:
    """The ``saveCard`` effects as a review log for ``replay_reviews``."""
    return effects.filter(F.col("kind") == "saveCard").select("user_id", "lemma_id", "ts", "seq", "grade")


def effect_known(effects: DataFrame) -> DataFrame:
    """The ``markKnown`` effects as rows of ``known_lemmas``."""
    return effects.filter(F.col("kind") == "markKnown").groupBy("user_id", "lemma_id").agg(
        F.max("ts").alias("marked_at"), F.lit("manual").alias("source")
    )


def open_only(sessions: DataFrame) -> DataFrame:
    """Stored sessions after a replay: completed ones are deleted."""
    return sessions.filter(F.col("phase") != "complete")


def session_progress(sessions: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    answered = F.size("passed") + F.size("dismissed")
    return sessions.select(
        *keys, "phase", "total", answered.alias("answered"),
        F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.round(answered / F.col("total"), 6)).alias("fraction"),
        F.size("queue").alias("remaining"), F.size("passed").alias("passed_count"),
        F.size("dismissed").alias("dismissed_count"),
        F.get("queue", F.lit(0))["key"].alias("current_key"),
    )


def session_card_view(sessions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The front card of every open session; without lexicon entry the key stands for the word."""
    front = sessions.filter(F.size("queue") > 0).select(
        *SESSION, F.get("queue", F.lit(0))["key"].alias("key")
    )
    return front.join(lexicon, ["book_id", "key"], "left").select(
        *SESSION, "key", F.coalesce("lemma", "key").alias("lemma"), F.coalesce("pos", F.lit("")).alias("pos"),
        "de", "en", "example", "region_note", F.coalesce("mexicanism", F.lit(False)).alias("mexicanism"),
    )


def track_state(tracks: DataFrame) -> DataFrame:
    """State of a song from its match, language and session facts.

    ``tracks(track_id, archived, lyrics, language_ok, session_phase, has_teach_set)``; ``lyrics``
    and ``language_ok`` are null until looked at.
    """
    state = (
        F.when(F.coalesce("archived", F.lit(False)), "archived")
        .when(F.col("lyrics").isNull(), "candidate")
        .when(~F.col("lyrics"), "no_lyrics")
        .when(F.col("language_ok") == False, "not_spanish")  # noqa: E712
        .when(F.col("session_phase") == "complete", "unlocked")
        .when(F.col("session_phase").isNotNull(), "teaching")
        .when(F.coalesce("has_teach_set", F.lit(False)), "ready")
        .otherwise("candidate")
    )
    return tracks.select("track_id", state.alias("state"))
