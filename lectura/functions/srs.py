"""Spaced-repetition arithmetic: one answer applied to one card.

The published FSRS-6 rules at retention 0.90 with fuzz off. Elapsed days are differences of UTC
calendar dates; stability and difficulty carry eight decimals. Time is epoch microseconds inside
a fold. The same rules exist twice: as column expressions for batch folds in the JVM, and as a
small Python step for stateful streams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions.text import let

DAY_US = 86_400_000_000
MINUTE_US = 60_000_000
W = K.FSRS_WEIGHTS
DECAY = -W[20]
FACTOR = math.floor(((0.9 ** (1 / DECAY)) - 1) * 1e8 + 0.5) / 1e8
FORGET_DIVISOR = math.exp(W[17] * W[18])

STATE_TYPE = (
    "struct<due:bigint,stability:double,difficulty:double,elapsed_days:int,scheduled_days:int,"
    "learning_steps:int,reps:int,lapses:int,state:int,last_review:bigint>"
)
FSRS_TYPE = (
    "struct<due:timestamp_ntz,stability:double,difficulty:double,elapsed_days:int,"
    "scheduled_days:int,learning_steps:int,reps:int,lapses:int,state:int,last_review:timestamp_ntz>"
)
FIELDS = (
    "due", "stability", "difficulty", "elapsed_days", "scheduled_days", "learning_steps", "reps",
    "lapses", "state", "last_review",
)


def initial_difficulty(grade: int) -> float:
    return math.floor(min(max(W[4] - math.exp(W[5] * (grade - 1)) + 1, 1.0), 10.0) * 1e8 + 0.5) / 1e8


INITIAL_DIFFICULTY = tuple(initial_difficulty(g) for g in (1, 2, 3, 4))


def grade_number(grade: Column) -> Column:
    """again, hard, good, easy → 1..4; anything else is null."""
    numbers = F.create_map(*[F.lit(v) for i, g in enumerate(K.GRADES, 1) for v in (g, i)])
    return F.try_element_at(numbers, grade)


def is_passing(grade: Column) -> Column:
    return grade.isin("good", "easy")


def is_known(fsrs: Column, min_days: float = K.KNOWN_MIN_STABILITY_DAYS) -> Column:
    """Matured: in review, stability strictly above the threshold."""
    return (fsrs["state"] == 2) & (fsrs["stability"] > min_days)


def state_label(state: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in K.CARD_STATES]), state + 1)


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def new_state(now_us: Column) -> Column:
    """An empty card, due now."""
    zero = F.lit(0)
    return F.struct(
        now_us.alias("due"), F.lit(0.0).alias("stability"), F.lit(0.0).alias("difficulty"),
        zero.alias("elapsed_days"), zero.alias("scheduled_days"), zero.alias("learning_steps"),
        zero.alias("reps"), zero.alias("lapses"), zero.alias("state"),
        F.lit(None).cast("bigint").alias("last_review"),
    ).cast(STATE_TYPE)


def to_fsrs(state: Column) -> Column:
    """Fold state to the stored card struct."""
    times = {"due", "last_review"}
    return F.struct(
        *[(from_micros(state[f]) if f in times else state[f]).alias(f) for f in FIELDS]
    )


def from_fsrs(fsrs: Column) -> Column:
    times = {"due", "last_review"}
    built = F.struct(*[(to_micros(fsrs[f]) if f in times else fsrs[f]).alias(f) for f in FIELDS])
    return F.when(fsrs.isNotNull(), built.cast(STATE_TYPE))


def _round8(value: Column) -> Column:
    return F.floor(value * 1e8 + 0.5).cast("double") / 1e8


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _stability_after(card: Column, days: Column, recall: Column, grade: int) -> Column:
    s, d = card["stability"], card["difficulty"]
    growth = F.pow(s, F.lit(-W[19])) * math.exp(W[17] * (grade - 3 + W[18]))
    same_day = s * (F.greatest(growth, F.lit(1.0)) if grade >= 3 else growth)
    if grade == 1:
        lapse = (
            W[11] * F.pow(d, F.lit(-W[12])) * (F.pow(s + 1, F.lit(W[13])) - 1)
            * F.exp(W[14] * (1 - recall))
        )
        later = F.least(_round8(s / FORGET_DIVISOR), lapse)
    else:
        bonus = {2: W[15], 3: 1.0, 4: W[16]}[grade]
        later = s * (
            1 + math.exp(W[8]) * (11 - d) * F.pow(s, F.lit(-W[9]))
            * (F.exp(W[10] * (1 - recall)) - 1) * bonus
        )
    return _round8(_clamp(F.when(days == 0, same_day).otherwise(later), K.MIN_STABILITY, K.MAX_INTERVAL_DAYS))


def _interval(stability: Column) -> Column:
    return _clamp(F.floor(stability + 0.5), 1, K.MAX_INTERVAL_DAYS).cast("int")


def answer(card: Column, grade: Column, now_us: Column) -> Column:
    """State after one answer; ``grade`` is 1..4."""
    fresh = card["state"] == 0
    days = F.when(fresh, F.lit(0)).otherwise(
        (F.floor(now_us / DAY_US) - F.floor(card["last_review"] / DAY_US)).cast("int")
    )
    recall = F.when(fresh, F.lit(1.0)).otherwise(F.pow(1 + FACTOR * days / card["stability"], F.lit(DECAY)))

    def with_recall(m: Column) -> Column:
        started = F.array(*[F.lit(w) for w in W[:4]])
        continued = F.array(*[_stability_after(card, m["days"], m["recall"], g) for g in (1, 2, 3, 4)])
        delta = -W[6] * (grade - 3)
        drifted = card["difficulty"] + delta * (10 - card["difficulty"]) / 9
        reverted = W[7] * INITIAL_DIFFICULTY[3] + (1 - W[7]) * drifted
        memory = F.struct(
            m["days"].alias("days"),
            F.when(fresh, started).otherwise(continued).alias("s"),
            F.when(fresh, F.element_at(F.array(*[F.lit(d) for d in INITIAL_DIFFICULTY]), grade))
            .otherwise(_round8(_clamp(reverted, 1.0, 10.0))).alias("difficulty"),
        )
        return let(memory, scheduled)

    def scheduled(m: Column) -> Column:
        learning, review = card["state"].isin(0, 1), card["state"] == 2
        step = card["learning_steps"]
        short, long_ = K.LEARNING_STEPS_MIN
        relearn = K.RELEARNING_STEPS_MIN[0]
        minutes = (
            F.when(learning & (grade == 1), short)
            .when(learning & (grade == 2), math.floor((short + long_) / 2 + 0.5))
            .when(learning & (grade == 3) & (step == 0), long_)
            .when(review & (grade == 1), relearn)
            .when((card["state"] == 3) & (grade == 1), relearn)
            .when((card["state"] == 3) & (grade == 2), math.floor(relearn * 1.5 + 0.5))
            .otherwise(0)
        )
        i2, i3, i4 = (_interval(m["s"][g]) for g in (1, 2, 3))
        hard = F.least(i2, i3)
        good = F.greatest(i3, hard + 1)
        easy = F.greatest(i4, good + 1)
        kept = F.when(grade == 2, hard).when(grade == 3, good).otherwise(easy)
        interval = F.when(review, kept).otherwise(_interval(F.element_at(m["s"], grade)))
        plan = F.struct(minutes.alias("minutes"), interval.alias("interval"))
        return let(plan, lambda p: finished(m, p))

    def finished(m: Column, p: Column) -> Column:
        stepping = p["minutes"] > 0
        step = card["learning_steps"]
        return F.struct(
            (now_us + F.when(stepping, p["minutes"].cast("bigint") * MINUTE_US)
             .otherwise(p["interval"].cast("bigint") * DAY_US)).alias("due"),
            F.element_at(m["s"], grade).alias("stability"),
            m["difficulty"].alias("difficulty"),
            m["days"].alias("elapsed_days"),
            F.when(stepping, F.lit(0)).otherwise(p["interval"]).alias("scheduled_days"),
            F.when(stepping & (grade == 2), step)
            .when(stepping & (grade == 3), step + 1).otherwise(F.lit(0)).alias("learning_steps"),
            (card["reps"] + 1).alias("reps"),
            (card["lapses"] + F.when((card["state"] == 2) & (grade == 1), 1).otherwise(0)).alias("lapses"),
            F.when(~stepping, F.lit(2)).when(card["state"].isin(0, 1), F.lit(1)).otherwise(F.lit(3))
            .alias("state"),
            now_us.alias("last_review"),
        ).cast(STATE_TYPE)

    return let(F.struct(days.alias("days"), recall.alias("recall")), with_recall)


def _r8(x: float) -> float:
    return math.floor(x * 1e8 + 0.5) / 1e8


def empty_card(now_us: int) -> tuple:
    return (now_us, 0.0, 0.0, 0, 0, 0, 0, 0, 0, None)


def answer_py(card: tuple, grade: int, now_us: int) -> tuple:
    """The same step on one Python tuple, in the field order of ``FIELDS``."""
    _, s, d, _, _, step, reps, lapses, state, last = card
    days = 0 if state == 0 else now_us // DAY_US - last // DAY_US
    if state == 0:
        stab, diff = list(W[:4]), INITIAL_DIFFICULTY[grade - 1]
    else:
        recall = (1 + FACTOR * days / s) ** DECAY
        stab = []
        for g in (1, 2, 3, 4):
            if days == 0:
                growth = s ** -W[19] * math.exp(W[17] * (g - 3 + W[18]))
                after = s * (max(growth, 1.0) if g >= 3 else growth)
            elif g == 1:
                lapse = W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(W[14] * (1 - recall))
                after = min(_r8(s / FORGET_DIVISOR), lapse)
            else:
                bonus = {2: W[15], 3: 1.0, 4: W[16]}[g]
                after = s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9]
                             * (math.exp(W[10] * (1 - recall)) - 1) * bonus)
            stab.append(_r8(min(max(after, K.MIN_STABILITY), K.MAX_INTERVAL_DAYS)))
        drifted = d + -W[6] * (grade - 3) * (10 - d) / 9
        diff = _r8(min(max(W[7] * INITIAL_DIFFICULTY[3] + (1 - W[7]) * drifted, 1.0), 10.0))
    short, long_ = K.LEARNING_STEPS_MIN
    relearn = K.RELEARNING_STEPS_MIN[0]
    if state in (0, 1):
        minutes = {1: short, 2: math.floor((short + long_) / 2 + 0.5), 3: 0 if step else long_, 4: 0}[grade]
    elif state == 2:
        minutes = relearn if grade == 1 else 0
    else:
        minutes = {1: relearn, 2: math.floor(relearn * 1.5 + 0.5)}.get(grade, 0)

    def days_for(x: float) -> int:
        return min(max(math.floor(x + 0.5), 1), K.MAX_INTERVAL_DAYS)

    interval = days_for(stab[grade - 1])
    if state == 2 and grade > 1:
        hard = min(days_for(stab[1]), days_for(stab[2]))
        good = max(days_for(stab[2]), hard + 1)
        easy = max(days_for(stab[3]), good + 1)
        interval = {2: hard, 3: good, 4: easy}[grade]
    stepping = minutes > 0
    return (
        now_us + (minutes * MINUTE_US if stepping else interval * DAY_US),
        stab[grade - 1], diff, days, 0 if stepping else interval,
        {2: step, 3: step + 1}.get(grade, 0) if stepping else 0,
        reps + 1, lapses + (1 if state == 2 and grade == 1 else 0),
        2 if not stepping else (1 if state in (0, 1) else 3), now_us,
    )
