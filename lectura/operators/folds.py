"""Order-dependent replays of logs, in the JVM and of any length.

A log is numbered and cut into runs of a fixed length. Run 0 of all groups is folded at once, then run n on top of the
state that run n-1 left, which is stored between the rounds. Nearly all groups end with run 0; only a longer one needs
more rounds, and no array ever holds more than one run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectura.session import stored

RUN_LENGTH = 20_000


def in_runs(log: DataFrame, keys: Sequence[str], fields: Sequence[str], run_length: int = RUN_LENGTH) -> DataFrame:
    """(…keys, run, last, items): the log in runs, ordered by ``fields``; ``last`` is the group's last run."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*fields)) - 1
    runs = log.withColumn("run", F.floor(place / run_length).cast("int")).groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("items")
    )
    return stored(runs.withColumn("last", F.max("run").over(Window.partitionBy(*keys))), "runs")


def fold_runs(
    runs: DataFrame, begun: DataFrame, keys: Sequence[str], carry: Sequence[str],
    start: Column, resume: Callable[[Column], Column], fold: Callable[[Column, Column], Column],
) -> list[DataFrame]:
    """One DataFrame per round: (…keys, …carry, run, last, end).

    ``begun`` holds run 0 of every group and the columns that ``start`` needs; ``resume`` makes the state that
    a run starts from out of the state before it; ``fold(state, items)`` is one run.
    """
    names = [*keys, *carry, "run", "last"]
    rounds = [begun.withColumn("end", fold(start, F.col("items"))).select(*names, "end")]
    top = runs.agg(F.max("run")).first()[0] or 0
    for k in range(1, top + 1):
        rounds[-1] = stored(rounds[-1], "fold")
        before = rounds[-1].filter(F.col("last") >= k).select(
            *[F.col(c).alias(f"_{c}") for c in keys], *carry, F.col("end").alias("_before")
        )
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        now = runs.filter(F.col("run") == k).join(before, same)
        rounds.append(now.withColumn("end", fold(resume(F.col("_before")), F.col("items"))).select(*names, "end"))
    return rounds


def ended(rounds: Sequence[DataFrame]) -> DataFrame:
    """The state behind the last run of every group."""
    return union([r.filter(F.col("run") == F.col("last")) for r in rounds])


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
