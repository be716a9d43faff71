"""Numbering rows inside groups that may be far too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectura.session import stored


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df``, stored, with ``_range``: the number of its range in the order of ``group`` and ``order``, and ``_at``: its
    place in that range, counted from some number on.

    Bounds come from a sample of the rows themselves, so ranges are about equally large whatever the values share, and
    a group larger than a range has several. They are stored, as another sample might draw other bounds.
    """
    return placed(df.repartitionByRange(*group, *order), group, order)


def placed(ranged: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``_range`` and ``_at`` of rows that are dealt out by range already."""
    return stored(
        ranged.sortWithinPartitions(*group, *order)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranges"
    )


def ordered_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group, ascending by ``order``.

    ``order`` must be a total order within a group. A plain window would put a whole group into one task. Here rows
    are numbered inside ranges of bounded size and shifted by the counts of the group's ranges before them.
    """
    return rank_of_place(in_ranges(df, group, order), group, name)


def rank_of_place(ranged: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """``name`` in place of ``_range`` and ``_at``. The shifts, a row per group and range, are stored, so that Spark
    knows how few they are and the rows themselves are not shuffled again."""
    place = [*group, "_range"]
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        *place, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return ranged.join(stored(shifts, "shifts"), place).withColumn(
        name, (F.col("_at") + F.col("_shift")).cast("long")
    ).drop("_range", "_at", "_shift")
