"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectura.session import stored

from .common import set_aside, whole_text, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
BUCKETS = 4096  # of the seeded order, inside a source


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """`docs` with `size` (words of the text), and its place in the seeded order of its source (_key, _bucket)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return (
        docs.withColumn("size", word_count(whole_text(docs))).withColumn("_key", key)
        .withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over (source, source_size), one row per source: adds `target`, double.

    Sources get weights in code-point order, null last. All sizes together are shared out by weight; whoever would
    get more than `max_epochs` times its size is clamped there, and the excess goes to the others by weight, until
    no one is above. Clamping goes by cap over weight, so the clamped sources are a prefix in that order, and the
    water level behind each prefix follows from two running sums. A source without words gets 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = (
        sources.withColumn("_turn", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("_turn") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * max_epochs)
    )
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_used"))
    filled = (
        weighed.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.when(F.col("weight") * level <= F.col("_cap"), level))
        .withColumn("_place", F.row_number().over(by_ratio))
        .withColumn("_dry", F.min(F.when(F.col("_level").isNotNull(), F.col("_place"))).over(everything))
        .withColumn("_final", F.max(F.when(F.col("_place") == F.col("_dry"), F.col("_level"))).over(everything))
    )
    target = F.when(F.col("_place") < F.col("_dry"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_final"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`rows` (made by `sized`) with source_size, target, taken and copies.

    taken: words the mix takes of a document. Every document of a source is taken floor(target / source_size) times;
    the words still missing come from further documents in the seeded order, of which the last is taken in part, so
    that a source's sum is its target, rounded. copies: the same in whole documents, that last one rounded.

    Only one bucket of a source's seeded order is ever sorted, the one in which it reaches its target; before and
    behind it a document's share is known from sums. Null text has size 0, null sources are a source, repeated rows
    count each. An empty table gives no rows. Columns of `rows` stay, but for those named here.
    """
    per_bucket = stored(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = (
        targets.withColumn("_whole", whole)
        .withColumn("_rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size"))
    )
    so_far = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        per_bucket.withColumn("_before", F.coalesce(F.sum("_words").over(so_far), F.lit(0)))
        .join(shares.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
        .where("_before < _rest and _rest <= _before + _words")
        .select("_s", F.col("_bucket").alias("_last"), "_before")
    )
    plan = stored(
        shares.withColumnRenamed("source", "_source").join(reached, F.col("_source").eqNullSafe(F.col("_s")), "left")
        .select("_source", "source_size", "target", "_whole", "_rest", F.coalesce("_last", F.lit(-1)).alias("_last"), "_before"),
        "mix-plan",
    )
    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    run = Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = planned.where("_bucket = _last").withColumn("_run", F.col("_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    last = last.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_run"))))
    others = planned.where("_bucket <> _last").withColumn("_run", F.lit(0).cast("long"))
    others = others.withColumn("_more", F.when(F.col("_bucket") < F.col("_last"), F.col("size")).otherwise(F.lit(0)))
    once = F.when((F.col("_bucket") < F.col("_last")) | ((F.col("_more") * 2 >= F.col("size")) & (F.col("_more") > 0)), 1).otherwise(0)
    return (
        last.unionByName(others)
        .withColumn("taken", (F.col("size") * F.col("_whole") + F.col("_more")).cast("long"))
        .withColumn("copies", F.col("_whole") + once)
        .drop("_source", "_whole", "_rest", "_last", "_before", "_run", "_more", "_key", "_bucket")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; its text is read once."""
    narrow = stored(sized(docs).select("doc_id", "source", "size", "_key", "_bucket"), "mix-sizes")
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken", "copies")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """`docs` with every row as often as the mix has whole copies of it, and no further columns."""
    rows, own = set_aside(docs, {"size", "source_size", "target", "taken", "copies"})
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mix(sized(rows)).where("copies > 0").withColumn("_copy", times).select(*own)
