"""Build-report tables: counts, shares, top lists and a repeatable sample per book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectura import constants as K


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 1)


def lemma_summary(classes: DataFrame, names: DataFrame) -> DataFrame:
    """Per book: distinct lemmas by class, names, and the total row, with shares of the total."""
    rows = classes.select("book_id", "class").union(
        names.select("book_id", F.lit("SKIPPED_PROPN").alias("class"))
    )
    counts = rows.rollup("book_id", "class").agg(F.count(F.lit(1)).alias("n")).filter("book_id is not null")
    totals = counts.filter(F.col("class").isNull()).select("book_id", F.col("n").alias("total"))
    return counts.join(totals, "book_id").select(
        "book_id", F.coalesce("class", F.lit("TOTAL")).alias("class"), "n",
        percent(F.col("n"), F.col("total")).alias("pct"),
    )


def reason_counts(classes: DataFrame) -> DataFrame:
    """Taught lemmas by first matching rule, zero rows kept."""
    reasons = F.array(*[F.lit(r) for r in K.TEACH_REASONS])
    return classes.groupBy("book_id").agg(
        *[F.count_if(F.col("reason") == r).alias(r) for r in K.TEACH_REASONS]
    ).select(
        "book_id",
        F.posexplode(F.arrays_zip(reasons.alias("reason"), F.array(*K.TEACH_REASONS).alias("n"))).alias("ord", "_r"),
    ).select("book_id", "ord", F.col("_r")["reason"].alias("reason"), F.col("_r")["n"].alias("n"))


def taught(classes: DataFrame) -> DataFrame:
    return classes.filter(F.col("class") == "TEACH")


def top_teach(classes: DataFrame, k: int = K.TOP_TEACH) -> DataFrame:
    order = Window.partitionBy("book_id").orderBy(F.desc("book_count"), "key")
    return (
        taught(classes).withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("book_id", "position", "key", "lemma", "pos", "book_count", "zipf", "first_chapter")
    )


def gloss_completeness(classes: DataFrame) -> DataFrame:
    return taught(classes).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("taught"),
        F.count("de").alias("with_de"),
        F.count("en").alias("with_en"),
        (F.count("de") / F.count(F.lit(1)) >= K.GLOSS_TARGET).alias("target_met"),
    )


def gloss_sources(classes: DataFrame) -> DataFrame:
    """Taught lemmas by language and gloss source, ``none`` where there is no gloss."""
    sides = F.array(
        F.struct(F.lit("de").alias("language"), F.col("de_source").alias("source")),
        F.struct(F.lit("en").alias("language"), F.col("en_source").alias("source")),
    )
    return (
        taught(classes).select("book_id", F.explode(sides).alias("_s"))
        .groupBy("book_id", F.col("_s.language").alias("language"),
                 F.coalesce(F.col("_s.source"), F.lit("none")).alias("source"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def region_flag_sources(classes: DataFrame) -> DataFrame:
    flagged = F.col("mexicanism")
    model = F.coalesce(F.col("de_source") == "model", F.lit(False))
    return taught(classes).groupBy("book_id").agg(
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & ~model).alias("from_dictionary"),
        F.count_if(flagged & model).alias("from_model"),
    )


def stratified_sample(
    classes: DataFrame, size: int = K.GLOSS_SAMPLE, seed: int = K.SAMPLE_SEED
) -> DataFrame:
    """Per book: a third most used, a third regional, the rest drawn; the same on every run.

    Draws rank by a hash of seed and key. Every word stands in up to three lists of its book, which one window cuts,
    and Spark before its shuffle; so the classes are read once and no book is gathered whole. The first drawn words
    of a book hold enough that the other two lists have not taken.
    """
    third = size // 3
    columns = ["book_id", "key", "lemma", "pos", "book_count", "mexicanism"]
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key")))
    place = lambda name, count, drawn: F.struct(F.lit(name).alias("list"), count.cast("long").alias("count"), drawn.alias("drawn"))
    lists = F.array(
        place("drawn", F.lit(0), F.col("_draw")), place("top", -F.col("book_count"), F.lit("")),
        F.when(F.col("mexicanism"), place("regional", F.lit(0), F.col("_draw"))))
    order = Window.partitionBy("book_id", "_at.list").orderBy("_at.count", "_at.drawn", "key")
    first = (
        taught(classes).withColumn("_draw", draw).select(*columns, "_draw", F.explode(F.array_compact(lists)).alias("_at"))
        .withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= size + 2 * third)
        .filter((F.col("_at.list") == "drawn") | (F.col("_rn") <= third))
    )
    words = first.groupBy(*columns, "_draw").agg(F.count_if(F.col("_at.list") != "drawn").alias("_chosen"))
    book = Window.partitionBy("book_id")
    return (
        words.withColumn("_taken", F.sum("_chosen").over(book))
        .withColumn("_rn", F.row_number().over(book.orderBy(F.col("_chosen") > 0, "_draw", "key")))
        .filter((F.col("_chosen") > 0) | (F.col("_rn") <= size - F.col("_taken"))).select(*columns)
    )


def zipf_zero(lexicon: DataFrame, sample: int = K.ZIPF_SAMPLE) -> DataFrame:
    """Lemmas no frequency list knows: how many, and the first few alphabetically."""
    noise = lexicon.filter(F.col("zipf") == 0.0)
    counts = lexicon.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("lexicon_size"), F.count_if(F.col("zipf") == 0.0).alias("n")
    )
    order = Window.partitionBy("book_id").orderBy("lemma", "pos")
    first = (
        noise.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)
        .groupBy("book_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "lemma"))), lambda x: x["lemma"]), ", ").alias("sample"))
    )
    return counts.join(first, "book_id", "left").withColumn("sample", F.coalesce("sample", F.lit("")))


def gloss_run_stats(log: DataFrame) -> DataFrame:
    """``log(book_id, lemma, outcome)``: one row per lemma a glossing run looked at."""
    outcome = F.col("outcome")
    return log.groupBy("book_id").agg(
        F.count_if(outcome == "cache").alias("from_cache"),
        F.count_if(outcome.isin("answered", "rejected", "unanswered")).alias("sent"),
        F.count_if(outcome == "rejected").alias("rejected"),
        F.count_if(outcome == "unanswered").alias("unanswered"),
        F.count_if(outcome == "cut").alias("cut_by_limit"),
    )


def threshold_sweep(
    lexicon: DataFrame, grid: Sequence[tuple[int, float]],
    regional_min: int = K.REGIONAL_MIN_BOOK_COUNT, excluded: Sequence[str] = K.CLOSED_CLASS_POS,
) -> DataFrame:
    """How many lemmas each (min_book_count, zipf_threshold) setting would teach."""
    settings = F.array(*[
        F.struct(F.lit(b).alias("min_book_count"), F.lit(float(z)).alias("zipf_threshold")) for b, z in grid
    ])
    open_class = ~F.col("pos").isin("PROPN", *excluded)
    ok = (
        (F.col("book_count") >= F.col("_g.min_book_count"))
        | (F.col("zipf") >= F.col("_g.zipf_threshold"))
        | (F.col("mexicanism") & (F.col("book_count") >= regional_min))
    )
    return (
        lexicon.select("book_id", "pos", "book_count", "zipf", "mexicanism", F.explode(settings).alias("_g"))
        .groupBy("book_id", F.col("_g.min_book_count").alias("min_book_count"),
                 F.col("_g.zipf_threshold").alias("zipf_threshold"))
        .agg(F.count_if(open_class & ok).alias("taught"))
    )
