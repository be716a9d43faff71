"""Positions, bookmarks, error and import logs, and a diagnostics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectura import constants as K


def ring_buffer(log: DataFrame, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``cap`` rows by id, newest first; per group where ``by`` is given."""
    if not by:
        return log.orderBy(F.desc("id")).limit(cap)
    order = Window.partitionBy(*by).orderBy(F.desc("id"))
    return log.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= cap).drop("_rn")


def last_import(import_log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest import (of each group)."""
    fields = [c for c in import_log.columns if c not in by]
    newest = import_log.groupBy(*by).agg(F.max_by(F.struct(*fields), "id").alias("_e"))
    return newest.filter(F.col("_e").isNotNull()).select(*by, "_e.*")


def reading_fraction(index: Column, count: Column) -> Column:
    clamped = F.least(F.greatest(index, F.lit(0)), count - 1)
    return F.when(count <= 1, F.lit(1.0)).otherwise(F.round(clamped / (count - 1), 6))


def latest_positions(log: DataFrame) -> DataFrame:
    """Newest position per (reader, book, chapter)."""
    fields = F.struct("paragraph_id", "fraction", "updated_at")
    return log.groupBy("user_id", "book_id", "chapter_index").agg(
        F.max_by(fields, F.struct("updated_at", "id") if "id" in log.columns else F.col("updated_at")).alias("_p")
    ).select("user_id", "book_id", "chapter_index", "_p.*")


def resume_chapter(positions: DataFrame) -> DataFrame:
    """Most recently read chapter per (reader, book); the earlier chapter wins a tie."""
    return positions.groupBy("user_id", "book_id").agg(
        F.max_by("chapter_index", F.struct("updated_at", -F.col("chapter_index"))).alias("resume_index")
    )


def library(books: DataFrame) -> DataFrame:
    return books.orderBy(F.desc("imported_at"), "book_id")


def bookmark_list(bookmarks: DataFrame, books: DataFrame) -> DataFrame:
    """Bookmarks newest first; a deleted book leaves its id as the title."""
    titles = books.select("book_id", F.col("title").alias("_title"))
    return bookmarks.join(titles, "book_id", "left").select(
        "id", "user_id", "book_id", F.coalesce("_title", "book_id").alias("book_title"),
        "chapter_index", "text", "created_at",
    ).orderBy(F.desc("id"))


def lexicon_sizes(books: DataFrame, lexicon: DataFrame) -> DataFrame:
    sizes = lexicon.groupBy("book_id").agg(F.count(F.lit(1)).alias("_n"))
    return books.join(sizes, "book_id", "left").select(
        "book_id", "title", F.coalesce("_n", F.lit(0)).alias("lexicon_entries")
    )


def open_sessions(sessions: DataFrame, books: DataFrame) -> DataFrame:
    titles = books.select("book_id", F.col("title").alias("book_title"))
    return sessions.filter(F.col("phase") != "complete").join(titles, "book_id", "left").select(
        "user_id", "book_id", "book_title", "chapter_index", "phase", "total",
        F.size("passed").alias("passed"), F.size("queue").alias("remaining"), "updated_at",
    )


def schema_check(
    spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, StructType]
) -> DataFrame:
    """One row per expected column: present, and of the expected type."""
    rows = []
    for table, want in expected.items():
        have = {f.name: f.dataType.simpleString() for f in tables[table].schema} if table in tables else {}
        for field in want:
            found = have.get(field.name)
            rows.append((table, field.name, field.dataType.simpleString(), found,
                         found == field.dataType.simpleString()))
    return spark.createDataFrame(rows, "table string, column string, expected string, live string, matches boolean")


def import_failures(import_log: DataFrame) -> DataFrame:
    """Failures by file shape and error, with a total row per shape and overall."""
    return (
        import_log.filter(F.col("result") == "failure")
        .rollup("file_shape", "error_name")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
        .select(
            F.when(F.col("level") == 3, "ALL").otherwise(F.col("file_shape")).alias("file_shape"),
            F.when(F.col("level") >= 1, "ALL").otherwise(F.col("error_name")).alias("error_name"), "n",
        )
    )


def diagnostics(
    provenance: DataFrame, states: DataFrame, due: DataFrame, sessions: DataFrame,
    errors: DataFrame, imports: DataFrame, sizes: DataFrame,
) -> DataFrame:
    """One long table (user_id, section, name, value) of everything a diagnostics page shows.

    ``errors`` and ``imports`` carry ``user_id``; the newest rows of each are counted up to the
    log caps, and the newest import is named.
    """
    def long(df: DataFrame, section: str, names: Sequence[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
        return df.select("user_id", F.lit(section).alias("section"), F.explode(pairs).alias("_p")).select(
            "user_id", "section", "_p.name", "_p.value"
        )

    def counted(df: DataFrame, section: str, cap: int) -> DataFrame:
        return df.groupBy("user_id").agg(
            F.least(F.count(F.lit(1)), F.lit(cap)).cast("string").alias("value")
        ).select("user_id", F.lit(section).alias("section"), F.lit("rows").alias("name"), "value")

    latest = imports.groupBy("user_id").agg(F.max_by("result", "id").alias("value"))
    parts = [
        long(provenance, "known", ["seed", "manual", "legacy", "matured_only", "total"]),
        states.select("user_id", F.lit("cards").alias("section"), F.col("state").alias("name"), F.col("n").cast("string").alias("value")),
        long(due.withColumn("next_due", F.date_format("next_due", "yyyy-MM-dd HH:mm:ss")), "cards", ["next_due"]),
        sessions.groupBy("user_id").agg(F.count(F.lit(1)).cast("string").alias("value"))
        .select("user_id", F.lit("sessions").alias("section"), F.lit("open").alias("name"), "value"),
        counted(errors, "errors", K.ERROR_LOG_CAP),
        counted(imports, "imports", K.IMPORT_LOG_CAP),
        latest.select("user_id", F.lit("imports").alias("section"), F.lit("last_result").alias("name"), "value"),
        sizes.select(F.lit(None).cast(provenance.schema["user_id"].dataType).alias("user_id"),
                     F.lit("lexicon").alias("section"), F.col("book_id").alias("name"),
                     F.col("lexicon_entries").cast("string").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
