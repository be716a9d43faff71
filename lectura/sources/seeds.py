"""Known-word seeds, import routing and flashcard exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectura.functions.text import lemma_id
from lectura.operators.tokens import token_array

EXPORT_HEADER = ("#separator:tab", "#html:true", "#notetype:Basic")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): one row per file, whole."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def route_imports(files: DataFrame) -> DataFrame:
    """Kind of every file by its content: array → seed, object → book, else unrecognised."""
    first = F.substring(F.ltrim(F.col("content"), F.lit(" \t\r\n")), 1, 1)
    valid = F.try_parse_json("content").isNotNull()
    kind = F.when(valid & (first == "["), "known").when(valid & (first == "{"), "book").otherwise("unrecognised")
    return files.withColumn("kind", kind)


def parse_known(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lemmas, errors) from ``files(path, content)`` holding flat arrays of strings."""
    value = F.try_parse_json("content")
    parsed = files.select("path", value.alias("v"), F.schema_of_variant(value).alias("shape"))
    strings = F.try_variant_get("v", "$", "array<variant>")
    bad = F.exists(strings, lambda e: F.coalesce(F.schema_of_variant(e), F.lit("VOID")) != "STRING")
    lemmas = F.array_sort(F.array_distinct(F.filter(
        F.transform(strings, lambda e: lemma_id(F.try_variant_get(e, "$", "string"))), lambda x: x != ""
    )))
    judged = parsed.select(
        "path",
        F.when(F.col("v").isNull() | ~F.startswith("shape", F.lit("ARRAY")), "not a list of words")
        .when(bad, "an entry is not a word")
        .when(F.size(lemmas) == 0, "no words in the list").alias("error"),
        lemmas.alias("lemmas"),
    )
    ok = judged.filter(F.col("error").isNull()).select("path", F.explode("lemmas").alias("lemma_id"))
    return ok, judged.filter(F.col("error").isNotNull()).select("path", "error")


def read_known(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_known(read_files(spark, path))


def import_outcomes(
    books_in: DataFrame, seeds_in: DataFrame, failures: DataFrame, books: DataFrame, known: DataFrame
) -> DataFrame:
    """One outcome row per imported file.

    ``books_in(path, book_id, title, chapter_count)`` · ``seeds_in(path, lemma_id)`` ·
    ``failures(path, file_shape, error_name, message)`` against the stored ``books(book_id)`` and
    ``known(lemma_id)``.
    """
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    stored = books.select("book_id").distinct().withColumn("_old", F.lit(True))
    book_rows = books_in.join(stored, "book_id", "left").select(
        "path", F.lit("book").alias("file_shape"), F.lit("success").alias("result"), "book_id", "title",
        F.col("chapter_count").cast("int").alias("chapter_count"), F.coalesce("_old", F.lit(False)).alias("replaced"),
        none("in_file", "long"), none("added", "long"), none("total", "long"),
        none("error_name", "string"), none("message", "string"),
    )
    have = known.select("lemma_id").distinct().withColumn("_old", F.lit(True))
    before = have.agg(F.count(F.lit(1))).scalar()
    counts = seeds_in.join(have, "lemma_id", "left").groupBy("path").agg(
        F.count(F.lit(1)).alias("in_file"), F.count_if(F.col("_old").isNull()).alias("added")
    )
    seed_rows = counts.select(
        "path", F.lit("known").alias("file_shape"), F.lit("success").alias("result"),
        none("book_id", "string"), none("title", "string"), none("chapter_count", "int"), none("replaced", "boolean"),
        "in_file", "added", (before + F.col("added")).alias("total"),
        none("error_name", "string"), none("message", "string"),
    )
    failed = failures.select(
        "path", "file_shape", F.lit("failure").alias("result"),
        none("book_id", "string"), none("title", "string"), none("chapter_count", "int"), none("replaced", "boolean"),
        none("in_file", "long"), none("added", "long"), none("total", "long"), "error_name", "message",
    )
    return book_rows.union(seed_rows).union(failed)


def _field(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("\t"), F.lit(" ")), "\r?\n", " ")


def anki_export(cards: DataFrame, deck: str = "Spanisch") -> DataFrame:
    """(ord, line) of a flashcard import file: header, then cards in their order.

    ``cards(ord, lemma_id, face)``. Cards without face or German gloss are skipped.
    """
    face = F.col("face")
    back = F.when(
        F.coalesce(face["example"], F.lit("")) != "",
        F.concat(face["de"], F.lit("<br><i>"), face["example"], F.lit("</i>")),
    ).otherwise(face["de"])
    lines = cards.filter(F.coalesce(face["de"], F.lit("")) != "").select(
        F.col("ord").cast("long").alias("ord"), F.concat_ws("\t", _field(F.col("lemma_id")), _field(back)).alias("line")
    )
    header = [*EXPORT_HEADER, f"#deck:{deck}"]
    spark = cards.sparkSession
    top = spark.createDataFrame([(i - len(header), h) for i, h in enumerate(header)], "ord long, line string")
    return top.union(lines)


def song_card_export(senses: DataFrame, tracks: DataFrame, home: str = "es-MX", deck: str = "Spanisch") -> DataFrame:
    """(artist, line): one deck per artist, a tag per track, at most one context line.

    ``senses(track_id, lemma, gloss_de, gloss_en, variety, register, home_equivalent, context)``.
    """
    foreign = ~F.col("variety").isin("general", home)
    badge = F.when(foreign, F.concat_ws(" · ", F.substring_index("variety", "-", -1), "register"))
    equivalent = F.when(foreign & F.col("home_equivalent").isNotNull(),
                        F.concat(F.lit(home.split("-")[-1] + ": "), F.col("home_equivalent")))
    one_line = F.when(F.coalesce("context", F.lit("")) != "",
                      F.concat(F.lit("<i>"), F.element_at(F.split("context", "\r?\n"), 1), F.lit("</i>")))
    back = F.concat_ws("<br>", "gloss_de", "gloss_en", badge, equivalent, one_line)
    tag = F.concat(F.lit("song track-"), F.col("track_id").cast("string"))
    return senses.join(tracks.select("track_id", "artist"), "track_id").select(
        "artist", F.concat_ws("\t", _field(F.col("lemma")), _field(back),
                              F.concat(F.lit(f"{deck}::"), F.col("artist")), tag).alias("line")
    )


def write_song_cards(cards: DataFrame, path: str) -> None:
    cards.write.partitionBy("artist").mode("overwrite").text(path)


def notes_to_known(notes: DataFrame, forms: DataFrame, column: int) -> DataFrame:
    """Lemmas of one column of exported notes; ``notes(value)`` one line per row, ``#`` lines skipped."""
    cell = F.get(F.split("value", "\t"), F.lit(column))
    words = F.filter(token_array(cell), lambda t: F.regexp_like(t, F.lit(r"^\p{L}")))
    used = notes.filter(~F.startswith("value", F.lit("#"))).select(F.explode(words).alias("_w"))
    table = forms.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
    return (
        used.select(F.lower("_w").alias("_w")).distinct()
        .join(table, F.col("_w") == F.col("_form"), "left")
        .select(F.lower(F.coalesce("_lemma", "_w")).alias("lemma_id")).distinct()
    )
