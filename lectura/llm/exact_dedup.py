"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

Every text is cut where its own characters say so. Chunks are deduplicated once, by content; their identifiers are
128-bit hashes that have been verified to stand for one content each. From then on a document is the ordered list of
its chunk identifiers: documents are equal exactly if their lists are, and no long text moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectura.session import stored

from .common import WHITE_SPACE, whole_text

# A chunk ends behind four characters in a row whose code points are multiples of five (Latin-1, which a regular
# expression tests fastest), or at MAX_CHUNK; other scripts are cut by length.
MIN_CHUNK = 512
MAX_CHUNK = 8192
BOUNDARY = "[" + "".join(f"\\x{{{c:x}}}" for c in range(35, 256, 5)) + "]{4}"
CHUNK_PATTERN = f"(?s).{{{MIN_CHUNK - 4},{MAX_CHUNK - 4}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """The text without any of the six white space characters; two texts are equal if these are."""
    for blank in WHITE_SPACE:
        text = F.replace(text, F.lit(blank))
    return text


def chunk_id(chunk: Column, seed: int) -> Column:
    """Two 64-bit halves of a chunk's identifier."""
    return F.array(F.xxhash64(F.lit(2 * seed), chunk), F.xxhash64(F.lit(2 * seed + 1), chunk))


def verified_seed(chunks: DataFrame, seed: int = 0) -> int:
    """The first seed under which no two different chunks (column `chunk`) share an identifier.

    Each distinct content moves once. Identifiers of 128 bits practically never collide; if they do, the next seed is
    tried, so that equal lists always mean equal texts.
    """
    while True:
        shared = (
            chunks.groupBy("chunk").agg(F.lit(1).alias("one"))
            .groupBy(chunk_id(F.col("chunk"), seed).alias("id")).agg(F.count("*").alias("contents"))
            .where("contents > 1")
        )
        if shared.isEmpty():
            return seed
        seed += 1


def recipes(docs: DataFrame) -> DataFrame:
    """Per row: row_id, doc_id, n_points (code points of the original), text_sha256 (of the normalised text), recipe."""
    plain = docs.select("doc_id", F.length(whole_text(docs)).cast("long").alias("n_points"), normalised(whole_text(docs)).alias("plain"))
    cut = plain.withColumn("chunks", F.regexp_extract_all("plain", F.lit(CHUNK_PATTERN), F.lit(0)))
    seed = verified_seed(cut.select(F.explode("chunks").alias("chunk")))
    made = cut.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_points", F.sha2("plain", 256).alias("text_sha256"),
        F.flatten(F.transform("chunks", lambda c: chunk_id(c, seed))).alias("recipe"),
    )
    return stored(made, "recipes")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text), dropped ones too.

    doc_id, keep_id (doc_id of the row of its group that stays), group_size, kept, text_sha256, n_points. Texts are
    equal if they are identical without white space. The row with the most code points in its original text stays,
    then the one with the smallest doc_id (null last), then any one of rows repeated as a whole.

    Null text counts as empty, and all empty texts are one group. An empty table gives no rows. Further columns are
    ignored. The join back to the rows may meet a group of any size: it carries only numbers, and adaptive execution
    splits it.
    """
    rows = recipes(docs)
    stays = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id"))
    groups = stored(rows.groupBy("recipe").agg(F.count("*").alias("group_size"), stays.alias("keep")), "recipe-groups")
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256", "n_points",
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of wholly repeated rows, one."""
    kept = exact_groups(docs).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_points").alias("_n"))
    named = docs.withColumn("_text_sha", F.sha2(normalised(whole_text(docs)), 256)).withColumn("_points", F.length(whole_text(docs)).cast("long"))
    first = F.row_number().over(Window.partitionBy("doc_id", "_text_sha", "_points").orderBy("text"))
    return (
        named.join(kept, (named["doc_id"].eqNullSafe(kept["_id"])) & (F.col("_text_sha") == F.col("_sha")) & (F.col("_points") == F.col("_n")), "left_semi")
        .withColumn("_first", first).where("_first = 1").select(*docs.columns)
    )

