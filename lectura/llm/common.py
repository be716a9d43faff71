"""What the operators share: white space, words, Arrow maps and gapless numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectura.session import ship

# White space is exactly these six characters everywhere in this subpackage.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def whole_text(docs: DataFrame) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def text_key(docs: DataFrame) -> Column:
    """A hash that stands for the text of a row; with doc_id it names the row, whatever is null or occurs twice."""
    return F.sha2(whole_text(docs), 256)


def keep_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of `docs` that `named` (doc_id, text_key) names, with all their columns; of rows repeated so, one."""
    stays = named.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    keyed = docs.withColumn("_text_key", text_key(docs))
    once = F.row_number().over(Window.partitionBy("doc_id", "_text_key").orderBy("text"))
    return (
        keyed.join(stays, keyed["doc_id"].eqNullSafe(stays["_id"]) & (F.col("_text_key") == F.col("_key")), "left_semi")
        .withColumn("_once", once).where("_once = 1").select(*docs.columns)
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def set_aside(rows: DataFrame, names: set[str]) -> tuple[DataFrame, list[Column]]:
    """`rows` with its columns of these names out of the way, and the columns that give back `rows` later on."""
    away = {c: f"_own_{c}" for c in rows.columns if c in names}
    return rows.withColumnsRenamed(away), [F.col(away.get(c, c)).alias(c) for c in rows.columns]


def map_rows(rows: DataFrame, make: Callable[..., dict], fields: str, use: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` as they are, and new columns that `make` computes from the columns `use`, batch by batch.

    `make` gets one list per column of `use` and gives a dict of new columns; a key `at` says from which row of the
    batch each new row comes, else there is one per row. Values stay in Arrow, so that large ids and nulls survive.
    """
    ship(rows.sparkSession)
    new = _fields(rows, fields)
    schema = rows.select(*keep).schema
    for field in new:
        schema = schema.add(field)
    types = [_arrow(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*(batch.column(c).to_pylist() for c in use))
            at = made.pop("at", None)
            kept = [batch.column(k) if at is None else batch.column(k).take(pa.array(at, pa.int64())) for k in keep]
            columns = [pa.array(made[f.name], t) for f, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(kept + columns, names=[*keep, *(f.name for f in new)])

    return rows.select(*dict.fromkeys([*keep, *use])).mapInArrow(run, schema)


def _fields(rows: DataFrame, fields: str):
    return rows.sparkSession.createDataFrame([], fields).schema.fields


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def numbered(rows: DataFrame, key: str, order: list[str], out: str, spread: str, parts: int) -> DataFrame:
    """Add `out`: a gapless number from 0 inside each `key` (a column without nulls), the same in every run.

    No window holds a whole key: rows are numbered inside (key, hash of `spread`), and each such part is shifted
    by the sizes of the parts before it. Give as many `parts` as a large key needs to be sorted in pieces. Rows that
    agree in `order` may swap numbers. `rows` is read twice, so hand in a stored table.
    """
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    by_part = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_part), F.lit(0))).drop("_n")
    )
    inside = cut.withColumn("_nr", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)))
    return inside.join(before, [key, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_nr") - 1).cast("long").alias(out))
