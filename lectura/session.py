"""Session defaults, and the folder for tables that cut lineage."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_utc(spark: SparkSession) -> SparkSession:
    """Weeks, calendar days and time stamps are all defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def literal_table(spark: SparkSession, rows: list[tuple[str, ...]], names: str) -> DataFrame:
    """A small table of strings whose size Spark knows, so that joins with it need no shuffle."""
    quoted = lambda row: ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in row)
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(r)})" for r in rows) + f" AS t({names})")


def local_session(cores: str = "8", app: str = "lectura", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.log.level", "ERROR")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that has fewer files than there are cores, which one core each would read.

    Tables of many files stay as they are: their files are dealt out by the scan, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


CHARACTERS_TOGETHER, ROWS_TOGETHER = 1 << 22, 1 << 20


def deal(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` dealt out by ``keys``, to ``parts`` tasks if given, which adaptive execution then leaves as they are.

    Without a number it joins parts by their compressed size, and rows made of texts grow to many times that size.
    """
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def deal_in_order(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """``deal`` by ranges of ``keys``: rows with equal keys stay together, and so do neighbours as far as they can."""
    return df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)


def parts_of_texts(texts: DataFrame, text: str = "text") -> int | None:
    """Tasks that hold about ``CHARACTERS_TOGETHER`` of a text column each; none named if there are no more than cores."""
    return _more_than_cores(texts, (texts.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0) / CHARACTERS_TOGETHER)


def parts_of_rows(table: DataFrame) -> int | None:
    """Tasks that hold about ``ROWS_TOGETHER`` rows of a stored table each; none named if there are no more than cores."""
    return _more_than_cores(table, table.count() / ROWS_TOGETHER)


def _more_than_cores(df: DataFrame, parts: float) -> int | None:
    return math.ceil(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors can reach.

    Under ``spark.checkpoint.dir``, which a cluster has to name. Only a local session without that
    setting, as in tests, falls back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lectura-{name}-{uuid.uuid4().hex}"


# Spark removes the shuffles of a write when it ends, and not whenever the driver's memory is next swept.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches of a plan need, and read it back.

    Text is tokenized once this way, however often the counts are used, and a lost executor never
    means starting over from the text. Stored tables lie on disk beside the shuffles, so they are packed tightly.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(folder)



def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package, wherever the driver was started; once per context."""
    context = spark.sparkContext
    if not getattr(context, "_lectura_shipped", False):
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-")) / "lectura"), "zip", root, "lectura")
        context.addPyFile(archive)
        context._lectura_shipped = True
    return spark
