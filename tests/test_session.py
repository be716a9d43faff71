import glob
import tempfile

from lectura.session import CLEAN_UP, stored


def shuffles(spark):
    folder = spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    return set(glob.glob(f"{folder}/**/blockmgr-*/*/shuffle_*", recursive=True))


def test_the_shuffles_of_a_stored_table_are_gone_when_it_is_written(spark):
    before = shuffles(spark)
    table = stored(spark.range(1000).selectExpr("id % 10 AS k", "id").repartition(8, "k").groupBy("k").sum("id"), "test")
    assert shuffles(spark) <= before
    assert table.count() == 10 and spark.conf.get(CLEAN_UP, "false") == "false"
    stored(spark.range(10).repartition(3), "test")
    assert table.join(table, "k").count() == 10
