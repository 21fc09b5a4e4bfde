import pytest
from pyspark.sql import functions as F

from marginalia import session


def hinted(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("rows,each,want", [(10, 1, True), (200, 1, False), (50, 5_000, False)])
def test_broadcast_needs_few_rows_and_few_bytes(spark, rows, each, want):
    df = spark.range(rows).select("id", F.repeat(F.lit("x"), each).alias("t"), F.array(F.col("id")).alias("a"), F.struct("id").alias("s"))
    assert hinted(session.broadcast_if_small(df, 100, 100_000)) is want


def test_columns_that_are_null(spark):
    df = spark.range(3).select(F.lit(None).cast("string").alias("t"), F.lit(None).cast("array<int>").alias("a"), F.lit(None).cast("map<string,int>").alias("m"))
    assert hinted(session.broadcast_if_small(df))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
