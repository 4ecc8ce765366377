"""Join of a table in which one key has most rows with a table of one row a key."""

import pytest
from pyspark.sql import functions as F

from moodloom.operators.grouping import hot_join


@pytest.fixture
def plain(spark):
    """Shuffled joins that keep their partitions, as for tables too large to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "-1")
    spark.conf.set(keys[1], "false")
    yield
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def tables(spark, n):
    """Nine of ten rows have key 1; key 7 has no row on the other side, some keys are null."""
    key = F.when(F.col("id") % 10 > 0, 1).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 8)
    large = spark.range(n).select(F.col("id").alias("row"), key.alias("key"))
    one = spark.range(7).select(F.col("id").cast("int").alias("key"), (F.col("id") * 10).alias("value"))
    return large.withColumn("key", F.col("key").cast("int")), one


@pytest.mark.parametrize("n", [0, 1, 4000])
def test_rows_equal_a_plain_join(spark, plain, n):
    large, one = tables(spark, n)
    got = hot_join(large, one, ["key"], ["row"])
    want = large.join(one, "key")
    assert set(got.columns) == set(want.columns)
    cols = ["row", "key", "value"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_no_task_holds_the_hot_key(spark, plain):
    large, one = tables(spark, 4000)
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert most(large.join(one, "key")) >= 3600
    assert most(hot_join(large, one, ["key"], ["row"], sizes)) <= 2000
