import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagescout.operators import frontier as FR
from pagescout.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows of which a third belong to one key."""
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(4), f"u{i}") for i in range(3000)]
    return spark.createDataFrame(data, "domain STRING, depth INT, url STRING").repartition(8).cache()


def test_rank_in_group_equals_a_window(rows):
    ranked = skew.rank_in_group(rows, "domain", ["depth", "url"], "rank")
    window = Window.partitionBy("domain").orderBy("depth", "url")
    expected = rows.withColumn("rank", F.row_number().over(window).cast("bigint"))
    assert ranked.count() == 3000
    assert ranked.exceptAll(expected).isEmpty()


@pytest.mark.parametrize("n", [1, 7, 2000])
def test_first_n_equals_a_window(rows, n):
    order = [F.col("depth"), F.col("url")]
    got = skew.first_n_per_group(rows, ["domain"], order, n)
    window = Window.partitionBy("domain").orderBy(*order)
    expected = rows.withColumn("r", F.row_number().over(window)).where(F.col("r") <= n).drop("r")
    assert got.count() == expected.count()
    assert got.exceptAll(expected).isEmpty()


def test_frontier_cap_reports_what_it_drops(rows):
    frontier = rows.withColumnRenamed("url", "url_key")
    kept, dropped = FR.frontier_cap(frontier, 5)
    assert kept.groupBy("domain").count().agg(F.max("count")).first()[0] == 5
    assert kept.unionByName(dropped).count() == 3000


def test_salted_join_equals_a_plain_join(spark, rows):
    lookup = spark.createDataFrame([(f"k{i}", i) for i in range(30)] + [("hot", -1)], "domain STRING, v INT")
    got = skew.salted_join(rows, lookup, "domain", rows_per_task=50)
    expected = rows.join(lookup, "domain", "left")
    assert got.count() == 3000
    assert got.select(expected.columns).exceptAll(expected).isEmpty()


def test_salted_join_spreads_the_hot_key(spark, rows):
    lookup = spark.createDataFrame([("hot", -1)], "domain STRING, v INT")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.salted_join(rows, lookup, "domain", rows_per_task=50).where("domain = 'hot'")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 1000 and max(sizes) < 500


def test_first_discovery_combines_before_the_shuffle(rows):
    frontier = rows.select(
        F.col("url"), "depth", "domain", F.lit("home").alias("url_key"), F.lit(None).cast("string").alias("src")
    )
    found = FR.first_discovery(frontier)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    first = rows.orderBy("depth", "domain", "url").first()
    assert (found.first().url, found.first().depth) == (first.url, first.depth)


def test_null_keys_are_spread(spark):
    left = spark.range(8000).select(F.lit(None).cast("string").alias("host"), "id")
    lookup = spark.createDataFrame([("a", 1)], "host STRING, v INT")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.salted_join(left, lookup, "host", 500)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 8000 and max(sizes) < 4000
