"""Joins whose hot keys are known before the shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_operators import rows

from stratalake.operators.joins import hot_keys, left_join_spread

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def half_hot(spark, n):
    """Half of the rows on one license, a tenth on another, a fifth without, the rest spread."""
    d = F.col("id") % 10
    key = F.when(d < 5, F.lit(7)).when(d == 5, F.lit(-3)).when(d < 8, F.lit(None)).otherwise(F.col("id") % 5000)
    return spark.range(n).select(F.col("id").alias("PLANT"), key.cast("bigint").alias("LIC"))


def licenses(spark):
    return spark.range(100).select((F.col("id") - 10).alias("LIC"), (F.col("id") * 2).alias("v"))


def test_hot_keys_are_found_in_one_pass_of_counts(spark):
    left = half_hot(spark, 50_000)
    assert sorted(hot_keys(left, "LIC")) == [-3, 7]
    assert hot_keys(left, "LIC", share=0.3) == [7]
    assert hot_keys(left.filter("LIC IS NULL"), "LIC") == []
    assert hot_keys(left.limit(0), "LIC") == []
    texts = left.withColumn("LIC", F.concat(F.lit("l'"), "LIC"))
    assert sorted(hot_keys(texts, "LIC")) == ["l'-3", "l'7"]


def test_result_is_that_of_the_plain_join(spark):
    left = half_hot(spark, 6000)
    for right in (licenses(spark), licenses(spark).unionAll(licenses(spark).limit(30)), licenses(spark).limit(0)):
        plain = left.join(right, "LIC", "left").select("LIC", "PLANT", "v")
        for hot in ([], [7], [7, -3], [7, 123456]):
            got = left_join_spread(left, right, "LIC", "PLANT", hot).select("LIC", "PLANT", "v")
            assert rows(got) == rows(plain)


def test_a_hot_key_below_the_adaptive_threshold_is_spread(spark):
    """Far too small for the adaptive split, yet no reducer has many more rows than another."""
    left, right = half_hot(spark, 80_000), licenses(spark)
    try:
        for name, value in NO_BROADCAST.items():
            spark.conf.set(name, value)
        sizes = {}
        for name, hot in (("plain", []), ("hot", hot_keys(left, "LIC"))):
            joined = left_join_spread(left, right, "LIC", "PLANT", hot)
            counts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes[name] = max(r["count"] for r in counts)
        assert sizes["plain"] > 40_000 and sizes["hot"] < 16_000  # of 8 reducers
    finally:
        for name in NO_BROADCAST:
            spark.conf.unset(name)
