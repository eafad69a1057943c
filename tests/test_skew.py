"""Heavy keys are split, others are not, and results stay those of a plain join."""

from collections import Counter

from pyspark.sql import functions as F

from tallyglass.operators.skew import heavy_keys, heavy_lookup, salted_lookup


def frames(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string")))
    big = spark.range(60_000).select("id", key.alias("key"))
    small = spark.range(2000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    return big, small.unionByName(spark.createDataFrame([("hot", -1)], "key string, v long"))


def test_heavy_keys_are_few_and_complete(spark):
    big, _ = frames(spark)
    assert spark.range(1).select(heavy_keys(big, "key", 8).alias("k")).first()["k"] == ["hot"]
    assert spark.range(1).select(heavy_keys(big.limit(0), "key", 8).alias("k")).first()["k"] in (None, [])


def test_a_heavy_key_is_read_by_many_tasks(spark):
    big, small = frames(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        split = heavy_lookup(big, small, "key", ["id"], "left", salts=16)
        sizes = [r["n"] for r in split.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        plain = big.join(small, "key", "left")
        whole = [r["n"] for r in plain.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(whole) >= 20_000 and max(sizes) <= 7_000 and sum(sizes) == 60_000
        got = Counter(tuple(r) for r in split.select("key", "id", "v").collect())
        assert got == Counter(tuple(r) for r in plain.select("key", "id", "v").collect())
        inner = heavy_lookup(big, small, "key", ["id"], "inner")
        assert inner.count() == plain.where("v is not null").count()
        held = heavy_lookup(small, small.withColumnRenamed("v", "w"), "key", ["v"], salts=16)
        assert held.count() == 2001  # nothing is heavy, nothing repeated
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_of_a_small_side_are_not_broadcast(spark):
    """Spark estimates the small side without its copies, here as 0.8 MB instead of 45 MB."""
    small = spark.range(50_000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    big = spark.range(200_000).select("id", (F.col("id") % 60_000).cast("string").alias("key"))
    out = salted_lookup(big, small, "key", how="left", salts=28)
    counts = out.agg(F.count("*").alias("n"), F.count("v").alias("hits"))
    assert "Broadcast" not in counts._jdf.queryExecution().executedPlan().toString()
    assert tuple(counts.first()) == (200_000, 170_000)
