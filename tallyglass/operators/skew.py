"""Lookups against one row per key when a key may hold a large share of the big side."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEWEST_SALTS = 8


def salt_count(rows: DataFrame) -> int:
    """Grows with the cluster: a key is split further as there are more shuffle partitions."""
    return max(FEWEST_SALTS, 2 * isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def salted_lookup(
    big: DataFrame, small: DataFrame, key: str, spread: str = "id", how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join where ``small`` has few rows per key; a hot key is split over ``salts`` tasks.

    The aggregate that follows combines per task before it shuffles, so the hot key
    never meets in one place. Both sides are shuffled: Spark estimates an exploded side without its
    copies, so it would broadcast many times the session's threshold through the driver.
    """
    salts = salts or salt_count(big)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


#: A key is heavy when it holds more rows than this share of an even task's.
HEAVY_SHARE = 0.25
#: Keys that the sketch tracks; its answer has at most MOST_HEAVY of them.
TRACKED, MOST_HEAVY = 65_536, 4096


def heavy_keys(rows: DataFrame, key: str, tasks: int) -> Column:
    """Array of the keys that would fill a large part of a task, from one sketch of bounded size; NULL is none.

    The sketch may name a key that is a little below the bound, and misses none above it.
    """
    sketch = F.call_function("approx_top_k", F.col(key), F.lit(MOST_HEAVY), F.lit(TRACKED))
    found = rows.agg(sketch.alias("top"), F.count(key).alias("n"))
    least = F.greatest(F.lit(1), F.col("n") * HEAVY_SHARE / tasks)
    return found.select(F.transform(F.filter("top", lambda x: x["count"] >= least), lambda x: x["item"])).scalar()


def heavy_lookup(
    big: DataFrame, small: DataFrame, key: str, spread: list[str], how: str = "inner", salts: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join like :func:`salted_lookup` that splits, and repeats in ``small``, only the keys that are heavy.

    A first pass over the key column of ``big`` finds them, in the same plan; ``big`` should be cheap to
    read twice, as a stored table is, or ``counted`` holds the same keys and is. ``spread`` are columns that tell the rows of a heavy key apart. Rows without
    a key match nothing and go round the tasks.
    """
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or salt_count(big)
    heavy = F.coalesce(heavy_keys(big if counted is None else counted, key, tasks), F.array().cast(f"array<{big.schema[key].dataType.simpleString()}>"))
    own = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", F.when(F.col(key).isNull() | F.array_contains(heavy, F.col(key)), own).otherwise(F.lit(0)))
    copies = F.when(F.array_contains(heavy, F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = small.withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")
