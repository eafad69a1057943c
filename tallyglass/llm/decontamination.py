"""Benchmark decontamination: item-sized windows that share a run with an item, exact shingle similarity, SimHash distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at, words


@dataclass(frozen=True)
class Settings:
    """A window and an item are alike from ``similarity`` on, by their runs of ``shingle`` words."""

    shingle: int = 5
    similarity: float = 0.8
    broadcast_shingles: int = 1_000_000


def shingles(items: Column, k: int) -> Column:
    """Texts of the runs of k words; fewer words make one run of all."""
    n = F.size(items)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(items, i + 1, F.lit(k)), " "))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def shingle_hashes(items: str, k: int) -> Column:
    """One 64-bit number for each run of k words, at the place of its first word."""
    n, w = F.size(items), F.col(items)
    runs = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *(at(w, i + j) for j in range(1, k)))), F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(items: Column) -> Column:
    """64-bit SimHash of words, each weighted by its count: bit by bit the majority of the words' hashes."""
    hashes = F.transform(items, lambda x: F.xxhash64(x))

    def bit(total: Column, b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1))
        return total.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def as_set(runs: Column) -> Column:
    """Runs with their occurrence number, so that set operations count repeats; runs without repeats stay."""
    tagged = F.transform(runs, lambda x, i: F.concat(x, F.lit("\x00"), F.size(F.filter(F.slice(runs, F.lit(1), i), lambda y: y == x)).cast("string")))
    plain = F.transform(runs, lambda x: F.concat(x, F.lit("\x000")))
    return F.when(F.size(F.array_distinct(runs)) == F.size(runs), plain).otherwise(tagged)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two sets of numbered runs: sum of the smaller counts over sum of the larger."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Passages of documents that are like a benchmark item: doc_id, item_id, start, n_words, distance, similarity.

    Words are lower-cased. A window has as many words as an item. Only windows that share a run of
    five words with the item, in line with its place there, can reach the similarity; they are all
    compared run by run, each run weighted by its count. The distance is that of the SimHash
    fingerprints; it leaves out nothing, as like texts with repeated words can lie as far apart as
    unlike ones. A row is the best window of a document for an item, the first one of equals. Texts
    and items that are null or without a word match nothing. An item of fewer words is one run.
    Repeated rows give one row. The items' runs are broadcast only up to ``broadcast_shingles`` words
    of items.
    """
    k = settings.shingle
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.lower(F.col(item_text))).alias("iw")).where(F.size("iw") > 0)
    items = items.withColumn("length", F.size("iw")).withColumn("item", F.unhex(F.sha2(F.array_join("iw", " "), 256)))
    texts = docs.select(F.col(doc_id).alias("doc_id"), words(F.lower(F.col(text))).alias("w"))
    # items of fewer words than a run are looked up by runs of their own length
    sizes = {r["n"]: r["count"] for r in items.groupBy(F.least("length", F.lit(k)).alias("n")).agg(F.sum(F.col("length")).alias("count")).collect()}
    runs = seen = None
    for n in sorted(sizes) or [k]:
        own = items.where(F.least("length", F.lit(k)) == n).select("item", "length", F.posexplode(shingle_hashes("iw", n)).alias("offset", "run"))
        met = texts.select("doc_id", F.posexplode(shingle_hashes("w", n)).alias("place", "run"))
        runs, seen = (own, met) if runs is None else (runs.unionByName(own), seen.unionByName(met))
    runs = runs.distinct()
    if sum(sizes.values()) <= settings.broadcast_shingles:
        runs = F.broadcast(runs)
    hits = seen.join(runs, "run").select("doc_id", "length", F.greatest(F.col("place") - F.col("offset"), F.lit(0)).alias("start"), "item")
    hits = hits.groupBy("doc_id", "length", "start").agg(F.collect_set("item").alias("met"))
    starts = hits.groupBy("doc_id").agg(F.collect_list(F.struct("length", "start", "met")).alias("windows"))
    cut = texts.join(starts, "doc_id").select("doc_id", "w", F.explode("windows").alias("x"))
    windows = cut.select("doc_id", F.col("x.start").alias("start"), F.slice("w", F.col("x.start") + 1, F.col("x.length")).alias("ww"), F.col("x.met").alias("met"))
    windows = windows.withColumn("runs", as_set(shingles(F.col("ww"), k)))
    left = windows.select("doc_id", "start", "ww", "runs", F.explode("met").alias("item"))
    right = items.select("item_id", "item", "iw", as_set(shingles(F.col("iw"), k)).alias("item_runs"))
    scored = left.join(right, "item").withColumn("similarity", similarity(F.col("runs"), F.col("item_runs"))).where(F.col("similarity") >= settings.similarity)
    scored = scored.withColumn("distance", F.bit_count(simhash(F.col("ww")).bitwiseXOR(simhash(F.col("iw")))))
    best = F.max_by(F.struct("start", F.size("ww").alias("n_words"), "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start", "b.n_words", "b.distance", "b.similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without a leaked item; rows with a null id stay."""
    leaks = find_leaks(docs, benchmark, settings, doc_id, text).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(leaks, doc_id, "left_anti")
