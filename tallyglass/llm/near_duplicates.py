"""Near duplicates: ProbMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, parked, words

#: 64-bit words of the bit set that sums up how a text differs from its leader.
WORDS = 16
#: A character that belongs to a word.
WORD = r"[^\x20\x09-\x0D]"
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``bands`` groups of ``rows`` signature places. Two texts at the threshold 0.8 share a band but for
    (1 - 0.8 ** 5) ** 32, three in a million; those further apart meet less."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    batch_rows: int = 500

    @property
    def places(self) -> int:
        return self.bands * self.rows


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (a fixed bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return x ^ (x >> np.uint64(31))


def draw(keys: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two even 64-bit random numbers of each element for one step of its arrivals."""
    with np.errstate(over="ignore"):
        seed = mix(keys + np.uint64((2 * step + 1) * _MIX[2] & 0xFFFFFFFFFFFFFFFF))
        return seed, mix(seed + np.uint64(_MIX[2]))


def signatures(keys: np.ndarray, weights: np.ndarray, sets: np.ndarray, n: int, places: int) -> np.ndarray:
    """ProbMinHash signatures of n weighted sets; ``sets`` names the set of each element, keys are distinct in a set.

    Each element arrives at the times of a Poisson process whose rate is its weight, and each
    arrival falls into a random place; a place keeps the element that came first. The elements of a
    set go on step by step until their next arrival is later than the latest first arrival of all
    places. Two sets agree in a place with the probability of their probability Jaccard similarity.
    """
    first = np.full(n * places, np.inf)
    out = np.zeros(n * places, np.uint64)
    rates, now, base, step = weights.astype(np.float64), np.zeros(len(keys)), sets * places, 0
    while len(keys):
        a, b = draw(keys, step)
        now = now - np.log1p(-((a >> np.uint64(11)) * 2.0**-53)) / rates
        live = now < first.reshape(n, places).max(axis=1)[sets]
        keys, rates, now, b, base, sets = keys[live], rates[live], now[live], b[live], base[live], sets[live]
        place = base + (b % np.uint64(places)).astype(np.int64)
        better = now < first[place]
        p, t, k = place[better], now[better], keys[better]
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        p = p[order]
        first[p], out[p] = t[order], k[order]
        step += 1
    return out.reshape(n, places)


def band_keys(signs: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit number for each band of each signature."""
    table = signs.reshape(len(signs), settings.bands, settings.rows)
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, settings.bands + 1, dtype=np.uint64) * np.uint64(_MIX[2]))
        for j in range(settings.rows):
            key = mix(key * np.uint64(3) + table[:, :, j])
    return key.view(np.int64)


def shingle_counts(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and their counts, from sorted runs."""
    heads = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    return runs[heads], np.diff(np.append(heads, len(runs)))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over all j of max(a_j / a_i, b_j / b_i), exactly.

    For a common element with ratio r_i = a_i / b_i the sum over j is
    (sum of a_j with a_j / b_j >= r_i) / a_i + (sum of b_j with a_j / b_j < r_i) / b_i, so the
    elements are sorted by their ratio once.
    """
    if a[1].max(initial=1) == 1 == b[1].max(initial=1):  # plain sets: common over all
        common = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return common / (len(a[0]) + len(b[0]) - common)
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])], y[np.searchsorted(keys, b[0])] = a[1], b[1]
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(keys), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, sx, sy = ratio[order], x[order], y[order]
    above = np.append(np.cumsum(sx[::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(sy))
    at = np.searchsorted(ratio, x[common] / y[common], side="left")
    return float((1.0 / (above[at] / x[common] + below[at] / y[common])).sum())


def _hashes(items: str, k: int) -> Column:
    """64-bit numbers of the runs of k words, sorted; fewer words make one run of all."""
    w = F.col(items)
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))
    return F.sort_array(F.slice(runs, F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))))


def _sign(batches: Iterator[pa.RecordBatch], settings: Settings, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        out = np.empty((batch.num_rows, settings.bands), np.int64)
        low = 0
        while low < batch.num_rows:  # about ``most`` elements at once
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
            counted = [shingle_counts(values[ends[i] : ends[i + 1]]) for i in range(low, high)]
            keys, weights = (np.concatenate(x) for x in zip(*counted))
            keys = keys.view(np.uint64)
            sets = np.repeat(np.arange(high - low), [len(k) for k, _ in counted])
            out[low:high] = band_keys(signatures(keys, weights, sets, high - low, settings.places), settings)
            low = high
        bands = pa.ListArray.from_arrays(np.arange(0, out.size + 1, settings.bands, dtype=np.int32), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), bands], names=["copy", "bands"])


def difference(a: np.ndarray, b: np.ndarray) -> tuple[int, list[int]]:
    """Number of runs that one of two texts has and the other lacks, and the set of their hashed bits."""
    apart = np.setxor1d(a, b, assume_unique=True)
    bit = mix(apart.view(np.uint64)) & np.uint64(64 * WORDS - 1)
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return len(apart), out.view(np.int64).tolist()


def _verify(batches: Iterator[pa.RecordBatch], differing: bool) -> Iterator[pa.RecordBatch]:
    last, left = None, None
    for batch in batches:
        a, b, x, y = (batch.column(c) for c in ("a", "b", "left", "right"))
        xs, xe, ys, ye = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy(), y.values.to_numpy(zero_copy_only=False), y.offsets.to_numpy()
        score, apart, bits = np.empty(batch.num_rows), [], []
        for i, key in enumerate(a.to_pylist()):
            if key != last:
                last, left = key, shingle_counts(xs[xe[i] : xe[i + 1]])
            right = shingle_counts(ys[ye[i] : ye[i + 1]])
            score[i] = probability_jaccard(left, right)
            if differing:
                n, words = difference(left[0], right[0])
                apart.append(n)
                bits.append(words)
        columns = [a, b, pa.array(score)]
        if differing:
            columns += [pa.array(np.diff(ye)[: batch.num_rows].astype(np.int64)), pa.array(apart, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity", "n", "apart", "bits"][: len(columns)])


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, class_id) of every end of a link (a, b); class_id is the smallest id it is connected to.

    Links are pulled to the smallest neighbour in turn from both sides until none changes; each
    round is a written table, and only counts come to the driver.
    """
    edges = parked(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.where("u <> m").select("u", F.col("m").alias("v"))
        starred = parked(large.unionByName(own).distinct(), label)
        low = starred.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = starred.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = parked(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        tally = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if tuple(tally) == tuple(before):
            break
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("class_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).unionByName(roots)


def _scored(pairs: DataFrame, texts: DataFrame, differing: bool = False) -> DataFrame:
    """Exact similarity of pairs (a, b) from the sorted runs of their texts; with ``differing`` also how b differs from a."""
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("runs").alias("right")), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("runs").alias("left")), "a")
    schema = "a long, b long, similarity double" + ", n long, apart long, bits array<long>" * differing
    return both.select("a", "b", "left", "right").mapInArrow(partial(_verify, differing=differing), schema)


def references(scores: DataFrame) -> DataFrame:
    """(id, ref, n, apart, extra, bits): how each text differs from the leader of its that most texts met."""
    followers = scores.groupBy("a").agg(F.count("*").alias("followers"))
    best = F.max_by(F.struct("a", "n", "apart", "bits"), F.struct("followers", -F.col("a"))).alias("r")
    rows = scores.join(followers, "a").groupBy(F.col("b").alias("id")).agg(best)
    filled = F.aggregate("r.bits", F.lit(0), lambda total, word: total + F.bit_count(word))
    return rows.select("id", F.col("r.a").alias("ref"), "r.n", "r.apart", (F.col("r.apart") - filled).alias("extra"), "r.bits")


def _may_agree(similarity: float) -> Column:
    """Whether two texts, the second with names ending in _x, can reach the similarity, by how they differ from one leader.

    What tells two texts apart is what tells just one of them from the leader. Each such run takes 1 / n of a
    text at least, n being its number of runs; and x + y, the shares of two texts that the other lacks, may not
    exceed 2 (1 - s) / (1 + s), by the bound of ``_reaches``. At most ``common`` runs tell both from the leader:
    their common bits, and those that share a bit; nor more than either has. Without one leader nothing is known.
    """
    both = F.zip_with("bits", "bits_x", lambda a, b: F.bit_count(a.bitwiseAND(b)))
    common = F.aggregate(both, F.lit(0), lambda total, word: total + word) + F.least("extra", "extra_x")
    bound = 2 * (1 - similarity) / (1 + similarity) * F.greatest("n", "n_x") + 1e-6
    apart = F.col("apart") + F.col("apart_x")
    quick = apart - 2 * F.least("apart", "apart_x") <= bound
    return (F.col("ref") != F.col("ref_x")) | (quick & (apart - 2 * common <= bound))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, class_id, run, w): the share of each distinct run in the runs of its text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        counted = [shingle_counts(values[ends[i] : ends[i + 1]]) for i in range(batch.num_rows)]
        rows = np.repeat(np.arange(batch.num_rows), [len(k) for k, _ in counted])
        keys, shares = (np.concatenate(x) for x in zip(*((k, n / n.sum()) for k, n in counted)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(keys), pa.array(shares)], names=["id", "class_id", "run", "w"])


def _reaches(x: Column, y: Column, similarity: float) -> Column:
    """Whether texts with shares x and y of their weight outside their common runs can reach the similarity.

    For a common run i the sum over j of max(a_j / a_i, b_j / b_i) is at least 1 / a_i + y / b_i, so the
    similarity is at most the sum of a_i b_i / (b_i + y a_i), and, as that function is concave, at most
    its value at a = 1 - x and b = 1 - y, which is ab / (a + b - ab).
    """
    a, b = 1 - x, 1 - y
    return a * b >= (similarity - 1e-9) * (a + b - a * b)


def across_classes(texts: DataFrame, rows: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of texts of different classes, among which are all that reach the similarity.

    The runs that no text of another class has come first in every text, then the others from the
    rarest to the most frequent. The first run that two texts share comes, in both, after runs
    that they do not share; the weight before it bounds their similarity. So in one of them less than
    (1 - s) / (1 + s) of the weight lies before it, in the other no more than 1 - s, and only those prefixes are
    joined: a line that most texts share lies behind them, and pairs nobody. ``known`` tells how texts differ from
    their leader (``references``): copies of one text, each edited elsewhere, are then no candidates of each other.
    """
    labelled = texts.join(rows.select("id", "class_id").distinct(), "id").select("id", "class_id", "runs")
    weights = parked(labelled.mapInArrow(_weigh, "id long, class_id long, run long, w double"), "weights")
    counts = weights.groupBy("run").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.count("*").alias("df"))
    counts = parked(counts.where("lo <> hi").select("run", "df"), "frequencies")
    met = weights.join(counts, "run").select("id", "class_id", "run", "w", "df")
    by_id = Window.partitionBy("id")
    earlier = by_id.orderBy("df", "run").rowsBetween(Window.unboundedPreceding, -1)
    before = 1 - F.sum("w").over(by_id) + F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    ranked = met.withColumn("before", before).where(F.col("before") <= 1 - similarity + 1e-9)
    prefixes = ranked.select("id", "class_id", "run", "before")
    like = _reaches(F.col("before"), F.col("before_x"), similarity)
    if known is not None:
        alone = F.monotonically_increasing_id()  # a text that has met no leader: a reference of its own
        prefixes = prefixes.join(known, "id", "left").withColumn("ref", F.coalesce("ref", -1 - alone))
        like = like & _may_agree(similarity)
    prefixes = parked(prefixes, "prefixes")
    short = prefixes.where(F.col("before") <= (1 - similarity) / (1 + similarity) + 1e-9)
    short = short.select("run", *(F.col(c).alias(f"{c}_x") for c in prefixes.columns if c != "run"))
    both = short.join(prefixes, "run").where((F.col("class_id") != F.col("class_id_x")) & like)
    return both.select(F.least("id", "id_x").alias("a"), F.greatest("id", "id_x").alias("b")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_words, kept) of every document.

    A class is a connected component of the texts whose weighted runs of five lower-cased words
    have a probability Jaccard similarity of 0.8 or more; class_id is the smallest doc_id of its
    rows, null if they have none, and the rows of that doc_id are kept. Every distinct text has an
    identity of its own, whatever the ids of its rows: equal texts are one class before all else and
    are compared once, texts of null doc_ids are compared like others, and two texts of one doc_id
    are two texts, in the class of each. Texts without a word, null ones too, are like nothing: a
    class each. Texts of fewer than five words count as one run.

    In every bucket of a band the document that meets most others in all its buckets, as the origin
    of many copies does, is compared with all others. A bucket whose documents are then in one
    class is settled. Documents of the other buckets are compared across classes, where the rarest runs of both
    leave room for the similarity (``across_classes``): no link is lost, and no bucket is paired out.
    """
    with arrow_rows(docs.sparkSession, settings.batch_rows):
        return _classes(docs, doc_id, text, settings).select("doc_id", "class_id", "n_words", "kept")


def _bare(text: Column) -> Column:
    """Lower-cased words with one space between."""
    return F.array_join(words(F.lower(text)), " ")


def _copy(bare: Column) -> Column:
    """Digest that equal texts share; null without a word."""
    return F.when(bare != "", F.unhex(F.sha2(bare, 256)))


def _classes(docs: DataFrame, doc_id: str, text: str, settings: Settings) -> DataFrame:
    """The columns of ``classes`` with copy, the digest of a text, and root, the identity of its class; both null without a word."""
    # Words are split once a row; a filter on them would be pushed below and split them again.
    split = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("raw"), words(F.lower(F.col(text))).alias("w"))
    rows = split.select("doc_id", "raw", "w", _copy(F.array_join("w", " ")).alias("copy"))
    members = parked(rows.select("doc_id", "copy", F.size("w").alias("n_words")), "copies")
    heads = members.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("head"))
    heads = parked(heads.withColumn("id", F.monotonically_increasing_id()), "heads")
    texts = rows.where(F.col("raw").rlike(WORD))
    cut = texts.select("copy", _hashes("w", settings.shingle).alias("runs"))
    signed = cut.mapInArrow(partial(_sign, settings=settings), "copy binary, bands array<bigint>")
    signed = signed.groupBy("copy").agg(F.first("bands").alias("bands"))
    signed = parked(signed.join(heads, "copy").select("id", "bands"), "signatures")
    buckets = signed.select("id", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = parked(buckets.join(full, "bucket").select("bucket", "id", "n"), "buckets")
    ranks = parked(met.groupBy("id").agg(F.sum("n").alias("rank")), "ranks")
    held = met.join(ranks, "id").select("bucket", "id", "rank")
    lead = held.groupBy("bucket").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("leader"))
    held = parked(held.join(lead, "bucket"), "held")
    pairs = held.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    used = heads.join(ranks.select("id"), "id", "left_semi").withColumnRenamed("copy", "own")
    bare = texts.select("doc_id", "copy", F.array_join("w", " ").alias("text"))  # a string is lighter to send than its words
    single = bare.join(used, (F.col("copy") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head")))
    single = single.groupBy("id").agg(F.min("text").alias("text"))
    single = parked(single.select("id", words(F.col("text")).alias("w")).select("id", _hashes("w", settings.shingle).alias("runs")), "runs")
    scores = parked(_scored(pairs, single, differing=True), "scores")
    links = scores.where(F.col("similarity") >= settings.similarity).select("a", "b")
    found = parked(components(links), "components")
    # Texts still to be compared: those of buckets that hold more than one class beside the leader, who has met all.
    tagged = held.where("id <> leader").join(found, "id", "left").select("bucket", "id", F.coalesce("class_id", "id").alias("class_id"))
    mixed = tagged.groupBy("bucket").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("bucket")
    open_rows = parked(tagged.join(mixed, "bucket").select("id", "class_id").distinct(), "open")
    done = scores.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = parked(across_classes(single, open_rows, settings.similarity, references(scores)).join(done, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        fresh = parked(_scored(pairs, single), "scores")
        new = fresh.where(F.col("similarity") >= settings.similarity).select("a", "b")
        if not new.isEmpty():
            found = parked(components(links.unionByName(new)), "components")
    tops = found.join(heads, "id").groupBy("class_id").agg(F.min("head").alias("top"))
    named = found.join(tops, "class_id").select("id", F.col("class_id").alias("root"), "top")
    top = F.when(F.col("root").isNull(), F.col("head")).otherwise(F.col("top"))
    labelled = heads.join(named, "id", "left").select("copy", F.coalesce("root", "id").alias("root"), top.alias("top"))
    out = members.join(labelled, "copy", "left").withColumn("class_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("top")))
    n_words = F.when(F.col("copy").isNull(), 0).otherwise(F.col("n_words")).alias("n_words")
    return out.select("doc_id", "class_id", n_words, F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "copy", "root")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Whole rows with their id and the digest of their text."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    return docs.select(row.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), _copy(_bare(F.col(text))).alias("copy"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows whose id is that of their class; rows that repeat its id all stay, see ``one_of_each_class``."""
    with arrow_rows(docs.sparkSession, settings.batch_rows):
        gone = _classes(docs.select(doc_id, text), doc_id, text, settings).where("not kept")
        gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy")).distinct()
    same = (F.col("copy") == F.col("gone_copy")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))
    return _rows(docs, doc_id, text).join(gone, same, "left_anti").select("row.*")


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Exactly one row of each class, whatever the ids are: of the smallest doc_id, nulls last, and then of the first text.

    Rows without a word are a class each and stay.
    """
    with arrow_rows(docs.sparkSession, settings.batch_rows):
        found = _classes(docs.select(doc_id, text), doc_id, text, settings).where("root is not null")
        same_row = found.groupBy("root", "doc_id", "copy").agg(F.count("*").alias("n"))
        first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy", "n")
        winners = same_row.groupBy("root").agg(F.min(first).alias("x"))
        winners = parked(winners.select(F.col("x.doc_id").alias("won_id"), F.col("x.copy").alias("won_copy"), F.col("x.n").alias("n")), "winners")
    rows = _rows(docs, doc_id, text)
    same = (F.col("copy") == F.col("won_copy")) & F.col("doc_id").eqNullSafe(F.col("won_id"))
    out = rows.join(winners.where("n = 1"), same, "left_semi").select("row.*")
    repeated = winners.where("n > 1")
    if not repeated.isEmpty():
        plain = [F.col("row")[f.name] for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        order = F.struct(F.col("row")[text].alias("text"), F.xxhash64(*plain).alias("rest"))
        again = rows.join(repeated, same, "left_semi").groupBy("copy").agg(F.min_by("row", order).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out.unionByName(rows.where("copy is null").select("row.*"))
