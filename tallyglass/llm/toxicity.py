"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learnt from labels of whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parked, private_names

#: Bytes that stand for a letter or digit; all others count as a space. Fixed values.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Ends of sentences: a mark before white space, a line break, or a full-width mark.
ENDS = re.compile(rb"[.!?](?=[\x20\x09-\x0D])|\n|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
#: Put behind every text, so that no n-gram reaches from one into the next.
PAD = b"\n" * 8


@dataclass(frozen=True)
class Settings:
    """``documents`` bounds the labelled texts that are learnt from; ``longest`` their characters.

    Features are n-grams of bytes of the lengths ``grams``, hashed to ``2 ** bits`` buckets, of which
    the ``features`` that tell the labels apart best take part.
    """

    documents: int = 12_000
    longest: int = 200_000
    grams: tuple[int, ...] = (3, 5, 7)
    bits: int = 20
    features: int = 4096
    least: int = 3
    steps: int = 400
    rate: float = 0.05
    decay: float = 2e-5
    block: int = 4 << 20


@dataclass(frozen=True)
class Model:
    """Weights of buckets and the bias of a sentence."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]
    bits: int
    block: int = 4 << 20

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.buckets] = self.weights
        return out


class Block:
    """Texts side by side as bytes, with their sentences."""

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        raw = PAD + PAD.join(texts) + PAD
        data = np.frombuffer(raw, np.uint8)
        self.letters = LETTER[data]
        self.data = np.where(self.letters, data, np.uint8(32)).astype(np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = len(PAD) + np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
        self.ends = self.starts + sizes
        cuts = np.array([m.end() for m in ENDS.finditer(raw)], np.int64)
        borders = np.unique(np.r_[0, cuts, self.starts, self.ends])
        has = np.add.reduceat(self.letters, borders[borders < len(raw)], dtype=np.int64) > 0
        #: First and end byte of every sentence that has a letter or digit, and its text.
        self.low = borders[: len(has)][has]
        self.high = np.r_[borders[1:], len(raw)][: len(has)][has]
        self.text = np.searchsorted(self.starts, self.low, "right") - 1

    def places(self, grams: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
        """For each length the bucket of the n-gram that begins at every byte."""
        value = np.zeros(len(self.data), np.uint32)
        for k in range(max(grams)):
            value = value[: len(self.data) - k] * np.uint32(0x01000193) + self.data[k:]
            if k + 1 in grams:
                mixed = (value ^ (value >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32((k + 1) * 0x7F4A7C15 & 0xFFFFFFFF)
                yield (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits)

    def hits(self, grams: tuple[int, ...], bits: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, bucket) of the n-grams whose bucket is in ``keep``, each once a sentence, in order."""
        both = []
        for place in self.places(grams, bits):
            at = np.flatnonzero(keep[place])
            of = np.searchsorted(self.low, at + 1, "right") - 1  # an n-gram begins one byte before its word
            fits = of >= 0
            fits[fits] &= at[fits] < self.high[of[fits]]
            both.append(of[fits] << bits | place[at[fits]].astype(np.int64))
        found = np.unique(np.concatenate(both))
        return found >> bits, found & ((1 << bits) - 1)

    def each_text(self, grams: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
        """The different buckets of every text."""
        places = list(self.places(grams, bits))
        for low, high in zip(self.starts - 1, self.ends):
            yield np.unique(np.concatenate([p[low:high] for p in places]))


def lowered(text: str) -> bytes:
    """Lower-case UTF-8 with all bytes in their places; only A-Z are lowered where others would change their length."""
    raw, low = text.encode("utf-8", "replace"), text.lower().encode("utf-8", "replace")
    return low if len(low) == len(raw) else raw.lower()


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Cuts batches where their lower-cased texts fill ``size`` bytes."""
    for batch in batches:
        texts = [lowered(t or "") for t in batch.column(column).to_pylist()]
        first, filled = 0, 0
        for i, text in enumerate(texts):
            filled += len(text)
            if filled >= size or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), Block(texts[first : i + 1])
                first, filled = i + 1, 0


def _frequencies(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << settings.bits), np.int64)
    for batch, block in blocks(batches, 0, settings.block):
        for label, met in zip(batch.column(1).to_pylist(), block.each_text(settings.grams, settings.bits)):
            counts[label, met] += 1
    some = np.flatnonzero(counts.any(axis=0))
    for low in range(0, len(some), 1 << 16):
        part = some[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["bucket", "clean", "toxic"])


def _bags(batches: Iterator[pa.RecordBatch], settings: Settings, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text: label, sentences, and (sentence, feature) of the chosen features."""
    keep = np.zeros(1 << settings.bits, bool)
    keep[buckets] = True
    for batch, block in blocks(batches, 0, settings.block):
        sentence, bucket = block.hits(settings.grams, settings.bits, keep)
        feature, text = np.searchsorted(buckets, bucket), block.text[sentence]
        ends = np.searchsorted(text, np.arange(block.texts + 1))
        packed = [pa.array([v[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()) for v in (sentence, feature)]
        totals = np.bincount(block.text, minlength=block.texts)
        yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(totals), *packed], names=["toxic", "sentences", "sentence", "feature"])


def fit(labels: np.ndarray, plain: np.ndarray, owner: np.ndarray, starts: np.ndarray, features: np.ndarray, width: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps (Adam) on the noisy-or likelihood.

    Sentence i belongs to text ``owner[i]`` and has the features from ``starts[i]`` on; ``plain`` counts
    the sentences of each text without any.
    """
    weights, bias = np.zeros(width), -5.0
    moving, square = np.zeros(width + 1), np.zeros(width + 1)
    of = np.repeat(np.arange(len(owner)), np.diff(starts))
    for step in range(1, settings.steps + 1):
        logit = bias + np.bincount(of, weights[features], minlength=len(owner))
        chance, rest = 1 / (1 + np.exp(-logit)), 1 / (1 + np.exp(-bias))
        clean = np.bincount(owner, np.logaddexp(0, logit), minlength=len(labels)) + plain * np.logaddexp(0, bias)
        pull = np.where(labels == 1, -np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-12), 1.0)
        by_sentence = pull[owner] * chance
        slope = np.bincount(features, by_sentence[of], minlength=width) / len(labels) + settings.decay * weights
        slope = np.r_[slope, (by_sentence.sum() + (pull * plain).sum() * rest) / len(labels)]
        moving = 0.9 * moving + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        move = settings.rate * (moving / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """(text, toxic): at most ``settings.documents`` different labelled texts, chosen by hash.

    The label of a key is its largest 0 or 1; keys that are null and texts without a character or over
    ``settings.longest`` are left out.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = docs.where(F.length(text).between(1, settings.longest)).select(F.col(key).alias("k")).distinct()
    chosen = marks.join(known, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(settings.documents)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.length("text").between(1, settings.longest))
    met = texts.join(F.broadcast(chosen), "k").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return met.orderBy(F.xxhash64("text"), "text").limit(settings.documents)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """Learns from labelled documents; without both labels no sentence is toxic.

    Spark counts in how many texts of either label each bucket occurs; the buckets with the largest
    likelihood ratio take part. Their occurrences in the sample come to the driver, which fits the weights.
    """
    spark = docs.sparkSession
    rows = parked(training_rows(docs, labels, settings, key, text).repartition(F.xxhash64("text")), "toxicity")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    none = Model(np.zeros(0, np.int64), np.zeros(0), -40.0, settings.grams, settings.bits, settings.block)
    if len(totals) < 2:
        return none
    counts = rows.mapInArrow(partial(_frequencies, settings=settings), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = (F.lit(float(totals[label])) for label in (0, 1))
    met = F.col("clean") + F.col("toxic")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = met / (n0 + n1)
    ratio = term(F.col("toxic"), share * n1) + term(F.col("clean"), share * n0) + term(n1 - F.col("toxic"), (1 - share) * n1) + term(n0 - F.col("clean"), (1 - share) * n0)
    best = counts.where(met >= settings.least).select("bucket", ratio.alias("ratio")).orderBy(F.desc("ratio"), "bucket").limit(settings.features)
    buckets = np.array(sorted(r["bucket"] for r in best.collect()), np.int64)
    bags = rows.mapInArrow(partial(_bags, settings=settings, buckets=buckets), "toxic int, sentences long, sentence binary, feature binary")
    lengths, counts, features, plain, marks = [], [], [], [], []
    for total, toxic, sentence, feature in sorted((r["sentences"], r["toxic"], bytes(r["sentence"]), bytes(r["feature"])) for r in bags.collect()):
        _, times = np.unique(np.frombuffer(sentence, "<i4"), return_counts=True)
        lengths.append(times)
        counts.append(len(times))
        features.append(np.frombuffer(feature, "<i4"))
        plain.append(float(total - len(times)))
        marks.append(toxic)
    owner = np.repeat(np.arange(len(marks)), counts)
    starts = np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int64)
    weights, bias = fit(np.array(marks), np.array(plain), owner, starts, np.concatenate(features), len(buckets), settings)
    return Model(buckets, weights, bias, settings.grams, settings.bits, settings.block)


def sentence_scores(block: Block, model: Model, table: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Probability of every sentence of a block."""
    sentence, bucket = block.hits(model.grams, model.bits, keep)
    return 1 / (1 + np.exp(-(model.bias + np.bincount(sentence, table[bucket], minlength=len(block.low)))))


def noisy_or(chances: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """1 - product(1 - chance) of each text; 0 without any sentence."""
    return -np.expm1(np.bincount(owner, np.log1p(-np.minimum(chances, 1 - 1e-15)), minlength=texts))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, offends: float, spans: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns behind the text, then score, sentences, chance of the worst, and number or spans of the offending ones."""
    table = model.table()
    keep = table != 0
    for batch, block in blocks(batches, 0, model.block):
        chances = sentence_scores(block, model, table, keep)
        bad = np.flatnonzero(chances >= offends)
        worst = np.zeros(block.texts)
        np.maximum.at(worst, block.text, chances)
        columns = [pa.array(np.clip(noisy_or(chances, block.text, block.texts), 0, 1)), pa.array(np.bincount(block.text, minlength=block.texts)), pa.array(worst)]
        if spans:
            found: list[list[dict]] = [[] for _ in range(block.texts)]
            raw = [(t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            for i in bad:
                of = int(block.text[i])
                low, high = (int(v - block.starts[of]) for v in (block.low[i], min(block.high[i], block.ends[of])))
                found[of].append({"low": low, "high": high, "chance": float(chances[i]), "sentence": raw[of][low:high].decode("utf-8", "replace")})
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("chance", pa.float64()), ("sentence", pa.string())]))
            columns.append(pa.array(found, kind))
        else:
            columns.append(pa.array(np.bincount(block.text[bad], minlength=block.texts)))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=names)


def _apply(rows: DataFrame, model: Model, text: str, offends: float, spans: bool) -> DataFrame:
    own = [c for c in rows.columns if c.lower() != text.lower()]
    fresh = private_names(own, "score", "n_sentences", "worst_sentence", "offending" if spans else "n_offending")
    last = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("chance", T.DoubleType()), T.StructField("sentence", T.StringType())]))
    kinds = [T.DoubleType(), T.LongType(), T.DoubleType(), last if spans else T.LongType()]
    schema = T.StructType([*(rows.schema[c] for c in own), *(T.StructField(n, k) for n, k in zip(fresh, kinds))])
    work = partial(_scored, model=model, offends=offends, spans=spans, names=[*own, *fresh])
    return rows.select(F.col(text).cast("string").alias("text"), *(F.col(c) for c in own)).mapInArrow(work, schema)


def score(rows: DataFrame, model: Model, text: str = "text", offends: float = 0.5) -> DataFrame:
    """The rows without their text, with ``score``, ``n_sentences``, ``worst_sentence`` and ``n_offending``.

    ``score`` is the noisy-or of the sentences of the whole text, from 0 to 1; null, empty and blank texts
    have no sentence and get 0. Repeated rows get equal scores. Other columns stay; a new column
    whose name is taken gets an underscore. An empty table gives no rows.
    """
    return _apply(rows, model, text, offends, False)


def locate(rows: DataFrame, model: Model, text: str = "text", offends: float = 0.5) -> DataFrame:
    """As ``score``, with ``offending``: the sentences of a chance of ``offends`` or more, with their places in UTF-8 bytes."""
    return _apply(rows, model, text, offends, True)
