"""Katz backoff language model over words: Good-Turing counts in partitioned tables, scored chunk by chunk.

Documents are read once, in chunks of a few million tokens. A chunk keeps its documents as local word
numbers in one file of the shared folder and asks two sets of partitioned tables, in bulk, for what its
words and word pairs count in all training documents. A question is a sorted array for one partition,
its answer an array in the same order, so pairs travel once and answers carry no keys. Only a few dozen
counts of counts come to the driver; no table is held whole anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import parked, partitions
from .files import make_folder, open_folder

END = 0x9E3779B97F4A7C15  # stands for the end of a text; also the context of its first word
K = 5
NO_MASS = np.uint32(1 << 31)
ROWS = "part int, chunk string, keys binary, extra binary"
ANSWERS = "chunk string, part int, kind string, data binary, more binary, tally array<long>"


@dataclass(frozen=True)
class Settings:
    """Tokens of a chunk, and how often a context may occur before its pairs are dealt to several partitions."""

    chunk_tokens: int = 4_000_000
    context_split: int = 1 << 22


def pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Chunk:
    """Documents as local word numbers; word number 0 is the end of a text."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None, held_out: bool) -> None:
        numbers = self.numbers
        words = (text or "").encode().lower().split()
        found = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int32, len(words))
        self.tokens.append(np.append(found, np.int32(0)))
        self.docs.append((doc_id, held_out, len(words) + 1))
        self.size += len(words) + 1

    def write(self, folder: str, name: str) -> np.ndarray:
        """Writes the chunk under its name, at once and whole; returns the words' hashes by number."""
        import xxhash

        hashes = np.fromiter((END, *map(xxhash.xxh64_intdigest, self.numbers)), np.uint64, len(self.numbers) + 1)
        ids, held, sizes = zip(*self.docs)
        parts = [
            pack(np.array([-1 if i is None else i for i in ids], np.int64)), pack(np.array([i is None for i in ids])),
            pack(np.array(held, bool)), pack(np.array(sizes, np.int64)), pack(np.concatenate(self.tokens)), pack(hashes),
        ]
        system, plain = open_folder(folder)
        attempt = f"{plain}/_{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(attempt, compression=None) as sink:
            for part in parts:
                sink.write(len(part).to_bytes(8, "little") + part)
        system.move(attempt, f"{plain}/{name}")
        return hashes


class Stored:
    """A chunk read back, with its word pairs."""

    def __init__(self, folder: str, name: str, parts: int) -> None:
        system, plain = open_folder(folder)
        with system.open_input_file(f"{plain}/{name}") as source:
            data, at, blobs = source.read(), 0, []
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            blobs.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        self.ids, self.nulls, self.held, self.sizes, self.tokens, self.hashes = (unpack(b, t) for b, t in zip(blobs, (np.int64, bool, bool, np.int64, np.int32, np.uint64)))
        self.parts = parts
        self.word_part, self.word_order = deal(self.hashes, self.hashes, parts)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[self.starts] = 0
        self.trained = np.repeat(~self.held, self.sizes)

    def words_of(self, answers: dict[int, bytes]) -> np.ndarray:
        """Training counts of the words, by number."""
        counts = np.zeros(len(self.hashes), np.int64)
        for part, (low, high) in spans(self.word_part, self.parts):
            counts[self.word_order[low:high]] = unpack(answers[part], np.int64)
        return counts

    def pairs(self, counts: np.ndarray, settings: Settings):
        """Distinct pairs dealt to partitions: context and word numbers, group keys, training counts, and each token's pair."""
        n = np.int64(len(self.hashes))
        key = self.context.astype(np.int64) * n + self.tokens
        unique, self.pair_of = np.unique(key, return_inverse=True)
        self.first, self.second = unique // n, unique % n
        self.local = np.bincount(self.pair_of, weights=self.trained, minlength=len(unique)).astype(np.int64)
        self.splits = np.maximum(1, -(-counts // settings.context_split))
        sub = (self.hashes[self.second] % self.splits[self.first].astype(np.uint64)).astype(np.int64)
        self.group = group_keys(self.hashes[self.first], sub)
        # contexts whose left-over mass may matter: of pairs that this chunk did not train on, and split ones
        asked = np.unique(self.first[(self.local == 0) | (self.splits[self.first] > 1)])
        times = self.splits[asked]
        self.asked = np.repeat(asked, times)
        self.asked_group = group_keys(self.hashes[self.asked], np.arange(len(self.asked)) - np.repeat(np.cumsum(times) - times, times))
        self.pair_part, self.pair_order = deal(self.group, self.hashes[self.second], self.parts)
        self.ask_part, self.ask_order = deal(self.asked_group, self.asked_group, self.parts)


def group_keys(hashes: np.ndarray, sub: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes + sub.astype(np.uint64) * np.uint64(END))


def deal(group: np.ndarray, second: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each key in order, and the order: by partition, group, second key."""
    part = (mix(group) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((second, group, part)) if second is not group else np.lexsort((group, part))
    return part[order], order


def spans(part: np.ndarray, parts: int) -> Iterator[tuple[int, tuple[int, int]]]:
    edges = np.searchsorted(part, np.arange(parts + 1)).tolist()
    return ((p, (a, b)) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _read_documents(batches: Iterator[pa.RecordBatch], folder: str, parts: int, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Writes chunks; asks for the counts of their words."""
    task, number, chunk = TaskContext.get().partitionId(), 0, Chunk()

    def close() -> Iterator[pa.RecordBatch]:
        name = f"chunk-{task:06d}-{number:04d}"
        hashes = chunk.write(folder, name)
        every = np.concatenate(chunk.tokens)
        trained = np.repeat([not h for _, h, _ in chunk.docs], [n for _, _, n in chunk.docs])
        counts = np.bincount(every, weights=trained, minlength=len(hashes)).astype(np.int64)
        part, order = deal(hashes, hashes, parts)
        for p, (a, b) in spans(part, parts):
            yield _batch([(p, name, pack_sorted(hashes[order[a:b]]), pack(counts[order[a:b]]))], ROWS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            chunk.add(*row)
            if chunk.size >= settings.chunk_tokens:
                yield from close()
                number, chunk = number + 1, Chunk()
    if chunk.docs:
        yield from close()


def counts_of_counts(totals: np.ndarray) -> list[int]:
    """How many have count 1 .. K + 1, how many have any, and the sum of the counts."""
    return [*(int((totals == r).sum()) for r in range(1, K + 2)), int((totals > 0).sum()), int(totals.sum())]


def _count_words(table: pa.Table) -> pa.Table:
    """One partition of the word table: totals to every chunk that asked."""
    chunks, keys, counts = table["chunk"].to_pylist(), [unpack_sorted(x) for x in table["keys"].to_pylist()], [unpack(x, np.int64) for x in table["extra"].to_pylist()]
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(unique), np.int64)
    np.add.at(totals, place, np.concatenate(counts))
    part, rows, at = table["part"][0].as_py(), [], 0
    for chunk, own in zip(chunks, keys):
        rows.append((chunk, part, "words", pack(totals[place[at : at + len(own)]]), None, None))
        at += len(own)
    rows.append((None, part, "tally", None, None, counts_of_counts(totals)))
    return pa.Table.from_batches([_batch(rows, ANSWERS)])


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts for counts 1 .. K from counts of counts; counts above K keep all."""

    tally: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.tally[K + 2]

    @property
    def kinds(self) -> int:
        return self.tally[K + 1]

    def factors(self) -> np.ndarray:
        """factors()[min(r, K + 1)]: the share of a count r that stays; 1 where the counts of counts give none."""
        n, out = (0, *self.tally), np.ones(K + 2)
        out[0] = 0.0
        if n[1] == 0:
            return out
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] and n[r + 1] and common < 1:
                share = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
                if 0 < share < 1:
                    out[r] = share
        return out

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Of known words by their count; of all unknown words together where the count is 0. They sum to 1."""
        if not self.total:
            return np.ones(len(counts))
        keep = self.factors()
        lost = sum(self.tally[r - 1] * r * (1 - keep[r]) for r in range(1, K + 1)) / self.total
        scale = 1.0
        if lost <= 0:
            lost, scale = 1 / (self.total + 1), self.total / (self.total + 1)
        return np.where(counts > 0, scale * keep[np.minimum(counts, K + 1)] * counts / self.total, lost)


def _ask_pairs(table: pa.Table, folder: str, parts: int, settings: Settings) -> pa.Table:
    """A chunk asks for its pairs' counts and for what its contexts leave to unseen words."""
    name = table["chunk"][0].as_py()
    chunk = Stored(folder, name, parts)
    counts = chunk.words_of(dict(zip(table["part"].to_pylist(), table["data"].to_pylist())))
    chunk.pairs(counts, settings)
    asks, rows = dict(spans(chunk.ask_part, parts)), []
    pairs = dict(spans(chunk.pair_part, parts))
    for p in sorted({*asks, *pairs}):
        a, b = pairs.get(p, (0, 0))
        at = chunk.pair_order[a:b]
        c, d = asks.get(p, (0, 0))
        group, second = chunk.group[at], chunk.second[at]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(at) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(heads, len(at)))
        blobs = [
            pack_sorted(group[heads]), pack(lengths.astype(np.uint32)), pack(chunk.hashes[second]), pack(chunk.local[at].astype(np.uint32)),
            pack(counts[second].astype(np.uint64)), pack((chunk.splits[chunk.first[at[heads]]] > 1).astype(np.uint8)) if len(at) else pack(np.zeros(0, np.uint8)),
        ]
        rows.append((p, name, b"".join(len(x).to_bytes(8, "little") + x for x in blobs), pack_sorted(chunk.asked_group[chunk.ask_order[c:d]])))
    return pa.Table.from_batches([_batch(rows, ROWS)])


def _count_pairs(table: pa.Table, words: Discounts) -> pa.Table:
    """One partition of the pair table: totals of pairs, and of contexts how many words follow 1 .. K times and their word mass."""
    questions = []
    for data in table["keys"].to_pylist():
        blobs, at = [], 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            blobs.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        lengths = unpack(blobs[1], np.uint32).astype(np.int64)
        questions.append((np.repeat(unpack_sorted(blobs[0]), lengths), *(unpack(b, t) for b, t in zip(blobs[2:5], (np.uint64, np.uint32, np.uint64))), np.repeat(unpack(blobs[5], np.uint8), lengths)))
    group, second, local, seen, split = (np.concatenate(x) for x in zip(*questions))
    order = np.lexsort((second, group))
    group, second = group[order], second[order]
    fresh = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])) if len(group) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    totals = np.add.reduceat(local[order].astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    kind = np.cumsum(fresh) - 1
    owners = group[heads]
    edge = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(heads) else np.zeros(0, np.int64)
    contexts = owners[edge]
    mass = np.where(totals > 0, words.word_probability(seen[order][heads].astype(np.int64)), 0.0)
    columns = [(totals == r).astype(np.float64) for r in range(1, K + 1)] + [mass]
    stats = np.stack([np.add.reduceat(c, edge) if len(edge) else c for c in columns], axis=1)
    none_left = (stats[:, :K].sum(axis=1) == 0) & (split[order][heads][edge] == 0) if len(edge) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(heads))))
    marked = totals.astype(np.uint32) | np.where(none_left[owner] & (totals > 0), NO_MASS, np.uint32(0))
    answer = np.empty(len(order), np.uint32)
    answer[order] = marked[kind]
    part, rows, at = table["part"][0].as_py(), [], 0
    for chunk, asked, question in zip(table["chunk"].to_pylist(), table["extra"].to_pylist(), questions):
        keys = unpack_sorted(asked)
        place = np.minimum(np.searchsorted(contexts, keys), max(len(contexts) - 1, 0))
        found = stats[place] * (contexts[place] == keys)[:, None] if len(contexts) else np.zeros((len(keys), K + 1))
        rows.append((chunk, part, "pairs", pack(answer[at : at + len(question[0])]), pack(found), None))
        at += len(question[0])
    rows.append((None, part, "tally", None, None, counts_of_counts(totals)))
    return pa.Table.from_batches([_batch(rows, ANSWERS)])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(table: pa.Table, folder: str, parts: int, settings: Settings, words: Discounts, pairs: Discounts) -> pa.Table:
    """Scores the documents of a chunk: a pair's own probability, else the word's by the context's left-over weight."""
    kinds, part, data, more = (table[c].to_pylist() for c in ("kind", "part", "data", "more"))
    chunk = Stored(folder, table["chunk"][0].as_py(), parts)
    counts = chunk.words_of({p: d for k, p, d in zip(kinds, part, data) if k == "words"})
    chunk.pairs(counts, settings)
    marked, stats = np.zeros(len(chunk.first), np.uint32), np.zeros((len(chunk.asked), K + 1))
    answers = {p: (d, m) for k, p, d, m in zip(kinds, part, data, more) if k == "pairs"}
    for p, (a, b) in spans(chunk.pair_part, parts):
        marked[chunk.pair_order[a:b]] = unpack(answers[p][0], np.uint32)
    for p, (a, b) in spans(chunk.ask_part, parts):
        stats[chunk.ask_order[a:b]] = unpack(answers[p][1], np.float64).reshape(-1, K + 1)
    sums = np.zeros((len(chunk.hashes), K + 1))
    np.add.at(sums, chunk.asked, stats)
    total, bare = (marked & ~NO_MASS).astype(np.int64), marked >= NO_MASS
    bare |= (chunk.splits[chunk.first] > 1) & (sums[chunk.first, :K].sum(axis=1) == 0)
    context = counts[chunk.first]
    keep = pairs.factors()
    with np.errstate(divide="ignore", invalid="ignore"):
        own = keep[np.minimum(total, K + 1)] * total / np.where(bare, context + 1, context)
        # the weight of contexts: mass that discounts free, over the mass of words that never followed
        freed = (sums[:, :K] * (np.arange(1, K + 1) * (1 - keep[1 : K + 1]))).sum(axis=1) / counts
        freed = np.where(sums[:, :K].sum(axis=1) * (keep[1 : K + 1] < 1).any() > 0, freed, 0.0)
        freed = np.where(freed > 0, freed, 1 / (counts + 1))
        weight = np.where(counts > 0, freed / (1 - sums[:, K]), 1.0)
        backed = weight[chunk.first] * words.word_probability(counts[chunk.second])
        logs = np.log10(np.where(total > 0, own, backed))
    base = np.log10((counts + 0.1) / (words.total + 0.1 * (words.kinds + 1)))
    score = np.add.reduceat(logs[chunk.pair_of], chunk.starts)
    plain = np.add.reduceat(base[chunk.tokens], chunk.starts)
    known = np.add.reduceat((counts > 0).astype(np.int64)[chunk.tokens], chunk.starts)
    ids = pa.array(chunk.ids, mask=chunk.nulls)
    columns = [ids, pa.array(chunk.held), pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(known), words.total)), pa.array(plain), pa.array(score)]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])


def tallied(answers: DataFrame) -> Discounts:
    """Sums the tallies of all partitions, one short row each."""
    sums = [F.sum(F.get("tally", F.lit(i))).alias(f"n{i}") for i in range(K + 3)]
    return Discounts(tuple(int(x or 0) for x in answers.where("kind = 'tally'").agg(*sums).first()))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Words are runs of characters other than white space, A-Z lower-cased, and each text ends with
    one more token; the first word follows the end of another text. Training documents are those
    whose crc32(doc_id as text) mod 10 is not 0; a null doc_id counts as empty text, which is held
    out. A pair seen r times in training has its Good-Turing discounted share of its context; what
    the discounts free goes to the words that never followed, by their own discounted probability,
    and what single words leave is the probability of an unknown word, so that every context sums
    to 1. A context in which nothing is freed gives one part in its count and one more. Null and
    empty texts have the end alone. Repeated rows are documents each. An empty table has no rows.
    """
    spark = docs.sparkSession
    parts, folder = partitions(spark), scratch_dir(spark, "katz")
    make_folder(folder)
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    asked = rows.mapInArrow(partial(_read_documents, folder=folder, parts=parts, settings=settings), ROWS)
    words = parked(asked.groupBy("part").applyInArrow(_count_words, ANSWERS), "words")
    word_tally = tallied(words)
    own = words.where("kind = 'words'")
    asked = own.groupBy("chunk").applyInArrow(lambda t: _ask_pairs(t, folder, parts, settings), ROWS)
    pairs = parked(asked.groupBy("part").applyInArrow(lambda t: _count_pairs(t, word_tally), ANSWERS), "pairs")
    pair_tally = tallied(pairs)
    answers = own.unionByName(pairs.where("kind = 'pairs'"))
    return answers.groupBy("chunk").applyInArrow(lambda t: _score(t, folder, parts, settings, word_tally, pair_tally), SCORES)
