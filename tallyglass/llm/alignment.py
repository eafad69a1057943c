"""Alignment of two tokenizers by products of token-byte incidence matrices."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parked, private_names

#: Characters that the second tokenizer uses for a space; fixed by its format.
BLANK = "▁"
#: A chunk ends where a space or line break follows another character: neither tokenizer joins across.
CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


@dataclass(frozen=True)
class Csr:
    """Sparse rows: the entries of row i lie from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of_places(cls, columns: np.ndarray, width: int) -> Csr:
        """One entry of 1 in each row."""
        return cls(np.arange(len(columns) + 1), columns, np.ones(len(columns), np.int8), width)

    def turned(self) -> Csr:
        """The transpose, by counting entries per column."""
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        starts = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))]
        return Csr(starts, rows[order], self.values[order], self.height)


def row_products(left: Csr, right: Csr, rows: int = 1 << 16) -> Csr:
    """Product of two sparse matrices, row by row (Gustavson): each entry of a left row adds a multiple of a right row.

    Blocks of ``rows`` left rows are expanded at once, and equal columns of a row summed.
    """
    counts, columns, values = [np.zeros(1, np.int64)], [], []
    lengths = np.diff(right.starts)
    for low in range(0, left.height, rows):
        high = min(low + rows, left.height)
        inner = slice(left.starts[low], left.starts[high])
        row = np.repeat(np.arange(high - low), np.diff(left.starts[low : high + 1]))
        middle = left.columns[inner]
        take = lengths[middle]
        first = np.repeat(right.starts[middle] - (np.cumsum(take) - take), take)
        at = first + np.arange(take.sum())
        place = np.repeat(row, take) * right.width + right.columns[at]
        amount = np.repeat(left.values[inner], take).astype(np.int64) * right.values[at]
        if (np.diff(place) < 0).any():
            order = np.argsort(place, kind="stable")
            place, amount = place[order], amount[order]
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
        columns.append(place[heads] % right.width)
        values.append(np.add.reduceat(amount, heads, dtype=np.int64) if len(heads) else amount)
        counts.append(np.bincount(place[heads] // right.width, minlength=high - low))
    whole = np.concatenate
    return Csr(np.cumsum(whole(counts)), whole([np.zeros(0, np.int64), *columns]), whole([np.zeros(0, np.int64), *values]), right.width)


class Alphabet:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""

    def __init__(self) -> None:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def decoded(self, entry: str) -> bytes:
        return bytes(self.byte[c] for c in entry)


class Tokenizers:
    """Both tokenizers of a task, with the length in bytes and the bytes of every id."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        alphabet = Alphabet()
        special = {t["id"] for t in json.loads(self.a.to_str())["added_tokens"]}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = entry.encode() if i in special else alphabet.decoded(entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(BLANK)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def one(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of both for a chunk, which begins with a space or line break.

        The second tokenizer puts a space before every text: it stands for that of the chunk, or is dropped
        again before a line break.
        """
        a = self.a.encode(chunk, add_special_tokens=False).ids
        b = self.b.encode(chunk[1:] if chunk[0] == " " else chunk)
        return a, (b or [self.blank]) if chunk[0] == " " else b[1:]

    def counted(self, ids: list[int], sides: list[bytes], sizes: np.ndarray, raw: bytes, ends: np.ndarray) -> np.ndarray | None:
        """How many of the ids of joined chunks belong to each; None if they do not give back all bytes."""
        if b"".join([sides[i] for i in ids]) != raw:
            return None
        at = np.searchsorted(np.cumsum(sizes[np.array(ids, np.int64)]), ends, "right")
        return np.diff(at, prepend=0)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids and counts per chunk of the first, of the second, whether a chunk's bytes are whole).

        Chunks that end in a word are joined to long texts, which encode faster than many short ones and
        give the same ids.
        """
        ids: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        whole: list[bool] = []
        low = 0
        while low < len(chunks):
            high, length = low, 0
            while high < len(chunks) and length < 1 << 14 and not chunks[high][-1].isspace():
                length += len(chunks[high])
                high += 1
            found = self.joined(chunks[low:high]) if high > low else None
            if found is None:
                high = max(high, low + 1)
                found = self.apart(chunks[low:high])
            for side in (0, 1):
                ids[side].append(np.array(found[side], np.int64))
                counts[side].append(found[2 + side])
            whole += found[4]
            low = high
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (*ids, *counts)]
        return flat[0], flat[2], flat[1], flat[3], np.array(whole, bool)

    def joined(self, chunks: list[str]) -> tuple | None:
        text = "".join(chunks)
        raw = text.encode("utf-8", "surrogatepass")
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        a, b = self.one(text)
        n_a, n_b = self.counted(a, self.a_bytes, self.a_sizes, raw, ends), self.counted(b, self.b_bytes, self.b_sizes, raw, ends)
        return None if n_a is None or n_b is None else (a, b, n_a, n_b, [True] * len(chunks))

    def apart(self, chunks: list[str]) -> tuple:
        pairs = [self.one(c) for c in chunks]
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        whole = [b"".join([self.a_bytes[i] for i in a]) == r == b"".join([self.b_bytes[i] for i in b]) for (a, b), r in zip(pairs, raw)]
        pairs = [p if ok else ([], []) for p, ok in zip(pairs, whole)]
        sides = [[i for p in pairs for i in p[k]] for k in (0, 1)]
        return (*sides, *(np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1)), whole)


class Aligned:
    """Alignment of a list of chunks: for each chunk tokens, groups, links, and its groups as text."""

    def __init__(self, tokenizers: Tokenizers, chunks: list[str]):
        a_ids, self.n_a, b_ids, self.n_b, self.whole = tokenizers.encode(chunks)
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[a_ids]), np.cumsum(tokenizers.b_sizes[b_ids])
        total = int(a_ends[-1]) if len(a_ends) else 0
        a_byte = Csr(np.r_[0, a_ends], np.arange(total), np.ones(total, np.int8), total)
        b_byte = Csr(np.r_[0, b_ends], np.arange(total), np.ones(total, np.int8), total)
        overlap = row_products(a_byte, b_byte.turned())
        both = np.zeros(total + 1, np.int8)
        both[a_ends] += 1
        both[b_ends] += 1
        cuts = np.flatnonzero(both == 2)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        shared = row_products(Csr.of_places(a_group, len(cuts)), Csr.of_places(b_group, len(cuts)).turned())
        owner = np.repeat(np.arange(len(chunks)), self.n_a)
        count = lambda of: np.bincount(of, minlength=len(chunks))
        row = np.repeat(np.arange(overlap.height), np.diff(overlap.starts))
        #: Links of chunk i: pairs from links[i] to links[i + 1].
        self.pairs = a_ids[row] << 32 | b_ids[overlap.columns]
        self.n_links = count(owner[row])
        self.links = np.r_[0, np.cumsum(self.n_links)]
        self.n_shared = count(owner[np.repeat(np.arange(shared.height), np.diff(shared.starts))])
        last = np.r_[a_group[1:] != a_group[:-1], True] if len(a_group) else np.zeros(0, bool)
        self.n_groups = count(owner[last])
        self.text = self.groups(a_ids, b_ids, a_group, b_group)

    def groups(self, a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
        """The groups of every chunk: ids apart by commas, the two sides by a bar, groups by semicolons."""
        place = np.r_[2 * a_group, 2 * b_group + 1]  # by group, then side; groups of chunks follow each other
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.r_[a_ids, b_ids][order]
        before = np.diff(place, prepend=-2)
        marks = np.where(before == 0, 0, np.where(place & 1 == 1, 1, 2)).tolist()
        tokens = [",|;"[m] + t for m, t in zip(marks, map(str, ids.tolist()))]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(tokens[low:high])[1:] for low, high in zip([0, *ends[:-1]], ends)]


#: A row is a document (row, sums, codes and times of its pairs) or a pair of the part (code, pair, times).
PARTS = "part long, kind int, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, codes binary, times binary, code int, pair long, times_in_part long, key "


def _aligned(batches: Iterator[pa.RecordBatch], first: str, second: str, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tokenizers, task = Tokenizers(first, second), TaskContext.get().partitionId()
    seq, keys, texts, filled = 0, [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        part = task << 32 | seq
        known: dict[str, int] = {}
        lists = []
        for text in texts:
            plain = text and BLANK not in text
            lists.append([known.setdefault(c, len(known)) for c in CHUNK.findall(" " + text)] if plain else [])
        found = Aligned(tokenizers, list(known))
        pairs, code = np.unique(found.pairs, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        rows: dict[str, list] = {n: [] for n in ("key", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "codes", "times")}
        for key, chunks in zip(keys, lists):
            of = np.array(chunks, np.int64)
            if not len(of) or not found.whole[of].all():
                sums, digest, own, times = [0] * 5, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                sums = [int(v[of].sum()) for v in (found.n_a, found.n_b, found.n_groups, found.n_links, found.n_shared)]
                digest = hashlib.sha256(";".join([found.text[c] for c in chunks]).encode()).hexdigest()
                take = found.n_links[of]
                at = np.repeat(found.links[of] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                own, times = np.unique(code[at], return_counts=True)
                counts[own] += times
            for name, value in zip(rows, (key, *sums, digest, own.astype("<i4").tobytes(), times.astype("<i4").tobytes())):
                rows[name].append(value)
        met = np.flatnonzero(counts)
        yield _rows(schema, len(keys), rows | {"part": [part] * len(keys), "kind": [0] * len(keys)})
        yield _rows(schema, len(met), {"part": np.full(len(met), part), "kind": np.ones(len(met), np.int32), "code": met.astype(np.int32), "pair": pairs[met], "times_in_part": counts[met]})

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(text or "")
            filled += len(texts[-1])
            if filled >= size:
                yield from flush()
                seq, keys, texts, filled = seq + 1, [], [], 0
    if keys:
        yield from flush()


def _rows(schema: pa.Schema, height: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(height, f.type) for f in schema], schema=schema)


def _summed(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Adds up the corpus-wide counts of the pairs of every document of a part."""
    codes, totals, best = (pairs.column(c).to_numpy() for c in ("code", "total", "best"))
    size = int(codes.max()) + 1 if len(codes) else 0
    by_code, is_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    by_code[codes], is_best[codes] = totals, best
    sums, bests = [], []
    for own, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist()):
        own, times = np.frombuffer(own, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
        sums.append(int((by_code[own] * times).sum()))
        bests.append(int((is_best[own] * times).sum()))
    out = docs.drop_columns(["part", "codes", "times"])
    return out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", block: int = 4 << 20) -> DataFrame:
    """Token groups and links of two tokenizers for every whole text.

    ``first`` is a byte-level tokenizer file, ``second`` a piece model; the first encodes a space and the text,
    the second puts its own space before it. Tasks take texts in blocks of ``block`` characters, split them
    where neither tokenizer can join, encode each different chunk once and align it: the product of the
    token-byte matrices gives the overlap links, that of the token-group matrices the links of one group.
    Pairs are counted per block, summed by shuffle and sent back to the blocks that hold them; no task
    holds the pairs of more than one block. Returns ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum``, ``groups_sha256`` and ``n_shared`` (pairs of tokens of one group).

    Null and empty texts, texts that hold the second tokenizer's blank sign and others whose tokens do not give
    back all bytes have no tokens: zeros and an empty digest. Null, repeated and equal rows are
    rows of their own. Other columns are ignored; an output column that clashes with ``key`` gets an underscore.
    An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[key].dataType
    schema = PARTS + kind.simpleString()
    spark = docs.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    parts = parked(rows.mapInArrow(partial(_aligned, first=first, second=second, size=block, schema=arrow), schema), "alignment")
    pairs = parts.where("kind = 1").select("part", "code", "pair", "times_in_part")
    totals = pairs.groupBy("pair").agg(F.sum("times_in_part").alias("total")).withColumn("b", F.expr("pair & 4294967295"))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    judged = parked(totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best")), "pairs")
    answers = pairs.drop("times_in_part").join(judged, "pair").select(F.col("part").alias("part"), "code", "total", "best")  # a column of its own
    names = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"]
    held = parts.where("kind = 0").select("part", "key", *names, "codes", "times")
    out = "key {}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, n_best long, count_sum long".format(kind.simpleString())
    summed = held.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_summed, out)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
    return summed.select(F.col("key").alias(key), *(F.col(n).alias(m) for n, m in zip(order, private_names([key], *order))))
