"""Token ids in Simple-8b files: word-aligned blocks with offsets, written and read by tasks."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .files import Reader, make_folder, open_folder

#: Fixed values of the code: (values in a word, bits of each). The selector is the place in this list plus 1;
#: selector 0 is the escape: the whole next word is one value. Selector 15 is a run of 240 zeros.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ZEROS, RUN = 15, 240
MAGIC = b"TKS8B\x00\x00\x01"
SPACE_BYTES = {c: " " for c in range(9, 14)}
CONTROLS = "\x1c\x1d\x1e\x1f"
LATIN_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: How the tokenizers known here cut words, each class in brackets.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands behind the ids of each word; no token has it.
BREAK = np.uint32(0xFFFFFFFF)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    out = np.ones(len(values), np.uint8)
    for bits in range(1, 64):
        over = values >> np.uint64(bits) > 0
        if not over.any():
            break
        out += over
    return out


def encode(values: np.ndarray) -> np.ndarray:
    """Values below 2^64 as Simple-8b words: each word takes as many of the next values as fit."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    widths = _widths(values)
    # widest[i] of the next k values, by doubling
    spans, k = {1: widths}, 1
    while k < 32:
        w = spans[k]
        spans[2 * k] = np.maximum(w[: len(w) - k], w[k:]) if len(w) > k else w[:0]
        k *= 2
    selector = np.zeros(n, np.uint8)
    step = np.ones(n, np.uint8)
    for place in range(len(PACKS) - 1, -1, -1):
        count, bits = PACKS[place]
        if count > n:
            continue
        half = 1 << (count.bit_length() - 1)
        w = spans[half]
        widest = np.maximum(w[: n - count + 1], w[count - half : count - half + n - count + 1]) if half < count else w
        fits = widest[: n - count + 1] <= bits
        selector[: n - count + 1][fits] = place + 1
        step[: n - count + 1][fits] = count
    if not values.all():
        zero = values == 0
        reach = np.zeros(n + 1, np.int64)
        ends = np.flatnonzero(~zero)
        if len(ends) == 0 or n >= RUN:
            stop = np.append(ends, n)
            reach = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
            run = reach >= RUN
            selector[run], step[run] = ZEROS, RUN
    starts, i, steps = [], 0, step.tobytes()
    add = starts.append
    while i < n:
        add(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for place in np.unique(chosen):
        if place in (0, ZEROS):
            continue
        count, bits = PACKS[place - 1]
        rows = np.flatnonzero(chosen == place)
        first = starts[rows]
        packed = words[rows]
        for k in range(count):
            packed |= values[first + k] << np.uint64(k * bits)
        words[rows] = packed
    escaped = np.flatnonzero(chosen == 0)
    if len(escaped):
        words = np.insert(words, escaped + 1, values[starts[escaped]])
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """All values of Simple-8b words, selector by selector."""
    words = np.ascontiguousarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    plain = None
    if (chosen == 0).any():  # words after an escape are values; an escape may itself follow one
        plain, after = np.zeros(len(words), bool), False
        for i in np.flatnonzero(chosen == 0):
            after = i > 0 and plain[i]
            if not after and i + 1 < len(words):
                plain[i + 1] = True
    counts = np.array([1, *(c for c, _ in PACKS), RUN], np.int64)[chosen]
    if plain is not None:
        counts[plain] = 1
        counts[(chosen == 0) & ~plain] = 0
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for place, (count, bits) in enumerate(PACKS, 1):
        rows = chosen == place
        if plain is not None:
            rows &= ~plain
        rows = np.flatnonzero(rows)
        if not len(rows):
            continue
        first, packed, mask = starts[rows], words[rows], np.uint64((1 << bits) - 1)
        for k in range(count):
            out[first + k] = (packed >> np.uint64(k * bits)) & mask
    if plain is not None:
        out[starts[plain]] = words[plain]
    return out


class WordEncoder:
    """Encodes whole texts by the pieces of their distinct words and remembers pieces.

    For tokenizers that lower-case, drop white space and split at it, the ids of a text are those of its words,
    and the ids of a word those of the pieces that the tokenizer's own pattern cuts it into.
    The memory is bounded: it is emptied when it holds ``most`` pieces.
    """

    def __init__(self, file: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer, self.most, self.known = Tokenizer.from_file(file), most, {"\n": BREAK.tobytes()}
        pattern = piece_pattern(file)
        self.lean, self.pieces = Tokenizer.from_file(file), re.compile(f"{pattern or '[^\n]+'}|\n")
        if pattern:  # pieces are cut already
            self.lean.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        latin = "".join(map(chr, range(256))).lower().translate(dict.fromkeys(map(ord, LATIN_SPACE)))
        if self.lean.normalizer and self.lean.normalizer.normalize_str(latin) == latin:  # nothing left for it in lower-case words
            self.lean.normalizer = None
        suffix, vocab = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _learn(self, new: list[str], tokenizer) -> None:
        for start in range(0, len(new), 500):
            part = new[start : start + 500]
            found = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            edges = np.flatnonzero(self.last[ids]) + 1
            if tokenizer is self.lean and len(edges) == len(part):  # a piece has one last token
                edges = np.append(0, edges)
            else:
                begins = np.fromiter((x for x, _ in found.offsets), np.int64, len(ids))
                edges = np.searchsorted(begins, np.cumsum([0, *(len(w) + 1 for w in part)]))
            raw, edges = ids.tobytes(), (4 * edges).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, edges, edges[1:]))))

    def _known(self, found: list[str], tokenizer) -> np.ndarray:
        self._learn(list(set(found) - self.known.keys()), tokenizer)
        return np.frombuffer(b"".join(map(self.known.__getitem__, found)), np.uint32)

    def _ids(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words joined by line feeds, and where those of each word begin and end."""
        if len(self.known) > self.most:
            self.known = {"\n": self.known["\n"]}
        if lower_is_safe(joined):
            ids = self._known(self.pieces.findall(f"{joined.lower()}\n"), self.lean)
            ends = np.flatnonzero(ids == BREAK)
            return ids, np.append(0, ends[:-1] + 1), ends
        words = joined.split("\n")
        plain = np.fromiter(map(lower_is_safe, words), bool, len(words))
        odd = self._known([x for w in compress(words, ~plain) for x in (w, "\n")], self.tokenizer)
        ids, begins, ends = self._ids("\n".join(compress(words, plain))) if plain.any() else (odd[:0], 0, 0)
        breaks = len(ids) + np.flatnonzero(odd == BREAK)
        low, high = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        low[plain], high[plain] = begins, ends
        low[~plain], high[~plain] = np.append(len(ids), breaks[:-1] + 1), breaks
        return np.concatenate([ids, odd]), low, high

    @staticmethod
    def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of texts, and how many each text has."""
        if pc.any(pc.match_substring_regex(texts, f"[{CONTROLS}]")).as_py():  # Arrow takes them for white space, tokenizers do not
            split = pa.array([t.translate(SPACE_BYTES).split(" ") for t in texts.to_pylist()], pa.list_(texts.type))
        else:
            split = pc.utf8_split_whitespace(texts)
        return split.flatten(), pc.list_value_length(split).to_numpy()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has. Nulls have none."""
        words, counts = self.split(pc.fill_null(texts, ""))
        coded = words.dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
        ids, low, high = self._ids(pc.binary_join(distinct, "\n")[0].as_py())
        codes = coded.indices.to_numpy()
        sizes = (high - low)[codes]
        sums = np.append(0, np.cumsum(sizes))
        out = ids[np.repeat(low[codes] - sums[:-1], sizes) + np.arange(sums[-1])]
        return out, np.diff(sums[np.append(0, np.cumsum(counts))])


def piece_pattern(file: str) -> str | None:
    """A pattern of the pieces that a tokenizer cuts Latin-1 words into, if it cuts them by ``CUT`` and encodes their bytes."""
    with open(file, encoding="utf-8") as source:
        steps = (json.load(source)["pre_tokenizer"] or {}).get("pretokenizers") or []
    by_cut = {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True}
    if len(steps) != 2 or steps[0] != by_cut or steps[1]["type"] != "ByteLevel" or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(256))}
    letters, numbers = ("".join(c for c in kinds if kinds[c] == kind) for kind in "LN")
    return CUT.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", LATIN_SPACE)


def lower_is_safe(text: str) -> bool:
    """Whether lower case leaves the ids of a lower-casing tokenizer alone: plain Latin-1 without special tokens."""
    if "<|" in text:
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_encoder(file: str) -> WordEncoder:
    """One for each worker process, whose tasks share its memory of words."""
    return WordEncoder(file)


def spans(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, one row at least."""
    sums = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(sums):
        before = sums[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sums, before + size, "right")))
        yield low, high
        low = high


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, block: int, file_ids: int) -> Iterator[pa.RecordBatch]:
    """Files of this attempt alone: blocks, then the footer with the block and document tables, its size and the magic."""
    system, plain = open_folder(folder)
    encoder = word_encoder(tokenizer)
    task = TaskContext.get().partitionId()
    state: dict = {"sink": None}

    def begin() -> None:
        name = f"part-{task:05d}-{uuid.uuid4().hex}.tks"
        state.update(name=name, sink=system.open_output_stream(f"{plain}/{name}"), offset=len(MAGIC), offsets=[], docs=[], sizes=[], pending=[], waiting=0, ids=0)
        state["sink"].write(MAGIC)

    def flush(all_of_it: bool) -> None:
        data = np.concatenate(state["pending"]) if state["pending"] else np.zeros(0, np.uint32)
        stop = len(data) if all_of_it else len(data) // block * block
        for i in range(0, stop, block):
            raw = encode(data[i : i + block]).tobytes()
            state["offsets"].append(state["offset"])
            state["sink"].write(raw)
            state["offset"] += len(raw)
        rest = data[stop:]
        state.update(pending=[rest] if len(rest) else [], waiting=len(rest))

    def close() -> list[tuple]:
        flush(True)
        offsets = np.array([*state["offsets"], state["offset"]], np.int64)
        ids, sizes = np.array(state["docs"], np.int64), np.array(state["sizes"], np.int64)
        tail = offsets.tobytes() + ids.tobytes() + sizes.tobytes()
        head = json.dumps({"block": block, "ids": state["ids"], "blocks": len(offsets) - 1, "docs": len(ids)}).encode()
        state["sink"].write(tail + head + len(head).to_bytes(8, "little") + MAGIC)
        state["sink"].close()
        state["sink"] = None
        size = state["offset"] + len(tail) + len(head) + 8 + len(MAGIC)
        return [(task, state["seq"], state["name"], size, state["ids"], len(ids))]

    state["seq"] = 0
    done: list[tuple] = []
    for batch in batches:
        keys, texts = batch.column(0).fill_null(-1).to_pylist(), batch.column(1)
        for low, high in spans(texts):
            ids, sizes = encoder.encode_column(texts.slice(low, high - low))
            ends = np.cumsum(sizes)
            ids, sizes, ends = np.insert(ids, ends, end_id), sizes + 1, np.append(0, ends + np.arange(1, len(ends) + 1))
            at = 0
            while at < len(sizes):
                if state["sink"] is None:
                    begin()
                stop = min(int(np.searchsorted(ends, ends[at] + file_ids - state["ids"])), len(sizes))
                state["docs"] += keys[low + at : low + stop]
                state["sizes"] += sizes[at:stop].tolist()
                state["pending"].append(ids[ends[at] : ends[stop]])
                state["waiting"] += int(ends[stop] - ends[at])
                state["ids"] += int(ends[stop] - ends[at])
                at = stop
                if state["waiting"] >= 8 * block:
                    flush(False)
                if state["ids"] >= file_ids:
                    done += close()
                    state["seq"] += 1
    if state["sink"] is not None:
        done += close()
    if done:
        columns = list(zip(*done))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2]), *(pa.array(c, pa.int64()) for c in columns[3:])], names=["task", "seq", "file", "bytes", "ids", "docs"])


MANIFEST = "task int, seq int, file string, bytes long, ids long, docs long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", block: int = 1 << 15, file_ids: int = 16 << 20) -> DataFrame:
    """Encodes every whole text and writes the ids, in ascending order of ``key``, as Simple-8b files.

    The documents are dealt to tasks by ranges of the key and sorted there, so that the files, in
    order of (task, seq), hold the ids in order. Each document ends with ``end_id``. Null and empty
    texts give the end id alone; a null key comes first and is stored as -1; equal keys stay side by
    side, in order of their texts. Returns the manifest of the files, a Parquet table in ``folder``.
    """
    make_folder(f"{folder}/tokens")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text")
    work = partial(_write, folder=f"{folder}/tokens", tokenizer=tokenizer, end_id=end_id, block=block, file_ids=file_ids)
    dealt.mapInArrow(work, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_footer(reader: Reader, name: str, size: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Header, block offsets, document keys and id counts of a file."""
    end = reader.read(name, size - 16, 16)
    if end[8:] != MAGIC:
        raise ValueError(f"{name} is not whole")
    n = int.from_bytes(end[:8], "little")
    head = json.loads(reader.read(name, size - 16 - n, n))
    length = 8 * (head["blocks"] + 1 + 2 * head["docs"])
    tail = np.frombuffer(reader.read(name, size - 16 - n - length, length), np.int64)
    cut = head["blocks"] + 1
    return head, tail[:cut], tail[cut : cut + head["docs"]], tail[cut + head["docs"] :]


def _read(batches: Iterator[pa.RecordBatch], folder: str, group: int) -> Iterator[pa.RecordBatch]:
    reader = Reader(folder)
    for batch in batches:
        for name, size, base in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "base"))):
            head, offsets, keys, sizes = read_footer(reader, name, size)
            sums, starts = [], np.cumsum(sizes) - sizes
            have, low, at_block = np.zeros(0, np.uint32), 0, 0  # ids from place low on
            crc, left, doc = 0, int(sizes[0]) if len(sizes) else 0, 0
            while at_block < head["blocks"]:
                stop = min(at_block + group, head["blocks"])
                raw = reader.read(name, int(offsets[at_block]), int(offsets[stop] - offsets[at_block]))
                data = decode(np.frombuffer(raw, np.uint64)).astype("<u4")
                at_block, place, view = stop, 0, memoryview(data).cast("B")
                while place < len(data):
                    take = min(left, len(data) - place)
                    crc = zlib.crc32(view[4 * place : 4 * (place + take)], crc)
                    place, left = place + take, left - take
                    if not left:
                        sums.append(crc)
                        doc += 1
                        crc, left = 0, int(sizes[doc]) if doc < len(sizes) else 0
            if len(sums) != len(keys):
                raise ValueError(f"{name} holds {len(sums)} of {len(keys)} documents")
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, mask=keys < 0) if (keys < 0).any() else pa.array(keys), pa.array(starts + base), pa.array(sizes), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
    reader.close()


def read_tokens(manifest: DataFrame, folder: str, group: int = 8) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the ids of the files before; the manifest has one row for each file. A task
    decodes ``group`` blocks at once.
    """
    from pyspark.sql import Window

    earlier = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    work = partial(_read, folder=f"{folder}/tokens", group=group)
    dealt = files.select("file", "bytes", "base").repartition(partitions(manifest.sparkSession), "file")
    return dealt.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
