"""Tail of growing log files as a stream: each offset holds the identity and the byte reached of every file.

A file is known by the digest of its first bytes, not by its name, so that a renamed file is read on
where it was left, and a new file of an old name from its start. Records begin with ``[`` at the
start of a line. The last record of a file waits until another one follows, until the file has not grown
between two looks, or until another file of its folder has taken its name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = 256
CHUNK = 1 << 20
SCHEMA = "value string, file_name string, start long"
ARCHIVES = (".gz", ".bz2", ".zip")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local or mounted."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


class Files:
    """The log files below a folder: ``base`` itself, or with its rotated names, or all files."""

    def __init__(self, path: str, base: str | None):
        self.system, self.path = opened(path)
        self.base = base

    def mine(self, name: str) -> bool:
        if name.startswith((".", "_")) or name.lower().endswith(ARCHIVES):
            return False
        return not self.base or name == self.base or name.startswith((f"{self.base}.", f"{self.base}-"))

    def sizes(self) -> dict[str, int]:
        found = self.system.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and self.mine(f.base_name) and f.size}

    def read(self, name: str, low: int, high: int) -> bytes:
        with self.system.open_input_file(name) as file:
            return file.read_at(high - low, low)

    def digest(self, name: str, length: int) -> str | None:
        try:
            data = self.read(name, 0, length)
        except FileNotFoundError:
            return None
        return hashlib.sha256(data).hexdigest() if len(data) == length else None

    def is_same(self, entry: dict, name: str) -> bool:
        return self.digest(name, entry["head"]) == entry["digest"]

    def last_record(self, name: str, low: int, high: int) -> int:
        """Where the last record begins that starts behind ``low``, or ``low``."""
        end = high
        while end > low:
            begin = max(low, end - CHUNK)
            at = self.read(name, begin, min(end + 1, high)).rfind(b"\n[")
            if at >= 0:
                return begin + at + 1
            end = begin
        return low

    def look(self, known: list[dict]) -> list[dict]:
        """The entries of all files as they are now; ``known`` are those of the last look.

        An entry: name, key, head and digest (of how many first bytes), byte (read up to), size (seen).
        """
        sizes = self.sizes()
        rest, out = dict(sizes), []
        pairs: list[tuple[dict, str]] = []

        def pair(entry: dict, name: str) -> None:
            pairs.append((entry, name))
            rest.pop(name)

        waiting = []
        for entry in known:
            name = entry["name"]
            if name in rest and rest[name] >= entry["byte"] and self.is_same(entry, name):
                pair(entry, name)
            else:
                waiting.append(entry)
        for entry in waiting:  # renamed, or copied before it was emptied
            name = next((n for n in sorted(rest) if rest[n] >= entry["byte"] and self.is_same(entry, n)), None)
            if name:
                pair(entry, name)
        for entry, name in pairs:
            size = sizes[name]
            whole = size == entry["size"] or name != entry["name"]
            head = min(HEAD, size)
            byte = size if whole else max(entry["byte"], self.last_record(name, entry["byte"], size))
            out.append({"name": name, "key": entry["key"], "head": head, "digest": self.digest(name, head), "byte": byte, "size": size})
        keys = {e["key"] for e in out} | {e["key"] for e in known}
        for name in sorted(rest):
            fresh = self.entry(name, rest[name])
            while fresh["key"] in keys:  # another file with the same first bytes, or an old name used again
                fresh["key"] += "+"
            keys.add(fresh["key"])
            out.append(fresh)
        return sorted((e for e in out if e["digest"]), key=lambda e: (e["name"], e["key"]))

    def entry(self, name: str, size: int) -> dict:
        head = min(HEAD, size)
        digest = self.digest(name, head)
        return {"name": name, "key": str(digest), "head": head, "digest": digest, "byte": self.last_record(name, 0, size), "size": size}

    def find(self, name: str, head: int, digest: str) -> str:
        """The present name of a file that may have been renamed since the offset was written."""
        for candidate in [name, *sorted(self.sizes())]:
            if self.digest(candidate, head) == digest:
                return candidate
        raise FileNotFoundError(f"{name} is gone before its bytes were read")


class Range(InputPartition):
    """Records of a file that begin in [low, high); the range as a whole ends at ``end``."""

    def __init__(self, name: str, head: int, digest: str, first: int, low: int, high: int, end: int):
        self.name, self.head, self.digest = name, head, digest
        self.first, self.low, self.high, self.end = first, low, high, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.planned: list[dict] | None = None

    def files(self) -> Files:
        return Files(self.options["path"], self.options.get("base"))

    def initialOffset(self) -> dict:
        return {"files": "[]"}

    def latestOffset(self) -> dict:
        if self.planned is None:  # a new run: Spark does not say here where the last one ended
            self.planned = json.loads(recalled(self.options["memory"]) or "[]")
        return {"files": json.dumps(self.files().look(self.planned), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        remember(self.options["memory"], end["files"])  # the offset log has it already; a crash before this line replans the batch
        self.planned = json.loads(end["files"])
        before = {e["key"]: e["byte"] for e in json.loads(start["files"])}
        size = int(self.options.get("split", 64 << 20))
        out = []
        for e in self.planned:
            first = before.get(e["key"], 0)
            for low in range(first, e["byte"], size):
                out.append(Range(e["name"], e["head"], e["digest"], first, low, min(low + size, e["byte"]), e["byte"]))
        return out or [Range("", 0, "", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.low >= part.high:
            return
        files = self.files()
        name = files.find(part.name, part.head, part.digest)
        values, starts, filled = [], [], 0
        for start, record in records(files, name, part):
            values.append(record.decode("utf-8", "replace"))
            starts.append(start)
            filled += len(record)
            if filled >= 4 * CHUNK:
                yield batch_of(values, starts, name)
                values, starts, filled = [], [], 0
        if values:
            yield batch_of(values, starts, name)


def batch_of(values: list[str], starts: list[int], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values), pa.array([name.rpartition("/")[2]] * len(values)), pa.array(starts, pa.int64())], names=["value", "file_name", "start"])


def records(files: Files, name: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, text) of the records that begin in a range; one may reach beyond its high end.

    Text before the first record of a file belongs to none.
    """
    offset = part.low - 1 if part.low > part.first else part.low  # the line break before a record tells that it is one
    held, base, record, seek = b"", offset, -1, 0
    while True:
        data = files.read(name, offset, min(offset + CHUNK, part.end)) if offset < part.end else b""
        if record < 0 and base == part.low and data[:1] == b"[" and not held:
            record = 0
        held, offset = held + data, offset + len(data)
        while (at := held.find(b"\n[", seek)) >= 0:
            if record >= 0:
                yield base + record, held[record:at].rstrip(b"\r\n")
            record = seek = at + 1
            if base + record >= part.high:
                return
        if not data:
            if record >= 0:
                yield base + record, held[record:].rstrip(b"\r\n")
            return
        if record < 0 and offset > part.high:
            return
        keep = record if record >= 0 else len(held) - 1
        held, base, record, seek = held[keep:], base + keep, min(record, 0), max(0, len(held) - 1 - keep)


def recalled(folder: str) -> str | None:
    """What :func:`remember` has last written."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    for file in sorted((f for f in found if f.base_name.endswith(".json")), key=lambda f: f.base_name, reverse=True):
        with system.open_input_stream(file.path) as stream:
            text = stream.read().decode()
        if text.endswith("\n"):  # written to its end
            return text
    return None


def remember(folder: str, text: str) -> None:
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".json"))
    number = int(names[-1].split(".")[0]) + 1 if names else 0
    with system.open_output_stream(f"{path}/{number:012d}.json") as file:
        file.write(text.encode() + b"\n")
    for name in names[:-1]:
        system.delete_file(f"{path}/{name}")


class LogTail(DataSource):
    """Options: ``path`` (folder), ``base`` (log name; else all files), ``split`` (bytes a task), ``memory`` (folder of the last look)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_bytes(spark: SparkSession, path: str, memory: str, base: str | None = None, split: int = 64 << 20) -> DataFrame:
    """Records of growing logs below ``path`` as they are completed; no byte is read twice, none is left out.

    ``memory`` names a folder beside the checkpoint: what the last planned batch had seen of every file.
    Text written after a record was taken for whole, when its file had not grown between two looks, belongs to no record.
    """
    spark.dataSource.register(LogTail)
    stream = spark.readStream.format("log_tail").option("path", path).option("memory", memory).option("split", str(split))
    return (stream.option("base", base) if base else stream).load()
