"""WARC archives with an index: one response for each payload, revisits for its repeats, range reads."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import partitions
from .files import Reader, make_folder, open_folder

MIN_SHARED = 100
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "2020-01-01T00:00:00Z"


def plan_records(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_digest, record_type and refers_to to page_id, url and html.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is the
    response; rows that repeat this page_id are responses too, and so are pages whose page_id is
    null. A null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= MIN_SHARED
    first = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").drop("_n").withColumnRenamed("payload_digest", "_digest")
    joined = rows.join(first, (F.col("payload_digest") == F.col("_digest")) & large, "left")
    again = F.col("page_id") > F.col("_first")
    return joined.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the length of the full payload, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    block = http
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of a record; checks the lengths, and the digest of a payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")

    def page(name: str):
        value = fields.get(name, "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(value) if value else None

    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {
        "page_id": page("WARC-Record-ID"), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Writes gzip members to files of this attempt alone; only its committed rows name them."""
    system, plain = open_folder(folder)
    sink, name, offset = None, None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if sink is None:
                name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                sink, offset = system.open_output_stream(f"{plain}/{name}", compression=None), 0
            data = gzip.compress(
                record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"]), 4, mtime=0
            )
            sink.write(data)
            out.append({k: row.get(k) for k in schema.names} | {"file": name, "offset": offset, "length": len(data)})
            offset += len(data)
            if offset >= file_bytes:
                sink.close()
                sink = None
        yield pa.RecordBatch.from_pylist(out, schema)
    if sink is not None:
        sink.close()


def write_archives(records: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes planned records to WARC files in ``folder`` and their index beside them; returns the index.

    A file holds about ``file_bytes``. The index (file, offset, length, page_id, url,
    payload_digest, record_type) is a Parquet table.
    """
    spark = records.sparkSession
    make_folder(f"{folder}/warc")
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])
    work = partial(_write, folder=f"{folder}/warc", file_bytes=file_bytes, schema=schema)
    records.mapInArrow(work, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema, keep_payload: bool) -> Iterator[pa.RecordBatch]:
    reader = Reader(folder)
    for batch in batches:
        for name, low, high, places in zip(*(batch.column(c).to_pylist() for c in ("file", "low", "high", "places"))):
            data = reader.read(name, low, high - low)
            out = []
            for place in places:
                start = place["offset"] - low
                row = parse_record(gzip.decompress(data[start : start + place["length"]]))
                out.append(row if keep_payload else row | {"payload": None})
            yield pa.RecordBatch.from_pylist(out, schema)
    reader.close()


def read_records(index: DataFrame, folder: str, range_bytes: int = 4 << 20, gap: int = 64 << 10, keep_payload: bool = True) -> DataFrame:
    """Reads the records of selected index rows.

    The rows of a file are sorted by offset; neighbours less than ``gap`` apart share one read, and
    a read covers ``range_bytes`` and one record at most. Files are bounded, and so is what one
    window or one read holds.
    """
    spark = index.sparkSession
    file = Window.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(file)
    piece = F.floor(F.col("offset") / range_bytes)
    cut = F.coalesce((F.col("offset") - end > gap) | (piece != F.lag(piece).over(file)), F.lit(True))
    ranges = (
        index.select("file", "offset", "length", cut.cast("int").alias("_cut"))
        .withColumn("_range", F.sum("_cut").over(file))
        .groupBy("file", "_range")
        .agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("length")).alias("high"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    )
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in PAGES.split(", "))])
    work = partial(_read, folder=f"{folder}/warc", schema=schema, keep_payload=keep_payload)
    return ranges.select("file", "low", "high", "places").repartition(partitions(spark), "file", "low").mapInArrow(work, PAGES)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Writes the pages to archives in a new scratch folder; returns the index and the folder."""
    folder = scratch_dir(pages.sparkSession, "archives")
    return write_archives(plan_records(pages), folder), folder
