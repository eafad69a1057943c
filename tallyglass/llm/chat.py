"""Chat logs to training text: fold events into messages, render them with a loss mask, read them back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Marks of the template. In texts every "<" and "[" is followed by a backslash, so no mark can occur.
START, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])", r"$1\\")


def escape_role(role: Column) -> Column:
    """As a text; a line break becomes ``[n``, which no escaped text holds."""
    return F.replace(escape(role), F.lit("\n"), F.lit("[n"))


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def unescape_role(role: str) -> str:
    return unescape(role.replace("[n", "\n"))


def as_events(rows: DataFrame) -> DataFrame:
    """The event log that streaming the messages of ``rows`` (conv_id, turn, role, text) leaves.

    Messages come in order of turn, then role and text. An assistant's message is opened, drafted,
    regenerated and streamed in chunks; any other is opened, drafted and edited to its final text.
    Columns: conv_id, seq, message, kind, role, text.
    """
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).select(
        "conv_id", "role", "text", F.row_number().over(order).alias("message")
    )
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")),
        lambda i: F.struct(F.lit("delta").alias("kind"), F.substring("text", i * CHUNK + 1, F.lit(CHUNK)).alias("text")),
    )

    def event(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    draft = F.substring("text", 1, 16)
    log = F.when(
        F.col("role") == "assistant",
        F.concat(F.array(event("open", F.lit("")), event("delta", draft), event("regenerate", F.lit(""))), F.when(F.length("text") > 0, chunks).otherwise(F.array(event("delta", F.lit(""))))),
    ).otherwise(F.array(event("open", draft), event("edit", F.col("text"))))
    events = numbered.select("conv_id", "role", "message", F.posexplode(log).alias("step", "event"))
    seq = F.col("message").cast("long") * (1 << 32) + F.col("step")
    return events.select("conv_id", seq.alias("seq"), "message", "event.kind", "role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the opening), role, text.

    ``open``, ``edit`` and ``regenerate`` replace the text of a message, ``delta`` appends to it.
    The text is that of the last replacement and the deltas after it, in order of seq. Only the
    events of one message meet in a task, never those of a whole conversation. Null texts are
    empty; the role is that of the message's first event. Events equal in all columns fold once
    per row.
    """
    message = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(message)
    live = events.withColumn("_reset", reset).withColumn("_first", F.min("seq").over(message))
    used = F.coalesce(F.col("seq") >= F.col("_reset"), F.lit(True))
    parts = F.sort_array(F.collect_list(F.when(used, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    return live.groupBy("conv_id", "message").agg(
        F.first("_first").alias("seq"), F.min_by("role", "seq").alias("role"), parts.alias("parts")
    ).select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Formatted messages: conv_id, seq, formatted, loss_from, loss_to.

    The formatted text of a conversation is that of its messages one after the other. The loss
    mask covers code points [loss_from, loss_to) of a message: the escaped text of an assistant.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    start = F.length(head)
    masked = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "seq", F.concat(head, body, F.lit(END)).alias("formatted"),
        F.when(masked, start).otherwise(0).alias("loss_from"),
        F.when(masked, start + F.length(body)).otherwise(0).alias("loss_to"),
    )


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted message."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a formatted message")
    role, _, text = formatted[len(START) : -len(END)].partition("\n")
    return unescape_role(role), unescape(text)


SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted messages to one row per conversation; holds one message at a time."""
    current, begun, out = None, False, []

    def close() -> None:
        out.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for conv, formatted, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to"))):
            if not begun or conv != current:
                if begun:
                    close()
                current, begun = conv, True
                n, loss_chars, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = parse(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            learned = unescape(formatted[low:high])
            loss.update(learned.encode())
            n, loss_chars, chars = n + 1, loss_chars + len(learned), chars + len(formatted)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(SUMMARY.names, r)) for r in out], SUMMARY)
            out = []
    if begun:
        close()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(SUMMARY.names, r)) for r in out], SUMMARY)


def summarise(output: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted messages as read back.

    The digest of a conversation runs over its messages in order, so one task streams them; it
    holds one message at a time, however long the conversation is.
    """
    n = partitions(output.sparkSession)
    dealt = output.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(_digests, schema)
