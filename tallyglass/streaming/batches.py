"""Replay-safe micro-batch outputs.

Every batch owns one ``batch=<id>`` partition of each table it writes. A batch that
runs again after a failure replaces its own partition, so nothing is counted twice,
and readers combine the partitions. No table is read and rewritten in place.

A :class:`Folded` table also holds layers: each folds a range of finished batches into few files, so that
readers open the layers and the few batches after them, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.folders import drop_folder, folder_exists, folder_names


def put(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def get(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All partitions, or none where no batch has written yet."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    if not folder_exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes everything available, then stops; the checkpoint carries on next time."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class Folded:
    """Deltas of batches under ``delta``, and layers that fold ranges of them under ``layers``.

    ``fold`` combines rows of several batches, in any grouping (sums, newest per key, or all rows as they
    are). ``by`` partitions the layers, as by day, so that a reader's filter on it prunes them. A layer counts
    once it is whole; until then, and after a failure, readers see the deltas instead.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, fold: Callable[[DataFrame], DataFrame], by: str | None = None):
        self.spark, self.path, self.schema, self.fold, self.by = spark, path.rstrip("/"), schema, fold, by

    def put(self, rows: DataFrame, batch_id: int) -> None:
        put(rows.select(self.schema.names), f"{self.path}/delta", batch_id)

    def batches(self) -> list[int]:
        names = folder_names(self.spark, f"{self.path}/delta")
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def layers(self) -> list[tuple[int, int]]:
        """(first, last) of the whole layers that readers use: from batch 0 on, the longest first."""
        ranges = []
        for name in folder_names(self.spark, f"{self.path}/layers"):
            if folder_exists(self.spark, f"{self.path}/layers/{name}/_SUCCESS"):
                first, last = name.split("-")
                ranges.append((int(first), int(last)))
        used, at = [], 0
        while found := [r for r in ranges if r[0] == at]:
            used.append(max(found))
            at = used[-1][1] + 1
        return used

    def _layer(self, first: int, last: int) -> str:
        return f"{self.path}/layers/{first:012d}-{last:012d}"

    def rows(self, first: int = 0, last: int | None = None) -> DataFrame:
        """What layers and deltas hold of the batches from ``first`` to ``last``, not folded across them."""
        names = self.schema.names
        out = self.spark.createDataFrame([], self.schema)
        at = first
        for low, high in self.layers():
            if low >= first and (last is None or high <= last):
                out = out.unionByName(self.spark.read.schema(self.schema).parquet(self._layer(low, high)).select(names))
                at = high + 1
        later = [f"{self.path}/delta/batch={b}" for b in self.batches() if b >= at and (last is None or b <= last)]
        return out.unionByName(self.spark.read.schema(self.schema).parquet(*later)) if later else out

    def read(self, where: Column | None = None) -> DataFrame:
        """The table as of now. ``where`` is asked before folding and must be on keys of the fold, as its day."""
        rows = self.rows()
        return self.fold(rows if where is None else rows.filter(where))

    def compact(self, open_batches: int = 1, whole: bool = False) -> tuple[int, int] | None:
        """Folds the batches after the last layer, or with ``whole`` all of them, into a layer; returns its range.

        The newest ``open_batches`` stay deltas, as they may still run again. A batch that is replayed later
        writes a delta that its layer already holds, and no reader looks at it. Running this again is harmless.
        """
        known, layers = self.batches(), self.layers()
        done = known[: len(known) - open_batches] if open_batches else known
        first = 0 if whole or not layers else layers[-1][1] + 1
        last = max([*done, *(high for _, high in layers)], default=-1)
        if last < first or (whole and len(layers) == 1 and layers[0][1] == last):
            return None
        out = self.fold(self.rows(first, last))
        writer = out.repartition(F.col(self.by)).write.partitionBy(self.by) if self.by else out.write
        writer.mode("overwrite").parquet(self._layer(first, last))
        return first, last

    def vacuum(self) -> int:
        """Drops deltas and layers that readers no longer use; returns their number. Run it when no old reader is left."""
        layers = self.layers()
        held, dropped = layers[-1][1] if layers else -1, 0
        for batch in self.batches():
            if batch <= held:
                drop_folder(self.spark, f"{self.path}/delta/batch={batch}")
                dropped += 1
        for name in folder_names(self.spark, f"{self.path}/layers"):
            first, last = (int(n) for n in name.split("-"))
            if (first, last) not in layers and last <= held:
                drop_folder(self.spark, f"{self.path}/layers/{name}")
                dropped += 1
        return dropped
