"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ring:
    """Virtual nodes on a ring of ``2 ** cell_bits`` equal cells; a cell belongs to the next node clockwise.

    ``slack`` is the share by which a shard may exceed the mean. With none, a shard takes the
    whole-number share of the rows, so that counts are at most one apart.
    """

    shards: int = 16
    nodes: int = 64
    cell_bits: int = 14
    slack: float = 0.0

    @property
    def cells(self) -> int:
        return 1 << self.cell_bits

    def points(self) -> list[tuple[int, int]]:
        """(cell, shard) of every virtual node, in ring order."""
        out = []
        for shard in range(self.shards):
            for node in range(self.nodes):
                digest = hashlib.sha256(f"{shard}:{node}".encode()).digest()
                out.append((int.from_bytes(digest[:8], "big") >> (64 - self.cell_bits), shard))
        return sorted(out)

    def walks(self) -> list[list[int]]:
        """For every virtual node the shards met clockwise from it, each once."""
        order = [shard for _, shard in self.points()]
        out = []
        for start in range(len(order)):
            met: list[int] = []
            for shard in order[start:] + order[:start]:
                if shard not in met:
                    met.append(shard)
                if len(met) == self.shards:
                    break
            out.append(met)
        return out

    def limits(self, rows: int) -> list[int]:
        if self.slack > 0:
            return [-(-int(rows * (1 + self.slack)) // self.shards)] * self.shards
        return [rows // self.shards + (s < rows % self.shards) for s in range(self.shards)]

    def segments(self, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
        """(cell, shard, first rank, end rank, first slot): where the keys of every cell go.

        All keys ask the next shard clockwise first; a shard takes them in ring order until it is
        full, and what is left asks the next shard, and so on. At most one segment per cell and
        one more per shard and step come out.
        """
        places, walks = [cell for cell, _ in self.points()], self.walks()
        room, used = self.limits(sum(counts.values())), [0] * self.shards
        waiting = [(cell, bisect.bisect_left(places, cell) % len(places), 0) for cell in sorted(counts)]
        out = []
        for step in range(self.shards):
            left = []
            for cell, node, rank in waiting:
                shard = walks[node][step]
                take = min(counts[cell] - rank, room[shard] - used[shard])
                if take > 0:
                    out.append((cell, shard, rank, rank + take, used[shard]))
                    used[shard] += take
                if rank + take < counts[cell]:
                    left.append((cell, node, rank + take))
            waiting = left
        return out


def assign(rows: DataFrame, key: str, ring: Ring = Ring()) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0 in each shard) to every row.

    Rows are counted per cell of the ring; the counts, ``ring.cells`` at most, decide on the driver
    which ranks of a cell go to which shard, and rows learn their rank within their cell. Null keys
    share one place on the ring. Repeated keys are told apart by the other columns; rows that are
    equal in all columns may swap places. An empty table stays empty. Columns named ``shard`` or
    ``slot`` are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    place = F.xxhash64(F.col(key))
    placed = rows.withColumn("_place", place).withColumn(
        "_cell", F.call_function("shiftrightunsigned", F.col("_place"), F.lit(64 - ring.cell_bits)).cast("int")
    )
    counts = {r["_cell"]: r["count"] for r in placed.groupBy("_cell").count().collect()}  # ring.cells rows at most
    parts = ring.segments(counts)
    schema = "_cell int, shard int, _from long, _to long, _slot long"
    table = F.broadcast(spark.createDataFrame(parts, schema))  # ring.cells + shards ** 2 rows at most
    order = [F.col(c) for c in rows.columns if not rows.schema[c].dataType.typeName() in ("map", "variant")]
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_place", *order)).cast("long") - 1)
    found = ranked.join(table, "_cell").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return found.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from")).select(*rows.columns, "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes assigned rows as one folder per shard."""
    rows.write.partitionBy("shard").parquet(path)
