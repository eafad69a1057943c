"""Intermediate frames that several outputs of one report read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import scratch_dir


class Shared:
    """Writes named intermediates once, as tables in the shared scratch folder.

    Reading the table back cuts the lineage: the outputs get short plans, scan only the
    columns they need, and a lost executor costs no recomputation. The folder is the
    cluster's checkpoint folder, whose owner clears it.
    """

    def __init__(self) -> None:
        self._kept: dict[str, DataFrame] = {}

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            rows = build()
            spark = rows.sparkSession
            path = scratch_dir(spark, name)
            rows.write.parquet(path)
            self._kept[name] = spark.read.schema(rows.schema).parquet(path)
        return self._kept[name]
