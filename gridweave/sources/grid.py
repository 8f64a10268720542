"""The grid as a data source: spark.read.format("ts_grid").option("start", ...).load()."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.grid import EPOCH, Grid

#: Points of a partition.
POINTS = 1_000_000


@dataclass
class Stretch(InputPartition):
    first: int
    last: int


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        if any(k not in options for k in ("start", "end", "step")):
            raise ValueError("grid start, end and step must not be NULL")
        self.grid = Grid.of(options["start"], options["end"], int(options["step"]))

    def partitions(self) -> Sequence[InputPartition]:
        return [Stretch(i, min(i + POINTS, self.grid.count) - 1) for i in range(0, self.grid.count, POINTS)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for i in range(partition.first, partition.last + 1):
            yield (EPOCH + timedelta(microseconds=self.grid.at(i)),)


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ts_grid"

    def schema(self) -> str:
        return "ts timestamp_ntz"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)
