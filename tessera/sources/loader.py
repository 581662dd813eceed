"""Read-through loading of rows that a table lacks, and custom row sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


def read_through(table: DataFrame, wanted: DataFrame, key: list[str], load: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows of the wanted keys; keys without a row are loaded in batches on the executors and added."""
    keys = wanted.select(*key).distinct()
    there = table.join(keys, key, "left_semi")
    missing = keys.join(table.select(*key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield load(b)

    return there.unionByName(missing.mapInPandas(run, table.schema))


class _Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


#: Columns of the virtual table: type, and how a value is made. A column that is not wanted is never made.
ROW = {"id": ("int", lambda i: i), "label": ("string", lambda i: f"row {i}"), "parity": ("string", lambda i: "odd" if i % 2 else "even")}


def wanted(options: dict) -> list[str]:
    """The columns of option ``columns`` (comma-separated; the first two, if it is not given)."""
    names = [c.strip() for c in options.get("columns", "id,label").split(",")]
    if unknown := [c for c in names if c not in ROW]:
        raise ValueError(f"no column {unknown[0]}")
    return names


class RowsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts, self.only = int(options.get("rows", 100)), int(options.get("partitions", 4)), None
        self.columns = wanted(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An equality on ``id`` is taken over: only its partition is read. Others go back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                self.only = f.value
            else:
                yield f

    def partitions(self) -> list[_Part]:
        if self.only is not None:
            return [_Part(self.only, self.only + 1)] if 0 <= self.only < self.rows else []
        step = -(-self.rows // self.parts)
        return [_Part(i, min(i + step, self.rows)) for i in range(0, self.rows, step)]

    def read(self, part: _Part | None) -> Iterator[tuple]:
        for i in range(part.start, part.end) if part else ():  # without partitions Spark reads one that is None
            yield tuple(ROW[c][1](i) for c in self.columns)


class RowsSource(DataSource):
    """A virtual table (``format("tessera_rows")``) as a pattern for external stores: filters are pushed to the reader,
    the projection goes by the option ``columns``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_rows"

    def schema(self) -> str:
        return ", ".join(f"{c} {ROW[c][0]}" for c in wanted(self.options))

    def reader(self, schema: StructType) -> RowsReader:
        return RowsReader(self.options)
