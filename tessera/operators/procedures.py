"""Procedures that run where the rows are, and functions by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Result:
    """What a call gives: OUT parameters by name, and dynamic result sets in order."""

    out: dict[str, object] = field(default_factory=dict)
    result_sets: list[DataFrame] = field(default_factory=list)


@dataclass(frozen=True)
class Routine:
    """A signature: types of the parameters by position (Python types; None takes any), and the body."""

    kinds: tuple[type | None, ...]
    body: Callable
    most_result_sets: int = 0

    def takes(self, args: tuple) -> int | None:
        """How many parameters match by their type, or None if the call does not fit."""
        if len(args) != len(self.kinds) or any(k and a is not None and not isinstance(a, k) for k, a in zip(self.kinds, args, strict=True)):
            return None
        return sum(k is not None for k in self.kinds)


class Procedures:
    """Registry of Python procedures, scalar functions and table functions."""

    def __init__(self, spark: SparkSession):
        self.spark, self.procedures = spark, {}

    def create(self, name: str, f: Callable, kinds: tuple[type | None, ...] | None = None, most_result_sets: int = 0) -> None:
        """A procedure; several of one name differ in the number or types of their parameters."""
        if kinds is None:
            self.procedures[name] = f
            return
        known = self.procedures.setdefault(name, [])
        if any(r.kinds == kinds for r in known):
            raise ValueError(f"{name} with these parameters exists")
        known.append(Routine(kinds, f, most_result_sets))

    def call(self, name: str, *args: object) -> object:
        """The value of a plain procedure; of one with a signature its Result, from the closest fit."""
        found = self.procedures[name]
        if not isinstance(found, list):
            return found(self.spark, *args)
        fits = [(r.takes(args), r) for r in found if r.takes(args) is not None]
        if not fits:
            raise TypeError(f"no procedure {name} takes {', '.join(type(a).__name__ for a in args)}")
        routine = max(fits, key=lambda f: f[0])[1]
        result = Result()
        routine.body(self.spark, result, *args)
        result.result_sets = result.result_sets[: routine.most_result_sets]
        return result

    def create_function(self, name: str, f: Callable, kind: str) -> None:
        """A vectorized scalar function for SQL."""
        from pyspark.sql.functions import pandas_udf

        self.spark.udf.register(name, pandas_udf(f, kind))

    def create_table_function(self, name: str, handler: type, schema: str) -> None:
        from pyspark.sql.functions import udtf

        self.spark.udtf.register(name, udtf(handler, returnType=schema))


def on_all(rows: DataFrame, local: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: list[str] | None = None) -> DataFrame:
    """CALL ... WITH RESULT PROCESSOR ON TABLE: ``local`` sees the batches of each partition's own rows; results are
    drained in turn or, with ``order``, merged into one order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield local(b)

    out = rows.mapInPandas(run, schema)
    return out.orderBy(*order) if order else out


def map_reduce(rows: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: list[str], combine: dict[str, str]) -> DataFrame:
    """A function on a region: partial results by partition, combined by key with built-in aggregates."""
    from pyspark.sql import functions as F

    parts = on_all(rows, partial, schema)
    return parts.groupBy(*key).agg(*(getattr(F, f)(c).alias(c) for c, f in combine.items()))


def tuple_filter(rows: DataFrame, accepts: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """A filter callback that sees whole rows, a batch at a time; a null answer refuses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[accepts(b).fillna(False).astype(bool)]

    return rows.mapInPandas(run, rows.schema)


def generated(spark: SparkSession, fetch: Callable[[int], pd.DataFrame], parts: int, schema: str) -> DataFrame:
    """Rows from a callback: ``fetch`` is asked for each of ``parts`` portions, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["id"]:
                yield fetch(int(part))

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def aggregate(rows: DataFrame, key: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], schema: str, combine: dict[str, str], finish: dict[str, str]) -> DataFrame:
    """A user's aggregate in two steps, so that no group is gathered: ``partial`` reduces a batch by key, its columns are
    combined by built-in aggregates, and SQL expressions over them give the result."""
    from pyspark.sql import functions as F

    return map_reduce(rows, partial, schema, key, combine).select(*key, *(F.expr(e).alias(c) for c, e in finish.items()))
