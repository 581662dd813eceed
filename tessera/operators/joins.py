"""Joins that SQL lacks a shuffle-friendly form for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, columns: dict[str, str]) -> DataFrame:
    """Each left row with the right row of the same ``by`` whose moment is the latest not after its own (null, if none).

    Both sides are one sorted stream for each key, and the last right row is carried along: no pair is formed.
    ``columns`` maps columns of right to their names in the result; of right rows at one moment the greatest counts."""
    value = F.struct(*(F.col(c).alias(n) for c, n in columns.items()))
    ours = left.select(*by, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(value.alias("x")).schema["x"].dataType).alias("__r"))
    theirs = right.where(F.col(right_at).isNotNull()).select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(ours.schema["__l"].dataType).alias("__l"), value.alias("__r"))
    w = Window.partitionBy(*by).orderBy("__at", "__side", F.col("__r").asc_nulls_last())
    last = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ours.unionByName(theirs).withColumn("__m", last).where("__side = 1").select("__l.*", *(F.when(F.col("__at").isNotNull(), F.col(f"__m.{n}")).alias(n) for n in columns.values()))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the intervals that hold them (start <= at < end). Both go to bins of ``width``; an interval lies in
    the bins it touches, so the join is by equality and only neighbours in a bin are compared."""
    low, high = (F.floor(F.col(c).cast("double") / width).cast("long") for c in (start, end))
    spread = intervals.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(low, high)))
    placed = points.withColumn("__bin", F.floor(F.col(at).cast("double") / width).cast("long"))
    out = placed.join(spread, ["__bin", *(by or [])])
    return out.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def routed(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows by constants of AND and OR over partition columns: a plain filter, which prunes the partitions read."""
    return rows.where(condition)
