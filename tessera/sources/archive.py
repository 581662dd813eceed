"""Change archives: appended rows with operation, time and sequence, partitioned by day; and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(log: DataFrame, path: str, stamp: str = "ts") -> None:
    """The archive of a store: one directory for each day, so that time filters prune."""
    log.withColumn("day", F.to_date(stamp)).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if since:
        df = df.where(F.col("day") >= F.lit(since).cast("date"))
    return df.where(F.col("day") <= F.lit(until).cast("date")) if until else df


def latest(log: DataFrame, key: list[str], order: str, op: str = "op", delete: str = "delete") -> DataFrame:
    """The table that the log leaves: per key the row of the largest order, unless it is a delete. A partial
    aggregate, not a window: a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return last.where(F.col(f"__last.{op}") != delete).select(*key, "__last.*")


def export_snapshot(df: DataFrame, path: str, keep: Column | None = None) -> None:
    (df.where(keep) if keep is not None else df).write.mode("overwrite").parquet(path)


def import_snapshot(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(keep) if keep is not None else df
