"""Expiration and eviction as filters of a table at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expire(rows: DataFrame, stamp: str, seconds: int | Column, now: Column) -> DataFrame:
    """EXPIRE ENTRY WITH TIMETOLIVE (or IDLETIME over the last access): rows older than the limit go; a null stamp or
    limit never expires. A column as limit is the custom expiry of each row."""
    limit = F.lit(seconds) if isinstance(seconds, int) else seconds
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(stamp).cast("timestamp"))
    return rows.where(F.coalesce(age <= limit.cast("long") * 1_000_000, F.lit(True)))


def evict(rows: DataFrame, criteria: Column) -> tuple[DataFrame, DataFrame]:
    """EVICTION BY CRITERIA: (kept, evicted); unknown stays."""
    hit = F.coalesce(criteria, F.lit(False))
    return rows.where(~hit), rows.where(hit)


def keep_recent(rows: DataFrame, count: int, used: str, key: str) -> DataFrame:
    """LRUCOUNT n with DESTROY: the n most recently used rows stay (ties: larger key). TakeOrdered, no global sort."""
    return rows.orderBy(F.desc_nulls_last(used), F.desc(key)).limit(count)


def keep_bytes(rows: DataFrame, most: int | DataFrame, size: Column, used: str, key: str) -> tuple[DataFrame, DataFrame]:
    """LRUMEMSIZE (or LRUHEAPPERCENT, with a table of one number as the limit): (kept, evicted). The most recently used
    rows stay as long as their sizes sum up to at most the limit; with OVERFLOW the others are still there to be read."""
    from tessera.operators.dml import running_sum

    sized = running_sum(rows, size, [F.desc_nulls_last(used), F.desc(key)], "__sum")
    if isinstance(most, DataFrame):
        sized, limit = sized.crossJoin(F.broadcast(most.toDF("__limit"))), F.col("__limit")
    else:
        limit = F.lit(most)
    return sized.where(F.col("__sum") <= limit).select(*rows.columns), sized.where(F.col("__sum") > limit).select(*rows.columns)
