"""Secondary indexes as small sorted tables of keys: hash (local or global), sorted, unique, and over maps.

An index holds its key columns and the columns of the rows that it covers. Hash indexes are partitioned by the hash of
the key, so a look-up reads one folder; sorted ones by ranges of it, so a range reads the files whose bounds meet it.
Both carry Bloom filters of their keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dml import ConstraintError
from tessera.sources.shared import new_path


@dataclass(frozen=True)
class Index:
    kind: str
    keys: tuple[str, ...]
    rows: DataFrame
    buckets: int = 0

    def get(self, *values: object) -> DataFrame:
        """The rows of one key."""
        out = self.rows
        if self.kind == "hash":
            bucket = F.pmod(F.hash(*(F.lit(v).cast(self.rows.schema[k].dataType) for k, v in zip(self.keys, values, strict=True))), F.lit(self.buckets))
            out = out.where(F.col("__bucket") == bucket)
        for k, v in zip(self.keys, values, strict=True):
            out = out.where(F.col(k) == F.lit(v))
        return out.drop("__bucket")

    def between(self, low: object, high: object) -> DataFrame:
        """The rows whose first key lies in a closed range; None leaves a side open."""
        out, key = self.rows, F.col(self.keys[0])
        if low is not None:
            out = out.where(key >= F.lit(low))
        if high is not None:
            out = out.where(key <= F.lit(high))
        return out.drop("__bucket")


def _write(rows: DataFrame, keys: tuple[str, ...], tag: str, partition: str | None = None) -> DataFrame:
    path = new_path(rows.sparkSession, tag)
    writer = rows.write
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def hash_index(rows: DataFrame, keys: tuple[str, ...], covers: tuple[str, ...], buckets: int = 8, unique: bool = False) -> Index:
    """The rows of a null key are left out, as an equality never finds them."""
    own = _own(rows, keys, covers, unique)
    own = own.withColumn("__bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
    return Index("hash", keys, _write(own.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", *keys), keys, "hash-index", "__bucket"), buckets)


def sorted_index(rows: DataFrame, keys: tuple[str, ...], covers: tuple[str, ...], descending: bool = False, unique: bool = False) -> Index:
    order: list[Column] = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    own = _own(rows, keys, covers, unique)
    return Index("sorted", keys, _write(own.repartitionByRange(*order).sortWithinPartitions(*order), keys, "sorted-index"))


def map_index(rows: DataFrame, column: str, covers: tuple[str, ...]) -> Index:
    """An entry for each key of a map, with its value: for m['k'] compared with a value."""
    entries = rows.select(*covers, F.explode(column).alias("map_key", "map_value"))
    return sorted_index(entries, ("map_key", "map_value"), covers)


def _own(rows: DataFrame, keys: tuple[str, ...], covers: tuple[str, ...], unique: bool) -> DataFrame:
    own = rows.select(*dict.fromkeys((*keys, *covers)))
    for k in keys:
        own = own.where(F.col(k).isNotNull())
    if unique and not own.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ConstraintError(f"{', '.join(keys)} is not unique")
    return own
