"""Tables by name, with their placement, and SQL over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import to_spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass
class Catalog:
    """A folder of Parquet tables. ``replicated`` tables are offered for broadcast, if they are below the limit."""

    spark: SparkSession
    base: str
    replicated: tuple[str, ...] = ("region", "nation")
    most_replicated_bytes: int = 64 << 20
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def load(self, name: str) -> DataFrame:
        if name not in self.tables:
            df = self.spark.read.parquet(f"{self.base}/{name}.parquet")
            self.tables[name] = F.broadcast(df) if name in self.replicated and self._bytes(df) <= self.most_replicated_bytes else df
        return self.tables[name]

    @staticmethod
    def _bytes(df: DataFrame) -> int:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def define(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Runs dialect SQL; the tables that it names become temporary views."""
        text = to_spark(text)
        for name in set(re.findall(r"[A-Za-z_]\w*", text)) & {*TABLES, *self.tables}:
            self.load(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)


def run_sql(spark: SparkSession, base: str, text: str, args: dict | list | None = None) -> DataFrame:
    return Catalog(spark, base).sql(text, args)
