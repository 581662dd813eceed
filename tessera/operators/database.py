"""Definitions: tables with defaults and constraints, synonyms, schemas, colocated tables, and tables about tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.operators import dml


class DefinitionError(ValueError):
    """A name that is taken or unknown."""


@dataclass
class Table:
    rows: DataFrame
    defaults: dict[str, Column] = field(default_factory=dict)
    rules: dml.Constraints = field(default_factory=dml.Constraints)


class Database:
    """Named tables. Every statement gives a new version of a table; earlier ones can still be read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.synonyms, self.schemas = spark, {}, {}, {"app"}

    # Names

    def resolve(self, name: str) -> str:
        name = name.lower() if "." in name else f"app.{name.lower()}"
        seen = set()
        while name in self.synonyms:
            if name in seen:
                raise DefinitionError(f"{name} names itself")
            seen.add(name)
            name = self.synonyms[name]
        return name

    def _new(self, name: str) -> str:
        full = self.resolve(name)
        if full in self.tables:
            raise DefinitionError(f"{full} exists")
        if full.split(".")[0] not in self.schemas:
            raise DefinitionError(f"no schema {full.split('.')[0]}")
        return full

    def _at(self, name: str) -> Table:
        full = self.resolve(name)
        if full not in self.tables:
            raise DefinitionError(f"no table {full}")
        return self.tables[full]

    def create_schema(self, name: str) -> None:
        if name.lower() in self.schemas:
            raise DefinitionError(f"schema {name} exists")
        self.schemas.add(name.lower())

    def create_synonym(self, name: str, of: str) -> None:
        full = name.lower() if "." in name else f"app.{name.lower()}"
        if full in self.tables or full in self.synonyms:
            raise DefinitionError(f"{full} exists")
        self.synonyms[full] = of.lower() if "." in of else f"app.{of.lower()}"

    def drop_synonym(self, name: str) -> None:
        full = name.lower() if "." in name else f"app.{name.lower()}"
        if self.synonyms.pop(full, None) is None:
            raise DefinitionError(f"no synonym {full}")

    # Tables

    def create_table(self, name: str, schema: str | StructType, defaults: dict[str, Column] | None = None, rules: dml.Constraints | None = None) -> None:
        full = self._new(name)
        empty = self.spark.createDataFrame([], schema)
        self.tables[full] = Table(empty, defaults or {}, rules or dml.Constraints())

    def create_table_as(self, name: str, query: DataFrame, data: bool = True) -> None:
        """CREATE TABLE ... AS ... WITH [NO] DATA."""
        self.tables[self._new(name)] = Table(query if data else query.limit(0))

    def drop_table(self, name: str) -> None:
        full = self.resolve(name)
        if self.tables.pop(full, None) is None:
            raise DefinitionError(f"no table {full}")

    def rows(self, name: str) -> DataFrame:
        return self._at(name).rows

    def insert(self, name: str, rows: DataFrame, check: bool = True) -> None:
        table = self._at(name)
        new = dml.insert(table.rows, rows, table.defaults)
        if check and table.rules != dml.Constraints():
            table.rules.enforce(new)
        table.rows = new

    def add_column(self, name: str, column: str, kind: str, default: Column | None = None) -> None:
        table = self._at(name)
        table.rows = dml.add_column(table.rows, column, kind, default)
        if default is not None:
            table.defaults[column] = default

    def drop_column(self, name: str, column: str) -> None:
        table = self._at(name)
        if column not in table.rows.columns:
            raise DefinitionError(f"no column {column}")
        table.rows = table.rows.drop(column)
        table.defaults.pop(column, None)

    def set_default(self, name: str, column: str, default: Column | None) -> None:
        """ALTER COLUMN ... DEFAULT: for rows inserted from now on."""
        table = self._at(name)
        table.defaults = {k: v for k, v in table.defaults.items() if k != column} | ({} if default is None else {column: default})

    def set_nullable(self, name: str, column: str, nullable: bool) -> None:
        """ALTER COLUMN ... [NOT] NULL; NOT NULL is checked against the rows that are there."""
        table, rules = self._at(name), self._at(name).rules
        names = tuple(c for c in rules.not_null if c != column) + (() if nullable else (column,))
        new = dml.Constraints(rules.primary_key, rules.unique, names, rules.checks, rules.foreign_keys)
        if not nullable:
            new.enforce(table.rows)
        table.rules = new

    # Tables about tables

    def systables(self) -> DataFrame:
        rows = [(*name.split("."), len(t.rows.columns)) for name, t in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "schemaname string, tablename string, n_columns int")

    def syscolumns(self) -> DataFrame:
        rows = [(*name.split("."), f.name, k, f.dataType.simpleString()) for name, t in sorted(self.tables.items()) for k, f in enumerate(t.rows.schema, 1)]
        return self.spark.createDataFrame(rows, "schemaname string, tablename string, columnname string, columnnumber int, columndatatype string")


def members(spark: SparkSession) -> DataFrame:
    """The processes that run tasks: host, port and running tasks of each."""
    rows = [(e.host(), e.port(), e.numRunningTasks()) for e in spark._jsc.sc().statusTracker().getExecutorInfos()]
    return spark.createDataFrame(rows, "host string, port int, running int")


def colocate(name: str, rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """PARTITION BY COLUMN (key) COLOCATE: a table stored in buckets of its key, sorted in each. Tables of one number of
    buckets join on their keys without a shuffle. Stored once; a table of that name is read again."""
    spark = rows.sparkSession
    if not spark.catalog.tableExists(name):
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("ignore").saveAsTable(name)
    return spark.table(name)

