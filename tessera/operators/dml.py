"""Data changes as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A row breaks a constraint, a restricting reference or a writer's veto."""


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT SELECT: columns by name; those that rows lack take their default, else null; types are cast to the target's."""
    defaults = defaults or {}
    columns = [(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in target.schema]
    return target.unionByName(rows.select(*columns))


def update(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE SET ... WHERE; values see the old row. A null condition changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, values[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns))


def update_from(target: DataFrame, source: DataFrame, on: str, values: dict[str, str]) -> DataFrame:
    """UPDATE with a correlated scalar subquery: source has one row for each value of ``on``; rows without one get null."""
    picked = source.select(F.col(on), *(F.col(v).alias(f"__{k}") for k, v in values.items()))
    joined = target.join(picked, on, "left")
    return joined.select(*(F.col(f"__{c}").cast(target.schema[c].dataType).alias(c) if c in values else F.col(c) for c in target.columns))


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_exists(target: DataFrame, source: DataFrame, on: str | Column) -> DataFrame:
    """DELETE WHERE EXISTS: an anti join."""
    return target.join(source, on, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """PUT: rows replace those of the same key."""
    return target.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*target.columns))


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def add_column(target: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    """ALTER TABLE ADD COLUMN."""
    return target.withColumn(name, (default if default is not None else F.lit(None)).cast(kind))


def set_type(target: DataFrame, name: str, kind: str) -> DataFrame:
    """ALTER TABLE ALTER COLUMN SET DATA TYPE."""
    return target.withColumn(name, F.col(name).cast(kind))


def identity(rows: DataFrame, name: str, order: list[str | Column], start: int = 1) -> DataFrame:
    """GENERATED ALWAYS AS IDENTITY in the order given, without sorting in one task: rows are range-partitioned and
    numbered within partitions, then shifted by the partitions' counts (as many rows as partitions)."""
    from pyspark.sql.window import Window

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: both branches see the same partitions
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    shift = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    numbered = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return numbered.join(F.broadcast(shift), "__p").select(*rows.columns, (F.col("__r") + F.col("__shift") + (start - 1)).cast("long").alias(name))


def insert_identity(target: DataFrame, rows: DataFrame, name: str, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """INSERT into a table with an identity column: (the table afterwards, IDENTITY_VAL_LOCAL() as a table of one row:
    the last value given, or null). Numbers go on after the largest there."""
    top = target.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("__top"))
    numbered = identity(rows, name, order).crossJoin(F.broadcast(top)).withColumn(name, F.col(name) + F.col("__top")).drop("__top")
    return insert(target, numbered), numbered.agg(F.max(name).alias("identity_val_local"))


def running_sum(rows: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """rows with the sum of ``value`` up to each row in the order given, without one task: sums run within ranges and
    are shifted by the ranges before (as many rows as partitions)."""
    from pyspark.sql.window import Window

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("__v", value).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy("__p").agg(F.sum("__v").alias("__s")).select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__shift"))
    own = F.sum("__v").over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("__own", own).join(F.broadcast(shift), "__p").select(*rows.columns, (F.col("__own") + F.col("__shift")).alias(name))


def positioned(rows: DataFrame, each: Callable[[object], object], schema: str | None = None) -> DataFrame:
    """An updatable cursor over all rows: ``each`` gets a batch (pandas) and gives the rows as updateRow leaves them;
    those it leaves out are deleteRow's. Cursors run where the rows are, none on the driver."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield each(b)

    return rows.mapInPandas(run, schema or rows.schema)


def deferred(rows: DataFrame) -> DataFrame:
    """The rows of a statement that reads the table it changes, held apart (on disk) before the change."""
    from tessera.sources.shared import new_path

    path = new_path(rows.sparkSession, "deferred")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class Constraints:
    """Checked over a whole table; ``violations`` gives a row (constraint, n) for each that is broken."""

    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()  # (name, SQL condition); unknown passes
    foreign_keys: tuple[tuple[str, DataFrame, str], ...] = ()  # (column, referenced table, its column)

    def violations(self, table: DataFrame) -> DataFrame:
        parts = []
        say = lambda name, df: df.agg(F.lit(name).alias("constraint"), F.count("*").alias("n"))
        for c in {*self.not_null, *self.primary_key}:
            parts.append(say(f"not null {c}", table.where(F.col(c).isNull())))
        for key in (*((self.primary_key,) if self.primary_key else ()), *self.unique):
            whole = table
            for c in key:
                whole = whole.where(F.col(c).isNotNull())
            parts.append(say("unique " + ",".join(key), whole.groupBy(*key).count().where("count > 1")))
        for name, condition in self.checks:
            parts.append(say(f"check {name}", table.where(f"NOT ({condition})")))
        for column, other, theirs in self.foreign_keys:
            missing = table.where(F.col(column).isNotNull()).select(F.col(column).alias("__k")).join(other.select(F.col(theirs).alias("__k")), "__k", "left_anti")
            parts.append(say(f"foreign key {column}", missing))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where("n > 0")

    def enforce(self, table: DataFrame) -> DataFrame:
        broken = self.violations(table).orderBy("constraint").limit(10).collect()
        if broken:
            raise ConstraintError("; ".join(f"{r['constraint']}: {r['n']} rows" for r in broken))
        return table


def delete_parents(parents: DataFrame, children: DataFrame, where: Column, parent_key: str, child_key: str, action: str = "restrict", default: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """DELETE on a referenced table with its referential action: (parents, children) afterwards. Restrict and no action
    differ only in when they look; as statements are whole here, both refuse when children are left."""
    if action not in ("cascade", "set null", "set default", "restrict", "no action"):
        raise ValueError(f"no referential action {action}")
    gone = parents.where(F.coalesce(where, F.lit(False))).select(F.col(parent_key).alias(child_key))
    left = delete(parents, where)
    if action == "cascade":
        return left, children.join(gone, child_key, "left_anti")
    if action in ("set null", "set default"):
        new = default if action == "set default" and default is not None else F.lit(None)
        marked = children.join(gone.distinct().withColumn("__gone", F.lit(True)), child_key, "left")
        value = F.when(F.col("__gone"), new).otherwise(F.col(child_key)).cast(children.schema[child_key].dataType)
        return left, marked.select(*(value.alias(c) if c == child_key else F.col(c) for c in children.columns))
    if not children.join(gone, child_key, "left_semi").isEmpty():
        raise ConstraintError(f"rows still refer to {parent_key}")
    return left, children


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """A change log: the key, op (insert, update, delete), old and new row."""
    old = before.select(*key, F.struct(*before.columns).alias("old"))
    new = after.select(*key, F.struct(*after.columns).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    both = old.join(new, key, "full").withColumn("op", op)
    return both.where((F.col("op") != "update") | ~F.col("old").eqNullSafe(F.col("new"))).select(*key, "op", "old", "new")


def before(rows: DataFrame, triggers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """BEFORE row triggers: each maps the rows that are about to be written (NEW), in turn; ``veto`` is one that refuses."""
    for t in triggers:
        rows = t(rows)
    return rows


@dataclass(frozen=True)
class Trigger:
    """A row trigger (``each_row``) maps the log's rows; a statement trigger gets the log whole, once."""

    name: str
    events: tuple[str, ...]
    action: Callable[[DataFrame], DataFrame]
    when: str | None = None
    each_row: bool = True


def fire(log: DataFrame, triggers: list[Trigger]) -> dict[str, DataFrame]:
    """What each trigger's action makes of the changes that it listens to."""
    out = {}
    for t in triggers:
        rows = log.where(F.col("op").isin(*t.events))
        if t.when and t.each_row:
            rows = rows.where(t.when)
        out[t.name] = t.action(rows)
    return out


def veto(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """A writer callback: raises, when the rows are written, at the first row that meets the condition."""
    return rows.where(F.when(F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
