"""Links within groups of any size.

A group that fits a unit is compared by one task. A larger one is dealt to parts, each joined by the same few hubs
of the group; what a part holds is linked there, and hubs link across parts. Of the classes that come out, members of
the group's largest one are known to hang together, so only the rest still has to meet every part. In a group of
copies the rest is small, and the work stays in proportion to the group; no group is gathered, and none is compared
part by part with itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import emptied, materialize, shuffle_partitions
from tessera.llm.components import connected_components

UNIT, UNIT_BYTES, HUBS = 1024, 1 << 26, 16
"""Members and bytes (column ``weight``) that a unit holds, and hubs of a large group."""
ROUND_BYTES = 1 << 29
"""Bytes of rows that a round of comparisons deals out, if it has more than one share of the rest."""
Links = Callable[[pa.Table], list[tuple]]
"""From the rows of a unit (with their known ``class``) to pairs of nodes that are linked. A node can have two rows; pairs
of two nodes without a row that is ``asked`` are met elsewhere."""


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` columns of sorted batches, across batch bounds."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        columns = [np.asarray(b.column(i)) for i in range(keys)]
        change = np.zeros(len(b), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), len(b)]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[i] for c in columns)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


class Classes:
    """Union of rows; those of one known class start together."""

    def __init__(self, known: list):
        self.root = list(range(len(known)))
        first: dict = {}
        for i, c in enumerate(known):
            if c is not None:
                self.root[i] = first.setdefault(c, i)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, i: int, j: int) -> None:
        self.root[self.find(i)] = self.find(j)


def _compared(rows: DataFrame, keys: list[str], links: Links, *forget: Callable[[], None]) -> DataFrame:
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, len(keys)):
            if len(t) > 1 and (found := links(t)):
                a, b = zip(*found, strict=True)
                of = t.schema.field("node").type
                yield pa.RecordBatch.from_arrays([pa.array(a, of), pa.array(b, of)], ["a", "b"])

    others = [c for c in rows.columns if c not in (*keys, "part", "rest", "weight")]
    dealt = rows.select(*keys, *others).repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lambda batches: emptied(run(batches), *forget), f"a {kind}, b {kind}")


def linked(rows: DataFrame, links: Links, unit: int | None = None, forget: Callable[[], None] = lambda: None) -> DataFrame:
    """Pairs (a, b) whose components are those of all pairs within a group that ``links`` would find.

    rows: group (long), node, weight, and what ``links`` reads; ``rows`` should be cheap to read again. ``forget``
    empties what ``links`` remembers, at the end of a task."""
    unit = unit or UNIT
    kind = rows.schema["node"].dataType
    rows = rows.withColumn("class", F.lit(None).cast(kind)).withColumn("asked", F.lit(True))
    units = F.ceil(F.greatest(F.count("*") / unit, F.sum("weight") / UNIT_BYTES)).cast("int")
    big = rows.groupBy("group").agg(units.alias("__parts"), F.count("*").alias("__n")).where("__parts > 1 AND __n > 2")
    big = materialize(big.select("group", "__parts"), "large-groups")
    if big.isEmpty():
        return _compared(rows, ["group"], links, forget)
    small = _compared(rows.join(big, "group", "left_anti"), ["group"], links, forget)
    large = materialize(rows.join(big, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("__parts")).cast("int")), "large-group-rows")
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("node", F.lit(1))))
    hubs = large.withColumn("__nth", nth).where(F.col("__nth") <= HUBS).drop("__nth")
    visiting = lambda df: df.withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).where("__to <> part").drop("part").withColumnRenamed("__to", "part")
    first = materialize(_compared(large.unionByName(visiting(hubs)).drop("__parts"), ["group", "part"], links, forget), "links")
    # What hangs together already, and who is outside the largest class of a group.
    classes = connected_components(first).withColumnRenamed("component", "__class")
    large = large.drop("class").join(classes, "node", "left").withColumn("class", F.coalesce("__class", "node")).drop("__class")
    large = materialize(large, "large-group-rows")
    sizes = large.groupBy("group", "class").agg(F.count("*").alias("__c"))
    largest = sizes.groupBy("group").agg(F.max_by("class", F.struct("__c", "class")).alias("class"))
    rest = materialize(large.join(largest, ["group", "class"], "left_anti"), "rest")
    if rest.isEmpty():
        return small.unionByName(first)
    shares = materialize(rest.groupBy("group").agg(units.alias("__rests")), "rests")
    rest = rest.join(shares, "group").withColumn("rest", F.pmod(F.xxhash64("node", F.lit(2)), F.col("__rests")).cast("int"))
    # A round deals out some of the rests, and its shuffle files go before the next one: the copies of all rounds together
    # grow with the square of a group.
    weight, rests = large.join(shares, "group").agg(F.sum("weight"), F.max("__rests")).first()
    step, found = max(1, ROUND_BYTES // (2 * max(weight, 1))), small.unionByName(first)
    for low in range(0, rests, step):
        last = F.least(F.lit(low + step), F.col("__rests")) - 1
        members = large.join(shares.where(F.col("__rests") > low), "group").withColumn("rest", F.explode(F.sequence(F.lit(low), last))).withColumn("asked", F.lit(False))
        asking = rest.where(F.col("rest").between(low, low + step - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        both = members.unionByName(asking).drop("__parts", "__rests")
        found = found.unionByName(materialize(_compared(both, ["group", "part", "rest"], links, forget), "links"))
    return found
