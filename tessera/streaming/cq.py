"""Continuous queries over a change log: (key, op, sequence, new row), batch or streaming.

A change has a base operation (create, update, destroy) and, for a query, a query operation: an update that
enters the predicate is a create, one that leaves it a destroy. Per key only "did the last row match?" is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def cq_events(log: DataFrame, where: Column, key: str, sequence: str) -> DataFrame:
    """The log's changes that the query sees, with query_op. Redelivered changes (same key and sequence) count once.
    The log has ``op``: create, update or destroy."""
    first = log.dropDuplicates([key, sequence])
    now = F.coalesce(where, F.lit(False)) & (F.col("op") != "destroy")
    marked = first.withColumn("__in", now)
    before = F.coalesce(F.lag("__in").over(Window.partitionBy(key).orderBy(sequence)), F.lit(False))
    op = F.when(F.col("__in") & ~F.col("__was"), "create").when(F.col("__in"), "update").when(F.col("__was"), "destroy")
    return marked.withColumn("__was", before).withColumn("query_op", op).where("query_op IS NOT NULL").drop("__in", "__was")


def initial_results(log: DataFrame, where: Column, key: str, sequence: str, until: int | DataFrame) -> DataFrame:
    """Rows that match when the query is registered: the latest change of each key up to ``until`` (a number, or a
    table of one row and column)."""
    rest = [c for c in log.columns if c != key]
    if isinstance(until, DataFrame):
        seen = log.crossJoin(F.broadcast(until.toDF("__until"))).where(F.col(sequence) <= F.col("__until")).drop("__until")
    else:
        seen = log.where(F.col(sequence) <= until)
    last = seen.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("__r")).select(key, "__r.*")
    return last.where((F.col("op") != "destroy") & F.coalesce(where, F.lit(False)))


def statistics(events: DataFrame) -> DataFrame:
    """Counts of a query's events by query operation."""
    return events.groupBy("query_op").agg(F.count("*").alias("n"))


def conflate(log: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The latest change of each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), sequence).alias("__r")).select(*key, "__r.*")


RECENT = 64
"""Sequence numbers of a key that the streaming form remembers, to tell a redelivered change from a late one."""


def cq_stream(stream: DataFrame, where: Column, key: str, sequence: str) -> DataFrame:
    """The streaming form: per key a (matched, last sequence, recent ones) state; output in append mode.

    Within a micro-batch changes are put in order. One that comes in a later batch than a change it should precede can
    no longer be judged: it leaves with query_op ``late`` and changes nothing, unless it is among the last RECENT
    sequence numbers of its key and so is a redelivery, which counts once."""
    marked = stream.withColumn("__in", F.coalesce(where, F.lit(False)) & (F.col("op") != "destroy"))
    out = StructType(list(stream.schema.fields)).add("query_op", "string")
    columns = stream.columns

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, last, recent = state.get if state.exists else (False, -1, [])
        recent = list(recent)
        rows = pd.concat(list(batches)).sort_values(sequence)
        ops, keep = [], []
        for i, (n, inside) in enumerate(zip(rows[sequence], rows["__in"], strict=True)):
            if n in recent:
                continue
            if n < last:
                op = "late"
            else:
                op = "create" if inside and not was else "update" if inside else "destroy" if was else None
                was, last = bool(inside), int(n)
            recent = [*recent, int(n)][-RECENT:]
            if op:
                keep.append(i)
                ops.append(op)
        state.update((was, last, recent))
        if keep:
            yield rows.iloc[keep][columns].assign(query_op=ops)

    return marked.groupBy(key).applyInPandasWithState(run, out, "matched boolean, last long, recent array<long>", "append", GroupStateTimeout.NoTimeout)


class EventQueue:
    """An asynchronous event queue for ``writeStream.foreachBatch``: filters, optional conflation, the listener, and
    dead letters.

    Three filter stages: ``keep`` before a change is queued, ``transmit`` (after conflation) before it is sent, and
    ``acknowledged``, which is told what was taken. A batch whose listener returns False is delivered again on restart
    (at least once), and so is one whose listener raises, unless ``on_error`` takes it. A batch that was tried before is
    marked as a possible duplicate; ``progress`` names a folder beside the checkpoint where that is remembered over
    restarts (without it, only as long as the queue lives)."""

    def __init__(
        self,
        listener: Callable[[DataFrame, int, bool], bool],
        keep: Column | None = None,
        conflate_by: tuple[list[str], str] | None = None,
        on_error: Callable[[DataFrame, Exception], None] | None = None,
        transmit: Column | None = None,
        acknowledged: Callable[[DataFrame, int], None] | None = None,
        progress: str | None = None,
    ):
        self.listener, self.keep, self.conflate_by, self.on_error = listener, keep, conflate_by, on_error
        self.transmit, self.acknowledged, self.progress = transmit, acknowledged, progress
        self.tried: int = -1

    def _tried(self, batch: DataFrame, batch_id: int) -> bool:
        """Whether the batch was tried before; from now on it was."""
        if not self.progress:
            again, self.tried = batch_id <= self.tried, max(self.tried, batch_id)
            return again
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.progress)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        mark = spark._jvm.org.apache.hadoop.fs.Path(path, f"tried-{batch_id}")
        if fs.exists(mark):
            return True
        fs.create(mark).close()
        for old in fs.listStatus(path):  # marks of batches that are long through
            name = old.getPath().getName()
            if name.startswith("tried-") and int(name[6:]) < batch_id - 100:
                fs.delete(old.getPath(), False)
        return False

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(self.keep) if self.keep is not None else batch
        if self.conflate_by:
            rows = conflate(rows, *self.conflate_by)
        if self.transmit is not None:
            rows = rows.where(self.transmit)
        again = self._tried(batch, batch_id)
        try:
            taken = self.listener(rows, batch_id, again)
        except Exception as e:
            if not self.on_error:
                raise
            self.on_error(rows, e)
            return
        if taken is False:
            raise RuntimeError(f"the listener did not take batch {batch_id}")
        if self.acknowledged:
            self.acknowledged(rows, batch_id)


class ContinuousQuery:
    """Lifecycle of a registered query: STOPPED, RUNNING, CLOSING, CLOSED.

    ``sink`` gets the events of each batch; what it raises goes to ``on_error`` if there is one, and otherwise stops the
    query. ``on_status`` is told of connect (execute) and disconnect (stop)."""

    def __init__(self, name: str, events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[DataFrame, Exception], None] | None = None, on_status: Callable[[str], None] | None = None):
        self.name, self.events, self.sink, self.checkpoint, self.run, self.closed, self.closing = name, events, sink, checkpoint, None, False, False
        self.on_error, self.on_status = on_error, on_status

    def _deliver(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self.sink(batch, batch_id)
        except Exception as e:
            if not self.on_error:
                raise
            self.on_error(batch, e)

    def execute(self, **trigger: object) -> ContinuousQuery:
        if self.closed or self.closing:
            raise RuntimeError(f"{self.name} is closed")
        writer = self.events.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).foreachBatch(self._deliver)
        self.run = (writer.trigger(**trigger) if trigger else writer).start()
        if self.on_status:
            self.on_status("connect")
        return self

    @property
    def state(self) -> str:
        return "CLOSED" if self.closed else "CLOSING" if self.closing else "RUNNING" if self.run and self.run.isActive else "STOPPED"

    def stop(self) -> None:
        if self.run:
            self.run.stop()
            if self.on_status:
                self.on_status("disconnect")

    def close(self) -> None:
        self.closing = True
        try:
            self.stop()
        finally:
            self.closing, self.closed = False, True


class CqService:
    """Continuous queries by name, registered by the text of an object query: SELECT * on one region, with a WHERE.

    ``changes`` has per region its change log (batch or streaming, with ``op``), key and sequence column."""

    def __init__(self, changes: dict[str, tuple[DataFrame, str, str]]):
        self.changes, self.queries = changes, {}

    def predicate(self, oql: str, *binds: object) -> tuple[str, str, Column]:
        """Region, alias and condition of a query that can be continuous."""
        from tessera.oql import OqlError, Region
        from tessera.oql.engine import Scope, Translator
        from tessera.oql.parser import Query, parse

        tree = parse(oql)
        if not isinstance(tree, Query) or len(tree.sources) != 1 or tree.sources[0][1][0] != "region" or tree.projection or tree.distinct or tree.group or tree.order or tree.limit is not None:
            raise OqlError("a continuous query is SELECT * on one region, with a WHERE at most")
        region = tree.sources[0][1][1]
        if region not in self.changes:
            raise OqlError(f"no region {region}")
        translator, scope = Translator({region: Region(*self.changes[region][:2])}, list(binds)), Scope()
        translator.source(tree.sources[0][0], tree.sources[0][1], scope, True)
        return region, next(iter(scope.names)), F.expr(translator.sql(tree.where, scope) if tree.where else "TRUE")

    def events(self, oql: str, *binds: object) -> DataFrame:
        region, alias, where = self.predicate(oql, *binds)
        log, key, sequence = self.changes[region]
        return (cq_stream if log.isStreaming else cq_events)(log.alias(alias), where, key, sequence)

    def new_cq(self, name: str, oql: str, sink: Callable[[DataFrame, int], None], checkpoint: str, *binds: object, **listeners: Callable) -> ContinuousQuery:
        if name in self.queries and self.queries[name].state != "CLOSED":
            raise ValueError(f"a continuous query {name} is registered")
        self.queries[name] = ContinuousQuery(name, self.events(oql, *binds), sink, checkpoint, **listeners)
        return self.queries[name]


class DbSynchronizer:
    """A listener for ``EventQueue`` that writes changes behind to a database through a DB-API connection: of each key
    the latest change of the batch, as a delete or as a delete and an insert, so that a batch can come twice.

    ``connect`` runs on the executors; rows of a key lie in one partition."""

    def __init__(self, connect: Callable[[], object], table: str, key: list[str], sequence: str, columns: list[str], partitions: int = 4):
        self.connect, self.table, self.key, self.sequence, self.columns, self.partitions = connect, table, key, sequence, columns, partitions

    def __call__(self, rows: DataFrame, batch_id: int, again: bool) -> bool:
        connect, table, key, columns = self.connect, self.table, self.key, self.columns
        last = conflate(rows, key, self.sequence).select("op", *columns).repartition(self.partitions, *key)

        def write(part: Iterator) -> None:
            part = list(part)
            if not part:
                return
            con = connect()
            try:
                cur, at = con.cursor(), [columns.index(k) for k in key]
                cur.executemany(f"DELETE FROM {table} WHERE {' AND '.join(f'{k} = ?' for k in key)}", [tuple(r[1 + i] for i in at) for r in part])
                cur.executemany(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})", [tuple(r[1:]) for r in part if r[0] != "destroy"])
                con.commit()
            finally:
                con.close()

        last.foreachPartition(write)
        return True
