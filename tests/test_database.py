import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import compat, jsonpath
from tessera.operators import database, dml, indexes, joins, procedures, retention, statistics
from tessera.oql import OqlError
from tessera.plans import Catalog, to_spark
from tessera.plans.placement import placement
from tessera.sources import loader
from tessera.streaming import cq

SF = "/root/testdata/sf0.001"


def test_definitions(spark):
    db = database.Database(spark)
    db.create_table("t", "k int, s string", {"s": F.lit("d")}, dml.Constraints(primary_key=("k",)))
    one = spark.createDataFrame([(1,)], "k int")
    db.insert("t", one)
    with pytest.raises(dml.ConstraintError, match="unique k"):
        db.insert("t", one)
    assert db.rows("t").collect() == [(1, "d")]
    db.add_column("t", "n", "long", F.lit(7))
    db.set_default("t", "s", None)
    db.insert("t", spark.createDataFrame([(2,)], "k int"))
    assert sorted(map(tuple, db.rows("t").collect())) == [(1, "d", 7), (2, None, 7)]
    with pytest.raises(dml.ConstraintError, match="not null s"):
        db.set_nullable("t", "s", False)
    db.set_nullable("t", "n", False)
    with pytest.raises(dml.ConstraintError, match="not null n"):
        db.insert("t", spark.createDataFrame([(3, None)], "k int, n long"))
    db.set_nullable("t", "n", True)
    db.insert("t", spark.createDataFrame([(3, None)], "k int, n long"))
    db.drop_column("t", "n")
    assert db.rows("t").columns == ["k", "s"]
    db.create_synonym("u", "t")
    assert db.rows("U").count() == 3
    db.drop_synonym("u")
    for bad in (lambda: db.rows("u"), lambda: db.create_table("t", "k int"), lambda: db.create_table("no.t", "k int"), lambda: db.drop_table("x"), lambda: db.drop_column("t", "x"), lambda: db.create_schema("app")):
        with pytest.raises(database.DefinitionError):
            bad()
    db.create_synonym("a", "b")
    db.create_synonym("b", "a")
    with pytest.raises(database.DefinitionError, match="itself"):
        db.rows("a")
    assert [r.columnname for r in db.syscolumns().orderBy("columnnumber").collect()] == ["k", "s"]
    assert database.members(spark).count() >= 1


def test_colocated_join_moves_no_row(spark):
    rows = spark.range(500).selectExpr("id AS k", "id * 2 AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = database.colocate("tessera_test_a", rows, "k", 4)
        b = database.colocate("tessera_test_b", rows.where("k % 3 = 0"), "k", 4)
        both = a.join(b, "k")
        assert both.count() == 167 and "Exchange" not in both._jdf.queryExecution().sparkPlan().toString()
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS tessera_test_a")
        spark.sql("DROP TABLE IF EXISTS tessera_test_b")


def test_indexes_prune_and_refuse(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0), (3, None, 7.0), (4, "a", 8.0)], "id int, s string, d double")
    index = indexes.hash_index(rows, ("s",), ("id",))
    assert sorted(r.id for r in index.get("a").collect()) == [1, 4] and index.get("zz").count() == 0
    assert "PartitionFilters: [isnotnull(__bucket" in index.get("a")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(dml.ConstraintError):
        indexes.hash_index(rows, ("s",), ("id",), unique=True)
    by_value = indexes.sorted_index(rows, ("d",), ("id",), unique=True)
    assert sorted(r.id for r in by_value.between(6, None).collect()) == [2, 3, 4] and "GreaterThanOrEqual(d,6.0)" in by_value.between(6, None)._jdf.queryExecution().executedPlan().toString()


def test_statistics_and_explain(spark):
    df = spark.range(1000).where("id % 2 = 0").groupBy(F.expr("id % 10").alias("k")).count()
    assert [r.operator for r in statistics.explain(df).orderBy("id").limit(2).collect()][0] == "Aggregate"
    seen = {r.operator: r.rows for r in statistics.runtime_statistics(df).collect()}
    assert seen["Range"] == 1000 and seen["Filter"] == 500
    got = statistics.column_statistics(spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string"), ["a", "b"]).collect()
    assert [tuple(r)[:4] for r in got] == [("a", 3, 0, 2), ("b", 3, 1, 1)]


def test_placement():
    p = placement("CREATE TABLE t (x INT) PARTITION BY PRIMARY KEY REDUNDANCY 1 EVICTION BY LRUMEMSIZE 100 EVICTACTION DESTROY EXPIRE TABLE WITH IDLETIME 9 ACTION INVALIDATE SERVER GROUPS (a, b)")
    assert (p.method, p.redundancy, p.eviction, p.expire, p.server_groups) == ("primary key", 1, ("LRUMEMSIZE", 100, "DESTROY"), ("IDLETIME", 9, "INVALIDATE"), ("a", "b"))
    assert placement("CREATE TABLE t (x VARCHAR(9) DEFAULT 'REPLICATE')").kind == "partitioned"


def test_asof_and_interval_joins(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (1, None), (2, 10), (None, 10)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (1, 11, "d"), (1, None, "e"), (3, 1, "f")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, ["k"], "t", "t", {"v": "v"}).collect()}
    assert got == {(1, 10): "c", (1, 5): "a", (1, None): None, (2, 10): None, (None, 10): None}
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate((-3, 0, 4.5, 9, 10, 25))], "id int, x double")
    spans = spark.createDataFrame([(1, -5.0, 0.0), (2, 0.0, 10.0), (3, 4.0, 4.0), (4, 9.5, 30.0)], "s int, a double, b double")
    assert sorted((r.id, r.s) for r in joins.interval_join(points, spans, "x", "a", "b", 4.0).collect()) == [(0, 1), (1, 2), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_quantified_comparisons(spark):
    spark.createDataFrame([(1,), (2,), (3,)], "x int").createOrReplaceTempView("t_x")
    spark.createDataFrame([(2,), (3,)], "v int").createOrReplaceTempView("t_v")
    spark.createDataFrame([(2,), (None,)], "v int").createOrReplaceTempView("t_n")
    ask = lambda c: sorted(r.x for r in spark.sql(to_spark(f"SELECT x FROM t_x WHERE {c}")).collect())
    assert ask("x > ANY (SELECT v FROM t_v)") == [3] and ask("x >= ALL (SELECT v FROM t_v)") == [3] and ask("x < SOME (SELECT v FROM t_v)") == [1, 2]
    assert ask("x = ANY (SELECT v FROM t_v)") == [2, 3] and ask("x <> ALL (SELECT v FROM t_v)") == [1]
    assert ask("x <> ANY (SELECT v FROM t_v)") == [1, 2, 3] and ask("x = ALL (SELECT v FROM t_v WHERE v = 2)") == [2]
    assert ask("x < ALL (SELECT v FROM t_n)") == [] and ask("NOT (x < ALL (SELECT v FROM t_n))") == [2, 3] and ask("x > ANY (SELECT v FROM t_n)") == [3]
    assert ask("x > ALL (SELECT v FROM t_v WHERE v > 9)") == [1, 2, 3] and ask("x > ANY (SELECT v FROM t_v WHERE v > 9)") == []


def test_dml_more(spark):
    t = spark.createDataFrame([(1, 5), (2, 6)], "id long, v int")
    after, last = dml.insert_identity(t, spark.createDataFrame([(9,), (8,)], "v int"), "id", ["v"])
    assert sorted(map(tuple, after.collect())) == [(1, 5), (2, 6), (3, 8), (4, 9)] and last.collect() == [(4,)]
    assert dml.insert_identity(t, t.select("v").limit(0), "id", ["v"])[1].collect() == [(None,)]
    with pytest.raises(ValueError, match="referential"):
        dml.delete_parents(t, t, F.col("id") == 1, "id", "v", "sometimes")
    rows = spark.range(300).select("id", (F.col("id") % 7).alias("v"))
    got = dml.running_sum(rows, F.col("v"), [F.desc("id")], "s")
    assert all(r.s == sum(i % 7 for i in range(r.id, 300)) for r in got.collect())
    kept, gone = retention.keep_bytes(rows, 100, F.col("v"), "id", "id")
    assert kept.count() + gone.count() == 300 and kept.agg(F.sum("v")).first()[0] <= 100 and kept.agg(F.min("id")).first()[0] > gone.agg(F.max("id")).first()[0]


def test_scalars_more(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(compat.upper(F.lit("istanbul"), "tr")) == "İSTANBUL" and one(compat.lower(F.lit("IĞDIR"), "tr")) == "ığdır" and one(compat.upper(F.lit("i"))) == "I"
    assert one(compat.width(F.lit("abc  "), 3, error=True)) == "abc" and one(compat.width(F.lit("abcd"), 3)) == "abc"
    with pytest.raises(Exception, match="longer than 3"):
        one(compat.width(F.lit("abcd"), 3, error=True))
    null, two = F.lit(None).cast("int"), F.lit(2)
    q = compat.qualifier
    assert one(q(null, "=", null, ordered_nulls=True)) and one(q(null, ">", two, ordered_nulls=True)) and not one(q(null, "<", two, ordered_nulls=True))
    assert one(q(null, "<", two, unknown=True)) and not one(q(null, "<", two)) and one(q(null, "<", two, negate=True))


def test_json_paths_and_merge(spark):
    j = F.lit('{"a": {"b": 1, "c": [5, {"d": 2}]}, "e": {}}')
    ask = lambda p: spark.range(1).select(jsonpath.paths(j, p).alias("x")).first().x
    assert ask("$.a.b") == ["$['a']['b']"] and ask("$.a.c[-1].d") == ["$['a']['c'][1]['d']"] and ask("$.z") == [] and ask("$.a['b','c']") == ["$['a']['b']", "$['a']['c']"]
    assert ask("$.a.c[*]") == ["$['a']['c'][0]", "$['a']['c'][1]"] and ask("$.a.*") == ["$['a']['b']", "$['a']['c']"] and ask("$.a.c[?(@.d > 1)].d") == ["$['a']['c'][1]['d']"]
    assert spark.range(1).select(jsonpath.merged(j, "$.a['b','zz']").alias("x")).first().x == '{"b":1}'
    with pytest.raises(ValueError):
        jsonpath.merged(j, "$.a.c[*]")


def test_routines(spark):
    p = procedures.Procedures(spark)
    p.create("f", lambda s, r, n: r.out.update(kind="int"), (int,))
    p.create("f", lambda s, r, n: r.out.update(kind="any"), (None,))
    p.create("f", lambda s, r: r.result_sets.extend([s.range(1), s.range(2)]), (), most_result_sets=1)
    assert p.call("f", 1).out == {"kind": "int"} and p.call("f", "x").out == {"kind": "any"} and len(p.call("f").result_sets) == 1
    with pytest.raises(TypeError):
        p.call("f", 1, 2)
    with pytest.raises(ValueError):
        p.create("f", lambda *_: None, (int,))


def test_projection_of_the_virtual_table(spark):
    spark.dataSource.register(loader.RowsSource)
    df = spark.read.format("tessera_rows").option("rows", 5).option("columns", "parity,id").load()
    assert df.columns == ["parity", "id"] and sorted(map(tuple, df.collect()))[0] == ("even", 0)
    assert df.where("id = 3").collect() == [("odd", 3)]


SCHEMA = "k int, seq long, op string, v int"


def _batches(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_changes_are_told_and_redelivered_ones_count_once(spark, tmp_path):
    got = []
    stream = _batches(spark, str(tmp_path / "in"), [[(1, 5, "create", 10)], [(1, 5, "create", 10), (1, 3, "create", 20), (1, 6, "update", 1)]])
    q = cq.ContinuousQuery("late", cq.cq_stream(stream, F.col("v") > 5, "k", "seq"), lambda df, n: got.extend((r.seq, r.query_op) for r in df.collect()), str(tmp_path / "cp"))
    q.execute(availableNow=True).run.awaitTermination()
    assert sorted(got) == [(3, "late"), (5, "create"), (6, "destroy")]


def test_query_by_text_states_and_errors(spark, tmp_path):
    stream = _batches(spark, str(tmp_path / "in"), [[(1, 1, "create", 10), (2, 2, "create", 1)], [(2, 3, "update", 40)]])
    service = cq.CqService({"/rows": (stream, "k", "seq")})
    got, failed, status = [], [], []

    def sink(df, n):
        got.extend((r.k, r.query_op) for r in df.collect())
        raise RuntimeError("the listener fails")

    q = service.new_cq("big", "SELECT * FROM /rows r WHERE r.v > $1", sink, str(tmp_path / "cp"), 5, on_error=lambda df, e: failed.append(str(e)), on_status=status.append)
    with pytest.raises(ValueError, match="registered"):
        service.new_cq("big", "SELECT * FROM /rows", sink, str(tmp_path / "cp2"))
    assert q.state == "STOPPED"
    q.execute(availableNow=True).run.awaitTermination()
    seen = []
    stop = q.stop
    q.stop = lambda: (seen.append(q.state), stop())
    q.close()
    assert seen == ["CLOSING"] and q.state == "CLOSED" and status == ["connect", "disconnect"]
    assert sorted(got) == [(1, "create"), (2, "create")] and len(failed) == 2
    for bad in ("SELECT r.k FROM /rows r", "SELECT DISTINCT * FROM /rows", "SELECT * FROM /rows a, /rows b", "SELECT * FROM /nothing", "SELECT * FROM /rows LIMIT 3"):
        with pytest.raises(OqlError):
            service.predicate(bad)


def test_event_queue_remembers_over_restarts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "k int, seq int, v string")
    progress, seen, dead, taken = f"file://{tmp_path}/progress", [], [], []
    make = lambda answer: cq.EventQueue(lambda df, n, again: seen.append((n, again, sorted(r.v for r in df.collect()))) or answer(), keep=F.col("k") > 1, transmit=F.col("v") != "c", acknowledged=lambda df, n: taken.append(n), on_error=lambda df, e: dead.append(n_rows(df)), progress=progress)
    n_rows = lambda df: df.count()
    with pytest.raises(RuntimeError, match="did not take"):
        make(lambda: False)(rows, 4)
    make(lambda: True)(rows, 4)  # a new queue, as after a restart
    make(lambda: 1 / 0)(rows, 5)
    assert seen == [(4, False, ["b"]), (4, True, ["b"]), (5, False, ["b"])] and dead == [1] and taken == [4]


def test_write_behind(spark, tmp_path):
    path = str(tmp_path / "store.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v INTEGER)")
    con.execute("INSERT INTO t VALUES (9, 9), (2, 0)")
    con.commit()
    log = spark.createDataFrame([(1, 1, "create", 10), (1, 2, "update", 11), (2, 3, "destroy", None), (3, 4, "create", 30)], SCHEMA)
    sync = cq.DbSynchronizer(lambda: sqlite3.connect(path, timeout=30), "t", ["k"], "seq", ["k", "v"], partitions=2)
    queue = cq.EventQueue(sync)
    queue(log, 0)
    queue(log, 0)  # a batch can come twice
    assert sorted(con.execute("SELECT * FROM t").fetchall()) == [(1, 11), (3, 30), (9, 9)]


def test_callbacks(spark):
    assert procedures.tuple_filter(spark.range(10), lambda b: pd.Series([None if x == 3 else x > 1 for x in b["id"]])).count() == 7
    made = procedures.generated(spark, lambda part: pd.DataFrame({"i": [part] * part}), 4, "i long")
    assert sorted(r.i for r in made.collect()) == [1, 2, 2, 3, 3, 3]


def test_registered_window_numbers_without_one_task(spark):
    from tessera.queries import QUERIES

    plan = QUERIES["window_row_number"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan
    assert Catalog(spark, SF).load("orders").count() == QUERIES["window_row_number"](spark, SF).select("rn").distinct().count()
