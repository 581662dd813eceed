"""Queries through definitions, indexes, statistics, routines and joins of the engine's own."""

from __future__ import annotations

import datetime
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import compat, jsonpath
from tessera.operators import database, dml, indexes, joins, procedures, retention, statistics
from tessera.oql import Region, Regions
from tessera.plans import Catalog
from tessera.plans.placement import placement
from tessera.queries.engine import _log, query
from tessera.sources import loader
from tessera.streaming import cq

# Definitions


@query("SELECT n_nationkey AS k, 'none' AS note, n_name AS name FROM nation")
def ddl_create_table(c: Catalog) -> DataFrame:
    db = database.Database(c.spark)
    db.create_table("t", "k int, note string, name string", {"note": F.lit("none")}, dml.Constraints(primary_key=("k",)))
    db.insert("t", c.load("nation").selectExpr("n_nationkey AS k", "n_name AS name"))
    return db.rows("t")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_regionkey + 100, 'later' FROM region")
def ddl_alter_columns(c: Catalog) -> DataFrame:
    """DROP COLUMN, then a DEFAULT that counts for rows inserted afterwards."""
    db = database.Database(c.spark)
    db.create_table_as("n", c.load("nation").where("n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey"))
    db.drop_column("n", "n_regionkey")
    db.set_default("n", "n_name", F.lit("later"))
    db.insert("n", c.load("region").select((F.col("r_regionkey") + 100).alias("n_nationkey")))
    return db.rows("n")


@query("SELECT table_name AS tablename, CAST(count(*) AS INTEGER) AS n_columns FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'orders') GROUP BY table_name")
def system_tables(c: Catalog) -> DataFrame:
    db = database.Database(c.spark)
    for t in ("nation", "region", "orders", "supplier"):
        db.create_table_as(t, c.load(t))
    db.drop_table("supplier")
    return db.systables().select("tablename", "n_columns")


@query("SELECT column_name AS columnname, CAST(ordinal_position AS INTEGER) AS columnnumber FROM information_schema.columns WHERE table_name = 'supplier'")
def system_columns(c: Catalog) -> DataFrame:
    db = database.Database(c.spark)
    db.create_table_as("supplier", c.load("supplier"))
    return db.syscolumns().select("columnname", "columnnumber")


@query("SELECT * FROM region WHERE 1 = 0")
def ctas_no_data(c: Catalog) -> DataFrame:
    db = database.Database(c.spark)
    db.create_table_as("empty", c.load("region"), data=False)
    return db.rows("empty")


@query("SELECT r_name FROM region")
def ddl_synonym_schema(c: Catalog) -> DataFrame:
    db = database.Database(c.spark)
    db.create_schema("trade")
    db.create_table_as("trade.areas", c.load("region"))
    db.create_synonym("places", "trade.areas")
    db.create_synonym("app.spots", "places")
    return db.rows("spots").select("r_name")


@query("SELECT * FROM (VALUES ('a', 'partitioned', 'column', 'context_id', 7, 1), ('b', 'replicated', NULL, '', NULL, 0), ('c', 'partitioned', 'range', 'd', NULL, 2)) t(name, kind, method, columns, buckets, redundancy)")
def placement_clauses(c: Catalog) -> DataFrame:
    ddl = {
        "a": "CREATE TABLE a (context_id INT, s VARCHAR(9) DEFAULT 'REPLICATE') PARTITION BY COLUMN (context_id) COLOCATE WITH (b) BUCKETS 7 REDUNDANCY 1 PERSISTENT",
        "b": "CREATE TABLE b (x INT) REPLICATE SERVER GROUPS (g1, g2) EXPIRE ENTRY WITH TIMETOLIVE 270 ACTION DESTROY",
        "c": "CREATE TABLE c (d DATE) PARTITION BY RANGE (d) REDUNDANCY 2 OFFHEAP EVICTION BY LRUCOUNT 5 EVICTACTION OVERFLOW",
    }
    read = [(k, placement(v)) for k, v in ddl.items()]
    return c.spark.createDataFrame([(k, p.kind, p.method, ",".join(p.columns), p.buckets, p.redundancy) for k, p in read], "name string, kind string, method string, columns string, buckets int, redundancy int")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def join_colocated(c: Catalog) -> DataFrame:
    """Both tables lie in buckets of the order key, so that the join moves no row."""
    tag = f"{abs(hash(c.base)) % 10**9}_{c.spark.sparkContext.applicationId.replace('-', '_')}"
    orders = database.colocate(f"tessera_orders_{tag}", c.load("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 8)
    items = database.colocate(f"tessera_items_{tag}", c.load("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 8)
    return orders.where("o_orderstatus = 'P'").join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber")


# Changes


@query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier")
def dml_delete_set_default(c: Catalog) -> DataFrame:
    _, children = dml.delete_parents(c.load("nation"), c.load("supplier"), F.col("n_regionkey") == 2, "n_nationkey", "s_nationkey", "set default", F.lit(0))
    return children.select("s_suppkey", "s_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey < 25")
def dml_delete_no_action(c: Catalog) -> DataFrame:
    """No parent is referred to, so the delete goes through."""
    parents, _ = dml.delete_parents(c.load("nation"), c.load("supplier"), F.col("n_nationkey") >= 25, "n_nationkey", "s_nationkey", "no action")
    return parents.select("n_nationkey")


@query("SELECT n_nationkey, upper(left(n_name, 3)) AS n_name FROM nation WHERE n_regionkey <> 3")
def trigger_before_insert(c: Catalog) -> DataFrame:
    new = c.load("nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = dml.before(new, [lambda n: n.withColumn("n_name", F.upper(F.substring("n_name", 1, 3))), lambda n: n.where("n_regionkey <> 3")])
    return dml.insert(new.limit(0), rows).select("n_nationkey", "n_name")


def _audit(c: Catalog, action) -> DataFrame:
    old = c.load("nation").select("n_nationkey", "n_name")
    new = old.where("n_nationkey >= 4").unionByName(old.where("n_nationkey < 3").withColumn("n_nationkey", F.col("n_nationkey") + 50))
    return dml.fire(dml.changes(old, new, ["n_nationkey"]), [action])[action.name]


@query("SELECT n_nationkey + 50 AS k, n_name AS name FROM nation WHERE n_nationkey < 3")
def trigger_after_insert(c: Catalog) -> DataFrame:
    return _audit(c, dml.Trigger("in", ("insert",), lambda log: log.select(F.col("n_nationkey").alias("k"), F.col("new.n_name").alias("name"))))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 4")
def trigger_after_delete(c: Catalog) -> DataFrame:
    return _audit(c, dml.Trigger("out", ("delete",), lambda log: log.select(F.col("n_nationkey").alias("k"), F.col("old.n_name").alias("name"))))


@query("SELECT 'delete' AS op, 4::BIGINT AS n UNION ALL SELECT 'insert', 3::BIGINT")
def trigger_statement(c: Catalog) -> DataFrame:
    return _audit(c, dml.Trigger("all", ("insert", "delete"), lambda log: log.groupBy("op").agg(F.count("*").alias("n")), each_row=False))


@query("SELECT max(n_nationkey) + (SELECT count(*) FROM region) AS identity_val_local FROM nation")
def identity_val_local(c: Catalog) -> DataFrame:
    target = c.load("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return dml.insert_identity(target, c.load("region").select(F.col("r_name").alias("n_name")), "n_nationkey", ["n_name"])[1]


@query("SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_acctbal >= 0")
def cursor_positioned(c: Catalog) -> DataFrame:
    """updateRow on some rows, deleteRow on the others."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["s_acctbal"] >= 0].copy()
        rows["s_acctbal"] += 1
        return rows

    return dml.positioned(c.load("supplier").select("s_suppkey", "s_acctbal"), each)


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= (SELECT avg(s_acctbal) FROM supplier) UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal >= (SELECT avg(s_acctbal) FROM supplier)")
def dml_deferred(c: Catalog) -> DataFrame:
    """DELETE and INSERT that read the table they change, from rows held apart first."""
    own = c.load("supplier").select("s_suppkey", "s_acctbal")
    low = dml.deferred(own.crossJoin(F.broadcast(own.agg(F.avg("s_acctbal").alias("m")))).where("s_acctbal < m").select("s_suppkey"))
    left = dml.delete_exists(own, low, "s_suppkey")
    return dml.insert(left, dml.deferred(left.withColumn("s_suppkey", F.col("s_suppkey") + 1000000))).select("s_suppkey")


# Retention

_RECENT = "SELECT event_id FROM (SELECT event_id, sum(100 + length(event_type)) OVER (ORDER BY ts DESC, event_id DESC) AS s FROM events) WHERE s <= {}"


@query(_RECENT.format("50000"))
def evict_lru_memsize(c: Catalog) -> DataFrame:
    return retention.keep_bytes(c.load("events"), 50_000, 100 + F.length("event_type"), "ts", "event_id")[0].select("event_id")


@query(_RECENT.format("(SELECT sum(100 + length(event_type)) * 0.9 FROM events)").replace("SELECT event_id FROM (", "SELECT event_id, s > (SELECT sum(100 + length(event_type)) * 0.9 FROM events) AS overflow FROM (").split(" WHERE s")[0])
def evict_lru_heap_overflow(c: Catalog) -> DataFrame:
    """LRUHEAPPERCENT 90 with OVERFLOW: the oldest rows lie elsewhere and are still read."""
    events, size = c.load("events"), 100 + F.length("event_type")
    kept, over = retention.keep_bytes(events, events.agg(F.sum(size) * 0.9), size, "ts", "event_id")
    return kept.select("event_id", F.lit(False).alias("overflow")).unionByName(over.select("event_id", F.lit(True).alias("overflow")))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - CASE WHEN event_type = 'click' THEN INTERVAL 3 DAY WHEN event_type = 'view' THEN INTERVAL 10 DAY ELSE INTERVAL 36500 DAY END")
def ttl_custom(c: Catalog) -> DataFrame:
    """Each row has a limit of its own; null never expires."""
    events = c.load("events")
    now = events.agg(F.max("ts").alias("__now"))
    limit = F.when(F.col("event_type") == "click", 3 * 86_400).when(F.col("event_type") == "view", 10 * 86_400)
    return retention.expire(events.crossJoin(F.broadcast(now)), "ts", limit, F.col("__now")).select("event_id")


# Plans and statistics


@query("SELECT * FROM (VALUES (0, 'Aggregate'), (1, 'Project'), (2, 'Filter')) t(id, operator)")
def explain_plan(c: Catalog) -> DataFrame:
    return statistics.explain(c.sql("SELECT count(*) AS n FROM supplier WHERE s_nationkey = 1")).where("id < 3").select("id", "operator")


@query("SELECT 'Filter' AS operator, count(*) AS rows FROM supplier WHERE s_acctbal > 0")
def runtime_statistics(c: Catalog) -> DataFrame:
    return statistics.runtime_statistics(c.sql("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")).where("operator = 'Filter'").select("operator", "rows")


@query("SELECT 'join' AS seen, count(*) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 UNION ALL SELECT 'left', count(*) FROM supplier WHERE s_acctbal > 0")
def join_rows_seen(c: Catalog) -> DataFrame:
    """What a join put out, and what its left side brought to it."""
    rows = statistics.runtime_statistics(c.sql("SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0"))
    return rows.where("operator IN ('BroadcastHashJoin', 'Filter') AND rows > 25 OR operator = 'BroadcastHashJoin'").groupBy(F.when(F.col("operator") == "Filter", "left").otherwise("join").alias("seen")).agg(F.max("rows").alias("rows"))


@query("SELECT 'l_linenumber' AS \"column\", count(*) AS rows, count(*) - count(l_linenumber) AS nulls, count(DISTINCT l_linenumber) AS \"distinct\" FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), count(DISTINCT l_returnflag) FROM lineitem")
def update_statistics(c: Catalog) -> DataFrame:
    return statistics.column_statistics(c.load("lineitem"), ["l_linenumber", "l_returnflag"]).drop("selectivity")


# Indexes


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def index_hash(c: Catalog) -> DataFrame:
    return indexes.hash_index(c.load("customer"), ("c_mktsegment", "c_nationkey"), ("c_custkey", "c_name")).get("BUILDING", 3).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def index_global_hash(c: Catalog) -> DataFrame:
    """A unique key that is not the partitioning key: its entries hold the primary key, by which the row is read."""
    customer = c.load("customer")
    entries = indexes.hash_index(customer, ("c_name",), ("c_custkey",), unique=True)
    found = entries.get(customer.agg(F.min("c_name")).first()[0])
    return customer.join(F.broadcast(found.select("c_custkey")), "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 1000 AND 5000")
def index_sorted(c: Catalog) -> DataFrame:
    return indexes.sorted_index(c.load("supplier"), ("s_acctbal", "s_suppkey"), (), descending=True).between(1000, 5000).select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 4 AND s_acctbal > 0")
def index_map_range(c: Catalog) -> DataFrame:
    """m['nation'] = 4 over a map of each supplier, through the index of its entries."""
    rows = c.load("supplier").where("s_acctbal > 0").select("s_suppkey", F.create_map(F.lit("nation"), F.col("s_nationkey"), F.lit("key"), F.col("s_suppkey").cast("int")).alias("m"))
    return indexes.map_index(rows, "m", ("s_suppkey",)).get("nation", 4).select("s_suppkey")


# Filters and joins


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND length(p_name) > 10")
def filter_tuple_callback(c: Catalog) -> DataFrame:
    return procedures.tuple_filter(c.load("part").select("p_partkey", "p_size", "p_name"), lambda b: (b["p_size"] % 2 == 0) & (b["p_name"].str.len() > 10)).select("p_partkey")


_LEFT = "FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"


@query(f"SELECT c_custkey, o_orderkey {_LEFT} WHERE o_orderkey IS NULL OR o_orderkey >= 30000")
def filter_qualifier(c: Catalog) -> DataFrame:
    """Ordered nulls: null is above every value, so NOT (o_orderkey < 30000) keeps it."""
    rows = c.sql(f"SELECT c_custkey, o_orderkey {_LEFT}")
    return rows.where(compat.qualifier(F.col("o_orderkey"), "<", F.lit(30000), negate=True, ordered_nulls=True))


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_regionkey = 3 AND n_name LIKE '%A%'")
def filter_routing_constants(c: Catalog) -> DataFrame:
    """Constants of the partition column reach the folders, through AND and OR."""
    from tessera.sources.shared import new_path

    path = new_path(c.spark, "routed")
    c.load("nation").write.partitionBy("n_regionkey").parquet(path)
    return joins.routed(c.spark.read.parquet(path), (F.col("n_regionkey") == 1) | (F.col("n_regionkey") == 3) & F.col("n_name").contains("A")).select("n_nationkey")


@query("SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'")
def join_asof(c: Catalog) -> DataFrame:
    events = c.load("events")
    return joins.asof_join(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), events.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", {"event_id": "purchase"}).select("event_id", "purchase")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 10")
def join_interval(c: Catalog) -> DataFrame:
    spans = c.load("supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 10).alias("high"))
    return joins.interval_join(c.load("part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "low", "high", 10).select("p_partkey", "s_suppkey")


# Scalars


@query("SELECT n_nationkey, upper(replace(lower(n_name), 'i', '\u0130')) AS u FROM nation")
def str_case_turkish(c: Catalog) -> DataFrame:
    return c.load("nation").select("n_nationkey", compat.upper(F.lower("n_name"), "tr").alias("u"))


@query("SELECT n_nationkey, substr(n_name, 1, 6) AS s FROM nation")
def cast_width(c: Catalog) -> DataFrame:
    return c.load("nation").select("n_nationkey", compat.width(F.col("n_name"), 6).alias("s"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1996-03-09 12:30:00'")
def oql_mixed_temporal(c: Catalog) -> DataFrame:
    """A timestamp attribute against a date and a timestamp."""
    rows = Regions(c.spark, {"/orders": Region(c.load("orders"), "o_orderkey")})
    return rows.query("SELECT o.o_orderkey AS id FROM /orders o WHERE o.o_orderdate > $1 AND o.o_orderdate <= $2", datetime.date(1996, 3, 1), datetime.datetime(1996, 3, 9, 12, 30))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey > 5 AND n_regionkey = 1")
def oql_query_in_from(c: Catalog) -> DataFrame:
    rows = Regions(c.spark, {"/nations": Region(c.load("nation"), "n_nationkey")})
    return rows.query("SELECT q.n_nationkey AS id FROM (SELECT * FROM /nations WHERE n_regionkey = 1) q WHERE q.n_nationkey > 5")


@query("SELECT n_nationkey, ['$[''n'']', '$[''t''][0]', '$[''t''][1]'] AS p FROM nation")
def json_as_paths(c: Catalog) -> DataFrame:
    j = F.to_json(F.struct(F.col("n_name").alias("n"), F.array("n_regionkey", "n_nationkey").alias("t")))
    both = F.concat(jsonpath.paths(j, "$.n"), jsonpath.paths(j, "$.t[*]"))
    return c.load("nation").select("n_nationkey", both.alias("p"))


@query("SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"r\":' || n_regionkey || '}' AS m FROM nation")
def json_merge_properties(c: Catalog) -> DataFrame:
    j = F.to_json(F.struct(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"), F.col("n_regionkey").alias("r")).alias("a")))
    return c.load("nation").select("n_nationkey", jsonpath.merged(j, "$.a['k','r','absent']").alias("m"))


# Routines and sources


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def procedure_result_set(c: Catalog) -> DataFrame:
    """Of two procedures of one name the call's parameters choose; it gives an OUT value and a result set."""
    p = procedures.Procedures(c.spark)

    def by_number(spark, result, least: int) -> None:
        result.out["least"] = least
        result.result_sets.append(c.load("nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).where(F.col("n") >= least))

    p.create("counts", by_number, (int,), most_result_sets=1)
    p.create("counts", lambda spark, result, name: None, (str,), most_result_sets=1)
    return p.call("counts", 1).result_sets[0]


def _logs(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[rows["o_totalprice"] > 0]
    out = rows.assign(s=rows["o_totalprice"].map(math.log), n=1).groupby("o_orderstatus", as_index=False)[["s", "n"]].sum()
    return out.astype({"n": "int64"})


@query("SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS geometric FROM orders WHERE o_totalprice > 0 GROUP BY o_orderstatus")
def udaf_geometric_mean(c: Catalog) -> DataFrame:
    return procedures.aggregate(c.load("orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], _logs, "o_orderstatus string, s double, n long", {"s": "sum", "n": "sum"}, {"geometric": "round(exp(s / n), 2)"})


@query("SELECT CAST(i AS INTEGER) AS i, CAST(i * i AS INTEGER) AS square FROM range(0, 30) t(i)")
def rows_from_callback(c: Catalog) -> DataFrame:
    fetch = lambda part: pd.DataFrame({"i": range(10 * part, 10 * part + 10)}).assign(square=lambda d: d["i"] ** 2).astype("int32")
    return procedures.generated(c.spark, fetch, 3, "i int, square int")


@query("SELECT CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, count(*) AS n FROM range(0, 40) t(i) GROUP BY 1")
def vti_projection_push(c: Catalog) -> DataFrame:
    if c.spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        c.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    c.spark.dataSource.register(loader.RowsSource)
    return c.spark.read.format("tessera_rows").option("rows", 40).option("columns", "parity").load().groupBy("parity").agg(F.count("*").alias("n"))


# Continuous queries by their text

_CQ = "WITH l AS (SELECT user_id, event_id, value, CASE WHEN event_id % 11 = 0 THEN 'destroy' WHEN event_id % 3 = 0 THEN 'create' ELSE 'update' END AS op FROM events), m AS (SELECT *, coalesce(value > 20 AND value < 60, false) AND op <> 'destroy' AS inside FROM l), w AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM m) SELECT user_id, event_id, CASE WHEN inside AND NOT was THEN 'create' WHEN inside THEN 'update' ELSE 'destroy' END AS query_op FROM w WHERE inside OR was"


@query(_CQ)
def cq_by_text(c: Catalog) -> DataFrame:
    service = cq.CqService({"/events": (_log(c), "user_id", "event_id")})
    return service.events("SELECT * FROM /events e WHERE e.value > 20 AND e.value < $1", 60).select("user_id", "event_id", "query_op")
