"""Relational queries: dialect SQL (run through the dialect layer) and DuckDB SQL, the same text where possible."""

from __future__ import annotations

# Money as whole cents and rates as whole hundredths: products stay longs, which need no object a row.
EXT, DISC, TAX = "CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(round(l_discount * 100) AS BIGINT)", "CAST(round(l_tax * 100) AS BIGINT)"
QTY = "CAST(round(l_quantity * 100) AS BIGINT)"
NET = f"{EXT} * (100 - {DISC})"


def total(value: str, unit: int) -> str:
    """The exact sum of longs, in units of one ``unit``-th, as a double: upper and lower bits are summed apart, so that
    no number of rows overflows."""
    return f"CAST(CAST(sum(({value}) >> 20) AS DECIMAL(26,0)) * 1048576 + CAST(sum(({value}) & 1048575) AS DECIMAL(26,0)) AS DOUBLE) / {unit}e0"


REV = total(NET, 10_000)

#: name -> (dialect text, DuckDB text or None when the dialect text is plain SQL)
SQL: dict[str, tuple[str, str | None]] = {}


def add(name: str, text: str, duck: str | None = None) -> None:
    SQL[name] = (text, duck)


_Q1 = f"""SELECT l_returnflag, l_linestatus, {total(QTY, 100)} AS sum_qty, {total(EXT, 100)} AS sum_base_price,
 {REV} AS sum_disc_price, {total(f"{NET} * (100 + {TAX})", 1_000_000)} AS sum_charge,
 round({total(QTY, 100)} / count(*), 4) AS avg_qty, round({total(EXT, 100)} / count(*), 4) AS avg_price,
 round({total(DISC, 100)} / count(*), 4) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= {{}} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
add("q1_pricing_summary", _Q1.format("{fn timestampadd(SQL_TSI_DAY, -90, timestamp('1998-12-01 00:00:00'))}"), _Q1.format("TIMESTAMP '1998-12-01' - INTERVAL 90 DAY"))
_Q3 = f"""SELECT l_orderkey, {REV} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
 AND o_orderdate < {{0}} AND l_shipdate > {{0}} GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey {{1}}"""
add("q3_shipping_priority_topk", _Q3.format("timestamp('1995-03-15 00:00:00')", "FETCH FIRST 10 ROWS ONLY"), _Q3.format("TIMESTAMP '1995-03-15'", "LIMIT 10"))
_Q4 = """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= {0} AND o_orderdate < {1}
 AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity > 40) GROUP BY o_orderpriority ORDER BY o_orderpriority"""
add("q4_exists_shape", _Q4.format("timestamp('1995-01-01 00:00:00')", "{fn timestampadd(SQL_TSI_MONTH, 12, timestamp('1995-01-01 00:00:00'))}"), _Q4.format("TIMESTAMP '1995-01-01'", "TIMESTAMP '1995-01-01' + INTERVAL 12 MONTH"))
_Q5 = f"""SELECT n_name, {REV} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
 AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= {{0}} AND o_orderdate < {{1}} GROUP BY n_name ORDER BY revenue DESC"""
add("q5_local_supplier_volume", _Q5.format("timestamp('1994-01-01 00:00:00')", "{fn timestampadd(SQL_TSI_YEAR, 1, timestamp('1994-01-01 00:00:00'))}"), _Q5.format("TIMESTAMP '1994-01-01'", "TIMESTAMP '1995-01-01'"))
_Q6 = f"""SELECT {total(f"{EXT} * {DISC}", 10_000)} AS revenue FROM lineitem WHERE l_shipdate >= {{0}} AND l_shipdate < {{1}} AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""
add("q6_forecast_revenue", _Q6.format("timestamp('1994-01-01 00:00:00')", "{fn timestampadd(SQL_TSI_YEAR, 1, timestamp('1994-01-01 00:00:00'))}"), _Q6.format("TIMESTAMP '1994-01-01'", "TIMESTAMP '1995-01-01'"))
add("q12_conditional_counts", "SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_returnflag")
add("q14_conditional_share", f"SELECT round(100.0 * {total(f"CASE WHEN p_type LIKE 'PROMO%' THEN {NET} ELSE 0 END", 10_000)} / ({REV}), 4) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey")

# Sources and projection
add("scan_table", "SELECT * FROM nation")
add("scan_in_list_probe", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 32, 33, 64, 1000)")
add("primary_key_get", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
add("composite_key_get", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 1 AND l_linenumber = 1")
add("values_constructor", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(i, s)")
add("project_star", "SELECT n.*, r.r_name FROM nation n, region r WHERE n_regionkey = r_regionkey")
add("project_expression", "SELECT p_partkey, p_size + 1 AS plus_one, -p_size AS negated, +p_size AS same, p_size * 2 - 3 AS mixed FROM part")
add("project_literals", "SELECT 'ZZ' AS tag, n_name, -99 AS code FROM nation")
add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("select_all_bag", "SELECT ALL o_orderstatus FROM orders")
add("scalar_subquery_select", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation")

# Filters
add("filter_compare", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_retailprice >= 1000 OR NOT (p_size <> 1)")
add("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12")
add("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 3 AND 48")
add("filter_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
add("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O%' AND p_brand LIKE 'Brand#_2'")
add("filter_is_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
add("filter_is_not_null", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
add("filter_case_when", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 300000 ELSE o_totalprice > 400000 END")
add("filter_boolean_precedence", "SELECT n_nationkey, (n_nationkey IN (1, 2, 3)) = (1 = 1) AS listed, (n_nationkey BETWEEN 1 AND 5) IS NOT NULL AS known FROM nation")
add("filter_constant_predicate", "SELECT r_name FROM region WHERE 1 = 1 AND 2 + 3 = 5")
add("filter_in_subquery_nested", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE' AND r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')))))))))")
add("filter_scalar_subquery", "SELECT o_orderkey FROM orders WHERE (SELECT max(o_totalprice) FROM orders) * 0.9 < o_totalprice")
add("filter_correlated_aggregate", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_quantity < (SELECT sum(b.l_quantity) / 50000 FROM lineitem b WHERE b.l_returnflag = l.l_returnflag)", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT l_returnflag, sum(l_quantity) / 50000 AS q FROM lineitem GROUP BY l_returnflag) b ON b.l_returnflag = l.l_returnflag WHERE l.l_quantity < b.q")
add("filter_scalar_subquery_null", "SELECT n_nationkey FROM nation WHERE (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) IS NULL")

# Joins
add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_hash", "SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
add("join_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
add("join_right_outer", "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
add("join_semi_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT * FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
add("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
add("join_theta", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("join_self", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
add("join_cartesian", "SELECT r_name, n_name FROM region, nation")
add("join_multiway", "SELECT r1.r_name AS r, count(*) AS n FROM region r1, nation n1, customer, orders, lineitem, part, supplier, nation n2, region r2, nation n3 WHERE n3.n_nationkey = n1.n_nationkey AND r1.r_regionkey = n1.n_regionkey AND n1.n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r1.r_regionkey <> r2.r_regionkey AND p_size < 10 GROUP BY r1.r_name")
add("join_broadcast_replicated", "SELECT n_name, count(*) AS suppliers FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY n_name")
add("join_expression_key", "SELECT o_orderkey FROM orders WHERE o_orderstatus || CAST(o_custkey AS VARCHAR(20)) IN (SELECT 'F' || CAST(c_custkey AS VARCHAR(20)) FROM customer WHERE c_acctbal < 0)")
add("join_or_condition", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey OR n.n_nationkey = r.r_regionkey")

# Aggregation
add("agg_ungrouped", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(o_totalprice), 4) AS mean FROM orders", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")
add("agg_count_nulls", "SELECT count(*) AS rows_all, count(o_orderkey) AS with_order, count(ALL c_custkey) AS customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "SELECT count(*) AS rows_all, count(o_orderkey) AS with_order, count(c_custkey) AS customers FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
add("agg_group_multi", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
add("agg_group_expression", "SELECT CAST(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS INTEGER) AS big, count(*) AS n FROM orders GROUP BY CAST(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS INTEGER)")
add("agg_group_no_aggregate", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment")
add("agg_empty_groups", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus")
add("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 3 AND max(c_acctbal) > 5000")
add("agg_having_in_subquery", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) IN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1)")
add("agg_having_no_group", "SELECT max(c_acctbal) AS m FROM customer HAVING count(*) > 1")
add("agg_nested_view", "SELECT max(a) AS most FROM (SELECT c_nationkey, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY c_nationkey) v")
add("agg_max_distinct", "SELECT -max(DISTINCT p_size) AS m, +min(DISTINCT p_size) AS k FROM part")
add("agg_avg_scale", "SELECT o_orderstatus, round(CAST(avg(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE), 4) AS mean FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*), 4) AS mean FROM orders GROUP BY o_orderstatus")

# Windows, order, limits, sets
add("window_row_number_partitioned", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders")
add("sort_nulls_last", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey ASC NULLS LAST, c_custkey")
add("sort_nulls_first", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey DESC NULLS FIRST, c_custkey")
add("sort_ordinal", "SELECT n_regionkey, n_name FROM nation ORDER BY 2")
add("sort_expression", "SELECT p_size + p_partkey AS c FROM part ORDER BY 1 DESC")
add("fetch_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all_widening", "SELECT CAST(n_nationkey AS INTEGER) AS x, CAST(n_name AS VARCHAR(30)) AS s FROM nation UNION ALL SELECT CAST(p_retailprice AS DOUBLE), p_name FROM part WHERE p_size = 1")
add("intersect_rows", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
add("except_rows", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_T = "(VALUES (3), (2), (1)) AS t1(i)", "(VALUES (1), (2), (3), (4)) AS t2(j)", "(VALUES (5), (2), (3), (4), (1)) AS t3(k)"
add("set_precedence", f"SELECT i AS x FROM {_T[0]} UNION SELECT j FROM {_T[1]} INTERSECT SELECT k FROM {_T[2]}")
add("set_union_except", f"SELECT i AS x FROM {_T[0]} UNION SELECT j FROM {_T[1]} EXCEPT SELECT k FROM {_T[2]}")
add("set_intersect_except", f"SELECT i AS x FROM {_T[0]} INTERSECT SELECT j FROM {_T[1]} EXCEPT SELECT k FROM {_T[2]}")

# Scalars
add("arith_operators", "SELECT o_orderkey, INTDIV(o_orderkey, 7) AS d, o_orderkey % 7 AS m, -o_orderkey AS neg, round(o_totalprice / 3, 4) AS third FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m, -o_orderkey AS neg, round(o_totalprice / 3, 4) AS third FROM orders")
add("str_concat_null", "SELECT n_name || '-' || CAST(n_nationkey AS VARCHAR(5)) AS a, n_name || CAST(NULL AS VARCHAR(5)) AS b FROM nation")
add("str_substr_locate_length", "SELECT p_partkey, substr(p_name, 2, 5) AS mid, substr(p_name, 3) AS tail, LOCATE('e', p_name) AS at, CHAR_LENGTH(p_name) AS n FROM part", "SELECT p_partkey, substr(p_name, 2, 5) AS mid, substr(p_name, 3) AS tail, CAST(strpos(p_name, 'e') AS INTEGER) AS at, CAST(length(p_name) AS INTEGER) AS n FROM part")
add("str_case", "SELECT n_nationkey, {fn UCASE(n_name)} AS u, {fn LCASE(n_name)} AS l FROM nation", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
add("cast_matrix", "SELECT CAST('12' AS INTEGER) AS i, CAST(12 AS VARCHAR(4)) AS s, CAST('-7.02' AS DECIMAL(5,2)) AS d, CAST(3 AS DOUBLE) AS f, CAST(5.2419 AS DECIMAL(5,3)) AS r")
add("ts_add_units", "SELECT o_orderkey, {fn timestampadd(SQL_TSI_DAY, 10, o_orderdate)} AS d, {fn timestampadd(SQL_TSI_MONTH, -2, o_orderdate)} AS m, {fn timestampadd(SQL_TSI_YEAR, 1, o_orderdate)} AS y FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate - INTERVAL 2 MONTH AS m, o_orderdate + INTERVAL 1 YEAR AS y FROM orders")
add("ts_parts", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, CAST(second(o_orderdate) AS INTEGER) AS s, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS ey FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(minute(o_orderdate) AS INTEGER) AS mi, CAST(second(o_orderdate) AS INTEGER) AS s, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS ey FROM orders")
add("ts_constructors", "SELECT o_orderkey FROM orders WHERE o_orderdate >= timestamp('1996-01-01 00:00:00') AND CAST(o_orderdate AS DATE) < date('1996-02-01')", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1996-02-01'")
add("month_partition_function", "SELECT month(o_orderdate) AS bucket, count(*) AS n FROM orders GROUP BY month(o_orderdate)", "SELECT CAST(month(o_orderdate) AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1")

# Forms that come with the engine underneath
add("filter_like_escape", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1!_' ESCAPE '!' OR p_brand LIKE 'Brand#1_' AND p_name NOT LIKE '%!_%' ESCAPE '!'")
add("filter_any", "SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT p_retailprice FROM part WHERE p_size = 1) AND p_size = SOME (SELECT n_nationkey FROM nation)")
add("filter_all", "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5) AND s_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
add("filter_all_of_nothing", "SELECT n_nationkey FROM nation WHERE n_nationkey < ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal < -1000000)")
add("join_full_outer", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
add("join_cross_keyword", "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
add("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
add("join_sort_merge", "SELECT /*+ MERGE(orders) */ c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
add("join_left_outer_hash", "SELECT /*+ SHUFFLE_HASH(orders) */ c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice < 0")
add("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
add("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
add("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
add("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("agg_deviation", "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 2) AS sd, round(var_pop(o_totalprice) / 1000000, 2) AS v FROM orders GROUP BY o_orderstatus")
add("agg_percentile", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderstatus")
add("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("window_rank", "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS BIGINT) AS d FROM supplier")
add("window_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders")
add("window_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM orders")
add("fetch_offset", "SELECT n_name FROM nation ORDER BY n_name OFFSET 5 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT n_name FROM nation ORDER BY n_name LIMIT 4 OFFSET 5")
add("intersect_all_rows", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
add("except_all_rows", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("str_trim", "SELECT n_nationkey, TRIM('  ' || n_name || ' ') AS t, LTRIM('  ' || n_name) AS l, RTRIM(n_name || '  ') AS r, REPLACE(n_name, 'A', 'aa') AS p FROM nation")
add("scalar_functions", "SELECT s_suppkey, COALESCE(NULLIF(s_nationkey, 3), -1) AS c, ABS(s_acctbal) AS a, MOD(s_suppkey, 7) AS m, round(SQRT(s_suppkey), 6) AS q, CAST(FLOOR(s_acctbal) AS BIGINT) AS f, CAST(CEIL(s_acctbal) AS BIGINT) AS e, round(SIN(s_suppkey) + COS(s_suppkey), 6) AS t FROM supplier")
add("ts_diff", "SELECT o_orderkey, CAST({fn timestampdiff(SQL_TSI_DAY, timestamp('1990-01-01 00:00:00'), o_orderdate)} AS BIGINT) AS d FROM orders", "SELECT o_orderkey, CAST(date_sub('day', TIMESTAMP '1990-01-01', o_orderdate) AS BIGINT) AS d FROM orders")
add("ts_current", "SELECT count(*) AS n FROM orders WHERE o_orderdate < CURRENT_TIMESTAMP AND CAST(o_orderdate AS DATE) <= CURRENT_DATE")
add("session_values", "SELECT n_nationkey, USER IS NOT NULL AS has_user, CURRENT SCHEMA IS NOT NULL AS has_schema, DSID() IS NOT NULL AS has_member FROM nation", "SELECT n_nationkey, TRUE AS has_user, TRUE AS has_schema, TRUE AS has_member FROM nation")
add("bit_concat", "SELECT n_nationkey, hex(X'01' || X'FF0A') AS h FROM nation")
add("cast_assignment", "SELECT CAST(a AS INTEGER) AS i, CAST(a AS DECIMAL(5,3)) AS d FROM (VALUES (CAST(3.1416 AS DOUBLE)), (CAST(5.2413 AS DOUBLE)), (CAST(2.1 AS DOUBLE))) AS t(a)")
add("xml_xpath", "SELECT n_nationkey, xpath_string('<n><name>' || n_name || '</name><r>' || n_regionkey || '</r></n>', 'n/name') AS name, xpath_int('<n><r>' || n_regionkey || '</r></n>', 'n/r') AS r FROM nation", "SELECT n_nationkey, n_name AS name, n_regionkey AS r FROM nation")
