"""Registered queries: one per operator, with the SQL that DuckDB can hold it against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table, register
from .analysis import relations
from .policy_views import swap_names
from .registry import QUERIES, SQL, query
from .rewrite import rewrite
from .tokens import parse, text


def run(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **kw) -> DataFrame:
    """Warehouse-dialect SQL over lake tables."""
    register(spark, sf_dir, *tables)
    return spark.sql(bound(rewrite(sql, **kw), tables))


def bound(sql: str, tables: tuple[str, ...]) -> str:
    """Qualified relations to the views registered for them."""
    items = parse(sql)
    names = {id(r.tokens[0]): (r.parts[-1], 2 * (len(r.parts) - 1)) for r in relations(items) if len(r.parts) > 1 and r.parts[-1] in tables}
    return text(swap_names(items, names))


def warehouse(name: str, sql: str, duck: str | None, *tables: str) -> None:
    """A query written in the warehouse dialect; duck is None where the same text means the same in DuckDB."""
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, sql, *tables)
    SQL[name] = duck or sql


# Benchmark shapes

warehouse(
    "filter_project_limit",
    "SELECT event_id, user_id, value FROM analytics.public.events WHERE event_type = 'click' AND value > 10 ORDER BY value DESC, event_id LIMIT 100",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 10 ORDER BY value DESC, event_id LIMIT 100",
    "events",
)
_JOINED = "SELECT e.event_id, c.c_name, c.c_mktsegment, e.value FROM {}events e JOIN {}customer c ON e.user_id = c.c_custkey WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND e.value > 20"
warehouse("selective_join", _JOINED.format("analytics.public.", "analytics.public."), _JOINED.format("", ""), "events", "customer")
warehouse(
    "daily_agg",
    "SELECT DATE_TRUNC(day, ts) AS d, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM analytics.public.events GROUP BY 1",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "events",
)
warehouse("topn_users", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10", None, "events")

# Aggregates

warehouse(
    "agg_all_families",
    """SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 8) AS disc,
      MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi, ROUND(STDDEV(l_quantity), 6) AS sd, ROUND(STDDEV_POP(l_quantity), 6) AS sdp, ROUND(STDDEV_SAMP(l_quantity), 6) AS sds,
      ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(VARIANCE(l_quantity), 6) AS v, ROUND(CORR(l_quantity, l_extendedprice), 6) AS r,
      ROUND(COVAR_POP(l_quantity, l_tax), 6) AS cp, ROUND(COVAR_SAMP(l_quantity, l_tax), 6) AS cs, ROUND(MEDIAN(l_extendedprice), 4) AS med,
      BIT_AND(l_linenumber) AS ba, BIT_OR(l_linenumber) AS bo, BIT_XOR(l_linenumber) AS bx, BOOLAND_AGG(l_quantity > 0) AS every_one, BOOLOR_AGG(l_discount > 0.09) AS some_one
      FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 8) AS disc,
      min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(stddev_samp(l_quantity), 6) AS sds,
      round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(variance(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r,
      round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(median(l_extendedprice), 4) AS med,
      bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx, bool_and(l_quantity > 0) AS every_one, bool_or(l_discount > 0.09) AS some_one
      FROM lineitem GROUP BY l_returnflag""",
    "lineitem",
)
warehouse(
    "agg_ordered_set",
    "SELECT l_linestatus, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90, PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY l_quantity) AS d50 FROM lineitem GROUP BY l_linestatus",
    "SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_quantity, 0.5) AS d50 FROM lineitem GROUP BY l_linestatus",
    "lineitem",
)
warehouse(
    "agg_collections",
    "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, ARRAY_JOIN(ARRAY_SORT(ARRAY_AGG(n_name)), '|') AS sorted_names, SIZE(MAP_FROM_ENTRIES(COLLECT_LIST(STRUCT(n_name, n_nationkey)))) AS entries FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, array_to_string(list_sort(list(n_name)), '|') AS sorted_names, CAST(count(DISTINCT n_name) AS INTEGER) AS entries FROM nation GROUP BY n_regionkey",
    "nation",
)
warehouse("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", None, "orders")
warehouse("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None, "orders")
warehouse("count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus", None, "orders")
warehouse(
    "approx_distinct",
    "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS exact, ABS(APPROX_COUNT_DISTINCT(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.15 * COUNT(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.3 * count(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderstatus",
    "orders",
)
warehouse("any_value_agg", "SELECT o_custkey, ANY_VALUE(o_custkey * 10 + 1) AS v, COUNT(*) AS n FROM orders GROUP BY o_custkey", None, "orders")
for _name, _group in (("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    _text = f"SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS gs, CAST(GROUPING(o_orderpriority) AS INT) AS gp, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY {_group}"
    warehouse(_name, _text, None, "orders")
warehouse("group_by_ordinal", "SELECT o_orderpriority, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY 1, 2", "SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1, 2", "orders")
warehouse("filtered_agg", "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted, SUM(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS taxed FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, CAST(sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS taxed FROM lineitem GROUP BY l_returnflag", "lineitem")

# Joins and subqueries

warehouse("join_inner_using", "SELECT s_name, n_name FROM supplier JOIN (SELECT n_nationkey AS s_nationkey, n_name FROM nation) n USING (s_nationkey)", None, "supplier", "nation")
warehouse("join_left", "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey", None, "customer", "orders")
warehouse("join_right", "SELECT n.n_name, COUNT(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", None, "supplier", "nation")
warehouse(
    "join_full",
    "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 5) b ON a.k = b.k",
    None, "nation",
)
warehouse("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 3", None, "region", "nation")
warehouse("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None, "nation")
warehouse("join_multiway", "SELECT r.r_name, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", None, "lineitem", "orders", "customer", "nation", "region")
warehouse("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)", None, "customer", "orders")
warehouse("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", None, "customer", "orders")
warehouse("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None, "customer", "orders")
warehouse("not_in_nullaware", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(n_regionkey, 3) FROM nation)", None, "nation")
warehouse("scalar_subq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)", None, "orders")
warehouse("correlated_subq", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE l.l_quantity > (SELECT 1.4 * AVG(m.l_quantity) FROM lineitem m WHERE m.l_suppkey = l.l_suppkey)", None, "lineitem")
warehouse("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 500000) SELECT COUNT(*) AS n, ROUND(MAX(t), 2) AS most FROM top", None, "orders")
warehouse("derived", "SELECT seg, COUNT(*) AS n FROM (SELECT c_mktsegment AS seg, c_acctbal FROM customer WHERE c_acctbal > 0) d GROUP BY seg", None, "customer")
warehouse("lateral_join", "SELECT n.n_name, t.most FROM nation n, LATERAL (SELECT ROUND(MAX(s_acctbal), 2) AS most FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t", None, "nation", "supplier")
_RANGE = "SELECT a.event_id AS a, COUNT(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {} GROUP BY a.event_id"
warehouse("range_join", _RANGE.format("6 HOUR"), _RANGE.format("6 HOUR"), "events")

# Windows

warehouse("window_rank", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS dr, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS nt FROM orders", "orders")
warehouse("window_frame", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS run3, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM events", None, "events")
warehouse("lag_lead", "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id, LEAD(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_type, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id FROM events", None, "events")
warehouse("window_percent", "SELECT c_custkey, ROUND(PERCENT_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 8) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 8) AS cd FROM customer", None, "customer")
_QUALIFY = "SELECT user_id, event_id, ts FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
warehouse("qualify_dedupe", _QUALIFY, None, "events")
warehouse("qualify_alias", "SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type = 'click' QUALIFY rn <= 2 ORDER BY user_id", "SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE event_type = 'click') WHERE rn <= 2", "events")

# Sets, sorting

warehouse("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None, "nation", "region")
warehouse("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None, "nation", "region")
warehouse("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10", None, "orders", "customer")
warehouse("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None, "orders", "customer")
warehouse("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 25 OFFSET 5", None, "lineitem")
warehouse("constant_select", "SELECT 1 + 1 AS answer, 'x' AS label", None)
warehouse("predicates", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_name LIKE '%1' AND c_mktsegment IS NOT NULL AND NOT c_nationkey IN (1, 2, 3)", None, "customer")
warehouse("math_functions", "SELECT p_partkey, ABS(p_size - 25) AS a, MOD(p_size, 7) AS m, ROUND(SQRT(p_retailprice), 6) AS s, FLOOR(p_retailprice) AS f, CEIL(p_retailprice) AS c, SIGN(p_size - 25) AS g, ROUND(LN(p_retailprice), 6) AS l, ROUND(POWER(p_size, 2), 2) AS p FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, round(sqrt(p_retailprice), 6) AS s, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(sign(p_size - 25) AS DOUBLE) AS g, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 2) AS p FROM part", "part")
warehouse("string_functions", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, TRIM('  ' || c_name || ' ') AS t, LENGTH(c_name) AS n, SUBSTRING(c_name, 2, 5) AS s, REPLACE(c_name, '0', 'o') AS r, CONCAT(c_name, '-', c_mktsegment) AS j, LPAD(CAST(c_custkey AS STRING), 8, '0') AS p, POSITION('#' IN c_name) AS at FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || ' ') AS t, CAST(length(c_name) AS INTEGER) AS n, substring(c_name, 2, 5) AS s, replace(c_name, '0', 'o') AS r, concat(c_name, '-', c_mktsegment) AS j, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p, CAST(position('#' IN c_name) AS INTEGER) AS at FROM customer", "customer")
warehouse("conditionals", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, COALESCE(NULLIF(o_orderpriority, '1-URGENT'), 'top') AS p, GREATEST(o_custkey, 100, NULL) AS g, LEAST(o_custkey, 100, NULL) AS l FROM orders", None, "orders")

# Dialect rewrites

warehouse("iff", "SELECT o_orderkey, IFF(o_totalprice > 100000, 'big', IFF(o_totalprice > 50000, 'mid', 'small')) AS size FROM analytics.public.orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size FROM orders", "orders")
warehouse("decode_nullsafe", "SELECT o_orderkey, DECODE(NULLIF(o_orderstatus, 'P'), 'O', 1, 'F', 2, NULL, 3, 9) AS d, DECODE(o_orderstatus, 'O', 'x') AS e FROM orders", "SELECT o_orderkey, CASE WHEN NULLIF(o_orderstatus, 'P') IS NOT DISTINCT FROM 'O' THEN 1 WHEN NULLIF(o_orderstatus, 'P') IS NOT DISTINCT FROM 'F' THEN 2 WHEN NULLIF(o_orderstatus, 'P') IS NULL THEN 3 ELSE 9 END AS d, CASE WHEN o_orderstatus = 'O' THEN 'x' END AS e FROM orders", "orders")
warehouse("equal_null", "SELECT o_orderkey, EQUAL_NULL(NULLIF(o_orderstatus, 'P'), NULL) AS a, NULLIFEQUAL(o_orderstatus, 'O') AS b FROM orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') IS NULL AS a, o_orderstatus = 'O' AS b FROM orders", "orders")
warehouse("nvl_family", "SELECT o_orderkey, NVL(NULLIF(o_orderstatus, 'P'), '?') AS a, NVL2(NULLIF(o_orderstatus, 'P'), 'has', 'none') AS b, ZEROIFNULL(NULLIF(o_custkey, 5)) AS c FROM orders", "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'P'), '?') AS a, CASE WHEN NULLIF(o_orderstatus, 'P') IS NOT NULL THEN 'has' ELSE 'none' END AS b, coalesce(NULLIF(o_custkey, 5), 0) AS c FROM orders", "orders")
warehouse("bool_aggs", "SELECT o_custkey, BOOLAND_AGG(o_totalprice > 1000) AS every_one, BOOLOR_AGG(o_totalprice > 200000) AS some_one FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 200000) AS some_one FROM orders GROUP BY o_custkey", "orders")
warehouse("dateadd_units", "SELECT o_orderkey, DATEADD(day, 7, o_orderdate) AS d, DATEADD(month, -2, o_orderdate) AS m, DATEADD('hour', 30, o_orderdate) AS h, DATEADD(quarter, 1, CAST(o_orderdate AS DATE)) AS q, DATEADD(week, 1, CAST(o_orderdate AS DATE)) AS w, TIMESTAMPADD(minute, 90, o_orderdate) AS mi, DATEADD(year, 1, o_orderdate) AS y FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS d, o_orderdate - INTERVAL 2 MONTH AS m, o_orderdate + INTERVAL 30 HOUR AS h, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS q, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS w, o_orderdate + INTERVAL 90 MINUTE AS mi, o_orderdate + INTERVAL 1 YEAR AS y FROM orders", "orders")


def _boundaries(unit: str) -> str:
    """Unit boundaries between ts and event_id hours later, for DuckDB; weeks start on Monday."""
    later = "ts + CAST(event_id AS INTEGER) * INTERVAL 1 HOUR"
    if unit == "week":
        return f"datediff('day', date_trunc('week', ts), date_trunc('week', {later})) // 7"
    return f"datediff('{unit}', ts, {later})"


_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
warehouse("date_trunc_units", "SELECT event_id, " + ", ".join(f"DATE_TRUNC({u}, ts) AS {u}_at" for u in _UNITS) + " FROM events", "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u}_at" for u in _UNITS) + " FROM events", "events")
warehouse("convert_timezone", "SELECT event_id, CONVERT_TIMEZONE('America/New_York', ts) AS ny, CONVERT_TIMEZONE('UTC', 'Asia/Tokyo', ts) AS tokyo FROM events", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS tokyo FROM events", "events")
warehouse("parse_json_get_path", "SELECT event_id, CAST(GET_PATH(PARSE_JSON(props), 'k') AS BIGINT) AS k, CAST(variant_get(PARSE_JSON(props), '$.k', 'bigint') AS BIGINT) AS v FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events", "events")
warehouse("object_construct", "SELECT n_nationkey, OBJECT_CONSTRUCT('name', n_name, 'region', n_regionkey, 'none', NULLIF(n_regionkey, 1)) AS o FROM nation", "SELECT n_nationkey, CAST(json_object('name', n_name, 'region', n_regionkey, 'none', NULLIF(n_regionkey, 1)) AS VARCHAR) AS o FROM nation", "nation")
warehouse("array_construct", "SELECT n_nationkey, ARRAY_CONSTRUCT(n_nationkey, n_regionkey, 7)[1] AS second_item, SIZE(ARRAY_CONSTRUCT(n_nationkey, n_regionkey, 7)) AS n FROM nation", "SELECT n_nationkey, n_regionkey AS second_item, 3 AS n FROM nation", "nation")
warehouse("datediff_boundaries", "SELECT event_id, " + ", ".join(f"DATEDIFF({u}, ts, DATEADD(hour, event_id, ts)) AS {u}s" for u in _UNITS) + " FROM events", "SELECT event_id, " + ", ".join(f"CAST({_boundaries(u)} AS {'INTEGER' if u in _UNITS[:5] else 'BIGINT'}) AS {u}s" for u in _UNITS) + " FROM events", "events")
warehouse("flatten", "SELECT e.event_id, f.key, CAST(f.value AS BIGINT) AS v FROM events e, LATERAL FLATTEN(input => PARSE_JSON(e.props)) f", "SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS BIGINT) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)", "events")
warehouse("to_json", "SELECT n_nationkey, TO_JSON(NAMED_STRUCT('k', n_nationkey, 'n', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'n', n_name) AS VARCHAR) AS j FROM nation", "nation")
warehouse("strip_database", "SELECT n.n_name FROM analytics.public.nation n WHERE n.n_nationkey IN (SELECT n_regionkey FROM other.public.nation)", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT n_regionkey FROM nation)", "nation")
warehouse("exclude_columns", "SELECT * EXCLUDE (n_regionkey) FROM nation", "SELECT n_nationkey, n_name FROM nation", "nation")
warehouse("time_slice", "SELECT event_id, CAST(timestamp_seconds(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / 900) * 900) AS TIMESTAMP_NTZ) AS slice FROM events", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS slice FROM events", "events")


@query("hide_row_id", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _hide(spark, d):
    read_table(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS __row_id", "c_custkey", "c_name", "c_nationkey").createOrReplaceTempView("customer_lake")
    return spark.sql(rewrite("SELECT * FROM customer_lake", holders=lambda name: name.endswith("customer_lake")))


@query("bind_parameters", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def _bind(spark, d):
    register(spark, d, "nation")
    return spark.sql(rewrite("SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?"), args=[2, 5])


from . import engine_queries, system_queries  # noqa: E402,F401  (they register the rest)
