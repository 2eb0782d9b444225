"""Registered queries of what surrounds a statement: execution, remote reads, catalogs, references, loads, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, cdc, digest, observe, quantiles, references, temporal
from ..session import Session, TableRef, new_dir, read_table, staged
from ..sources import catalogs, history, remote
from ..sources.lake import LakeTable
from ..sources.loads import Pipe
from ..streaming import sync
from .registry import query
from .engine_queries import _AUDIT, _CTES, _HIST, _MERGED, _cdc, _control, _history, _shown
from .execute import Control, Engine, TableWarehouse
from .router import Config, Matcher

# Execution of decisions

_SESSION = Session(role="ANALYST", user="ana", roles=("EU",))
_STATES = {"customer": "active", "orders": "active", "events": "active", "lineitem": "active", "part": "pending", "supplier": "quarantined"}


def _stats(spark, d, states: dict[str, str], sizes: dict[str, int] | None = None) -> DataFrame:
    """Control rows of lake tables, with sizes from the folder's listing."""
    listed = {t.name: size for t, size in catalogs.FolderCatalog(spark, d).tables()}
    rows = [("ANALYTICS", "PUBLIC", name, int((sizes or {}).get(name, listed.get(name, 0))), 1000, state, "include", None) for name, state in states.items()]
    return spark.createDataFrame(rows, "database string, schema string, name string, bytes long, rows_count long, sync_state string, source string, view_strategy string")


def _engine(spark, d, states=None, sizes=None, markers=(), **given) -> Engine:
    deps = spark.createDataFrame([], "parent_db string, parent_schema string, parent_name string, dep_db string, dep_schema string, dep_name string")
    marks = spark.createDataFrame([("ANALYTICS", "PUBLIC", t, "p_" + t, body) for t, body in markers], "database string, schema string, name string, policy_name string, body string")
    lake = lambda ref: read_table(spark, d, ref.name.lower())
    far = lambda ref: remote.read_folder(spark, f"{d}/{ref.name.lower()}.parquet") if "://" not in d else lake(ref)
    return Engine(spark, lake, TableWarehouse(spark, far), Control(_stats(spark, d, states or _STATES, sizes), deps, marks), **given)


def _ran(engine: Engine, sql: str) -> DataFrame:
    got = engine.execute(sql, _SESSION)
    return got.df.withColumn("route", F.lit(got.outcome.route)).withColumn("reason", F.lit(got.outcome.reason))


_PLAIN = "SELECT c_mktsegment, IFF(c_acctbal > 0, 'plus', 'minus') AS side, COUNT(*) AS n FROM {0}customer c JOIN {0}orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2"
_DUCK = "SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS side, count(*) AS n{extra} FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey {where} GROUP BY 1, 2"
_told = lambda route, reason: f", '{route}' AS route, '{reason}' AS reason"


@query("route_execute_lake", _DUCK.format(extra=_told("lake", "under_threshold"), where=""))
def _lake(spark, d):
    return _ran(_engine(spark, d, matcher=Matcher()), _PLAIN.format("ANALYTICS.PUBLIC."))


@query("route_execute_passthrough", _DUCK.format(extra=_told("warehouse", "above_threshold"), where=""))
def _passthrough(spark, d):
    """The control tables hold a size above the lake's limit: the warehouse runs the statement as it was written."""
    return _ran(_engine(spark, d, sizes={"orders": 1 << 45}), _PLAIN.format("ANALYTICS.PUBLIC."))


@query("route_execute_hybrid", _DUCK.format(extra=_told("hybrid", "remote_by_config"), where=""))
def _hybrid(spark, d):
    engine = _engine(spark, d, matcher=Matcher(remote=("*.*.ORDERS",)), cfg=Config(hybrid=True))
    return _ran(engine, _PLAIN.format("ANALYTICS.PUBLIC."))


_BODY = "IS_ROLE_IN_SESSION('EU') AND c_nationkey IN (1, 2, 3) AND c_acctbal > -500"


@query("route_execute_policy", _DUCK.format(extra=_told("lake", "under_threshold"), where="WHERE c_nationkey IN (1, 2, 3) AND c_acctbal > -500"))
def _policy(spark, d):
    """A protected table is read through its filtered view, in the statement as swapped."""
    return _ran(_engine(spark, d, markers=(("customer", _BODY),), cfg=Config(policy_mode="enforce")), _PLAIN.format("ANALYTICS.PUBLIC."))


@query("route_execute_denied", "SELECT * FROM (VALUES ('passthrough', 'warehouse', 'policy_protected'), ('no_body', 'warehouse', 'policy_protected'), ('hybrid', 'warehouse', 'policy_protected'), ('other_table', 'lake', 'under_threshold')) t(name, route, reason)")
def _denied(spark, d):
    sql, rows = _PLAIN.format("ANALYTICS.PUBLIC."), []
    engines = (
        ("passthrough", _engine(spark, d, markers=(("customer", _BODY),)), sql), ("no_body", _engine(spark, d, markers=(("customer", "MY_UDF(c_custkey)"),), cfg=Config(policy_mode="enforce")), sql),
        ("hybrid", _engine(spark, d, markers=(("customer", _BODY),), matcher=Matcher(remote=("*.*.orders",)), cfg=Config(hybrid=True, policy_mode="enforce")), sql),
        ("other_table", _engine(spark, d, markers=(("part", _BODY),)), sql),
    )
    for name, engine, text in engines:
        out = engine.decide(text, _SESSION)
        rows.append((name, out.route, out.reason))
    return spark.createDataFrame(rows, "name string, route string, reason string")


@query("route_from_control", f"""{_CTES} SELECT name, CASE WHEN sync_state = 'active' AND bytes <= 10000 THEN 'lake' ELSE 'warehouse' END AS route,
CASE WHEN sync_state = 'pending' THEN 'bootstrapping_table' WHEN sync_state = 'quarantined' THEN 'table_quarantined' WHEN bytes > 10000 THEN 'above_threshold' ELSE 'under_threshold' END AS reason
FROM (SELECT name, sync_state, CASE WHEN view_strategy = 'decomposed' THEN (SELECT coalesce(sum(b.bytes), 0) FROM deps JOIN stats b ON b.database = dep_db AND b.schema = dep_schema AND b.name = dep_name WHERE parent_db = s.database AND parent_name = s.name) ELSE bytes END AS bytes FROM stats s)
UNION ALL SELECT 'new_table', 'warehouse', 'bootstrapping_table'""")
def _from_control(spark, d):
    """State, size and discovery of each table come from the control tables, in one query each for all of them."""
    stats, deps, _ = _control(spark, d)
    marks = spark.createDataFrame([], "database string, schema string, name string, policy_name string, body string")
    none = lambda ref: (_ for _ in ()).throw(AssertionError(ref))  # noqa: E731  nothing is read
    engine = Engine(spark, none, TableWarehouse(spark, none), Control(staged(stats, "stats"), staged(deps, "deps"), marks), Config(lake_max_scan_bytes=10_000), Matcher())
    names = [(r["database"], r["schema"], r["name"]) for r in stats.select("database", "schema", "name").collect()] + [("DB9", "PUBLIC", "new_table")]
    engine.prefetch([TableRef(*n) for n in names])
    rows = [(n[2], (out := engine.decide(f'SELECT * FROM "{n[0]}"."{n[1]}"."{n[2]}"', _SESSION)).route, out.reason) for n in names]
    return spark.createDataFrame(rows, "name string, route string, reason string")


@query("result_cache", "SELECT * FROM (VALUES (1, 'lake'), (2, 'cache'), (3, 'lake')) t(turn, route)")
def _cached(spark, d):
    engine = _engine(spark, d)
    engine.results.seconds = 60.0
    sql = "SELECT c_mktsegment, COUNT(*) AS n FROM ANALYTICS.PUBLIC.customer GROUP BY 1"
    turns = [engine.fetch(sql, _SESSION), engine.fetch(sql, _SESSION)]
    engine.invalidate(TableRef("ANALYTICS", "PUBLIC", "customer"))
    turns.append(engine.fetch(sql, _SESSION))
    if not all(sorted(t[0]) == sorted(turns[0][0]) for t in turns):
        raise AssertionError("rows differ")
    return spark.createDataFrame([(i + 1, t[1].route) for i, t in enumerate(turns)], "turn int, route string")


# Remote reads and catalogs


@query("remote_scan", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def _remote_scan(spark, d):
    return remote.read_folder(spark, f"{d}/orders.parquet", ["o_orderstatus", "o_totalprice"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("remote_pushdown", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_custkey IN (1, 2, 3, 5, 8, 13) AND o_orderkey % 2 = 0")
def _remote_pushdown(spark, d):
    t = remote.read_folder(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return t.where("o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_custkey IN (1, 2, 3, 5, 8, 13) AND o_orderkey % 2 = 0").select("o_orderkey", "o_custkey")


@query("catalog_listing", "SELECT * FROM (VALUES ('benchmark', true), ('conversations', true), ('customer', true), ('documents', true), ('embeddings', true), ('events', true), ('labels', true), ('lineitem', true), ('nation', true), ('orders', true), ('pages', true), ('part', true), ('region', true), ('supplier', true)) t(name, sized)")
def _listing(spark, d):
    return catalogs.CachedListing(catalogs.FolderCatalog(spark, d)).frame(spark).select("name", (F.col("bytes") > 0).alias("sized"))


def _rest(path: str) -> dict:
    spaces = {"sales": {"orders": 900, "returns": None}, "ops": {"hosts": 70}}
    if path.startswith("v1/namespaces?") or path == "v1/namespaces":
        return {"namespaces": [["ops"]]} if "pageToken" in path else {"namespaces": [["sales"]], "next-page-token": "x"}
    space, _, table = path.removeprefix("v1/namespaces/").partition("/tables")
    if not table:
        return {"identifiers": [{"namespace": [space], "name": t} for t in spaces[space]]}
    size = spaces[space][table.strip("/")]
    return {"metadata": {"current-snapshot-id": 2, "snapshots": [{"snapshot-id": 1, "summary": {"total-files-size": "1"}}, {"snapshot-id": 2, "summary": {} if size is None else {"total-files-size": str(size)}}]}}


def _glue(operation: str, given: dict) -> dict:
    if operation == "GetDatabases":
        return {"DatabaseList": [{"Name": "web"}]}
    if "NextToken" in given:
        return {"TableList": [{"Name": "clicks", "Parameters": {"table_type": "iceberg", "totalSize": "55"}}]}
    return {"TableList": [{"Name": "raw", "Parameters": {"classification": "csv"}}, {"Name": "views", "Parameters": {"table_type": "ICEBERG"}}], "NextToken": "2"}


@query("catalog_protocols", "SELECT * FROM (VALUES ('DB.sales.orders', 900, false), ('DB.sales.returns', NULL, false), ('DB.ops.hosts', 70, false), ('DB.web.views', NULL, true), ('DB.web.clicks', 55, true)) t(name, bytes, stale)")
def _protocols(spark, d):
    """Listings over two pages of each protocol; the second catalog fails when asked again, and what it had stays."""
    rest, calls = catalogs.CachedListing(catalogs.RestCatalog(_rest, "DB"), 0), []

    def glue(operation: str, given: dict) -> dict:
        calls.append(operation)
        if len(calls) > 3:
            raise ConnectionError("gone")
        return _glue(operation, given)

    other = catalogs.CachedListing(catalogs.GlueCatalog(glue, "DB"), 0)
    other.tables()
    rows = [(t.fqn, size, listing.stale) for listing in (rest, other) for t, size in listing.tables().items()]
    return spark.createDataFrame(rows, "name string, bytes int, stale boolean")


# Policy references, kinds, dependencies, lost streams

_REFS = """SELECT 'DB' || CAST(n_regionkey AS STRING) AS ref_database_name, 'PUBLIC' AS ref_schema_name, CASE WHEN n_nationkey = 7 THEN '' ELSE n_name END AS ref_entity_name,
CASE n_nationkey % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'MATERIALIZED_VIEW' WHEN 3 THEN 'EXTERNAL_TABLE' ELSE 'COLUMN' END AS ref_entity_domain, 'p' || CAST(n_nationkey AS STRING) AS policy_name,
CASE n_nationkey % 6 WHEN 0 THEN 'ROW_ACCESS_POLICY' WHEN 1 THEN 'MASKING_POLICY' WHEN 2 THEN 'AGGREGATION_POLICY' WHEN 3 THEN 'PROJECTION_POLICY' WHEN 4 THEN 'NETWORK_POLICY' ELSE NULL END AS policy_kind,
CASE WHEN n_nationkey % 7 = 3 THEN 'INACTIVE' ELSE 'ACTIVE' END AS policy_status FROM nation"""


@query("policy_references", f"""SELECT ref_database_name AS database, ref_schema_name AS schema, ref_entity_name AS name, policy_name, CASE WHEN policy_kind = 'ROW_ACCESS_POLICY' THEN 'row_access' ELSE 'masking' END AS kind
FROM ({_REFS}) r WHERE policy_status = 'ACTIVE' AND ref_entity_domain <> 'COLUMN' AND policy_kind <> 'NETWORK_POLICY' AND ref_entity_name <> ''""")
def _references(spark, d):
    read_table(spark, d, "nation").createOrReplaceTempView("nation")
    return references.policy_references(spark.sql(_REFS))


_TYPES = "CASE n_nationkey % 6 WHEN 0 THEN 'BASE TABLE' WHEN 1 THEN 'view' WHEN 2 THEN 'VIEW' WHEN 3 THEN 'MATERIALIZED VIEW' WHEN 4 THEN 'EXTERNAL TABLE' ELSE 'EVENT TABLE' END"


def _schema_rows(spark, d):
    n = read_table(spark, d, "nation").selectExpr("'DB' AS database", "'PUBLIC' AS schema", "n_name AS name", f"{_TYPES} AS table_type", "n_nationkey AS k")
    return n, n.where("k < 20").drop("k"), n.where("upper(table_type) = 'VIEW'").selectExpr("database", "schema", "name", "CASE WHEN k % 4 = 2 THEN 'YES' ELSE 'NO' END AS is_secure")


@query("object_kinds", f"""SELECT n_name AS name, CASE WHEN n_nationkey >= 20 THEN 'unknown' ELSE CASE n_nationkey % 6 WHEN 0 THEN 'base_table' WHEN 3 THEN 'materialized_view' WHEN 4 THEN 'external_table' WHEN 5 THEN 'unknown'
ELSE CASE WHEN n_nationkey % 4 = 2 THEN 'secure_view' ELSE 'view' END END END AS kind FROM nation""")
def _kinds(spark, d):
    n, tables, views = _schema_rows(spark, d)
    return references.object_kinds(n.select("database", "schema", "name"), tables, views).select("name", "kind")


@query("view_dependencies", f"""{_CTES} SELECT parent_name, dep_name, false AS fresh FROM deps WHERE parent_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)
UNION ALL SELECT n_name, n_name || '_base', true FROM nation WHERE n_nationkey % 3 = 0""")
def _dependencies(spark, d):
    _, deps, wanted = _control(spark, d)
    fresh = wanted.where("ord % 3 = 0").selectExpr("CASE WHEN ord = 11 THEN 'DB1' ELSE database END AS parent_db", "schema AS parent_schema", "name AS parent_name", "database AS dep_db", "schema AS dep_schema", "name || '_base' AS dep_name", "true AS fresh")
    return references.replace_dependencies(deps.withColumn("fresh", F.lit(False)), fresh).select("parent_name", "dep_name", "fresh")


@query("stale_stream_cascade", f"""{_CTES}, lost AS (SELECT * FROM stats WHERE bytes % 6000 IN (0, 1000)), up AS (SELECT DISTINCT parent_db, parent_name FROM deps JOIN lost ON dep_db = database AND dep_name = name)
SELECT s.name, CASE WHEN l.name IS NOT NULL OR up.parent_name IS NOT NULL THEN 'pending' ELSE s.sync_state END AS sync_state,
CASE WHEN l.name IS NOT NULL THEN 'stream_lost' WHEN up.parent_name IS NOT NULL THEN 'dependency_invalidated' END AS state_reason
FROM stats s LEFT JOIN lost l ON l.database = s.database AND l.name = s.name LEFT JOIN up ON up.parent_db = s.database AND up.parent_name = s.name""")
def _cascade(spark, d):
    stats, deps, _ = _control(spark, d)
    message = "CASE bytes % 6000 WHEN 0 THEN 'Stream S is STALE' WHEN 1000 THEN 'offset 5 has expired' WHEN 2000 THEN 'timeout' ELSE 'offset unknown' END"
    failures = stats.selectExpr("database", "schema", "name", f"{message} AS message")
    return references.cascade(stats, deps, failures).select("name", "sync_state", "state_reason")


# Lake tables, loads, history files


@query("lake_commit_replay", _MERGED)
def _replay(spark, d):
    """Bootstrap, then a batch that is run again after a crash: it finds its number and does nothing."""
    base, changes = _cdc(spark, d)
    table = LakeTable(spark, new_dir(spark, "lake"))
    sync.merge_batch(table, base.withColumn("__action", F.lit("INSERT")).withColumn("__commit", F.lit(1)), 0, 4)
    for _ in range(2):
        sync.merge_batch(table, changes.withColumn("__commit", F.lit(2)), 1, 4)
    return _shown(sync.current(table))


@query("lake_snapshot_read", "SELECT 0 AS number, count(*) AS n FROM nation UNION ALL SELECT 1, count(*) FROM nation WHERE n_regionkey <> 2")
def _snapshot(spark, d):
    n = read_table(spark, d, "nation")
    table = LakeTable(spark, new_dir(spark, "lake"))
    table.write(n)
    table.write(n.where("n_regionkey <> 2"))
    return table.read(number=0).agg(F.count("*").alias("n")).selectExpr("0 AS number", "n").unionByName(table.read().agg(F.count("*").alias("n")).selectExpr("1 AS number", "n"))


@query("load_history", """SELECT * FROM (SELECT 1 AS request, 'nation.parquet' AS file, 'LOADED' AS status, count(*) AS rows_inserted, 0 AS errors_seen FROM nation
UNION ALL SELECT 1, 'nothing.parquet', 'LOAD_FAILED', 0, 1 UNION ALL SELECT 2, 'nation.parquet', 'ALREADY_LOADED', 0, 0) h UNION ALL SELECT 3, 'all rows', 'READ', count(*), 0 FROM nation""")
def _loads(spark, d):
    place = new_dir(spark, "loads")
    target = LakeTable(spark, f"{place}/target")
    pipe = Pipe(spark, target, LakeTable(spark, f"{place}/history"), read_table(spark, d, "nation").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    ids = [pipe.insert_files([f"{d}/nation.parquet", f"{d}/nothing.parquet"]), pipe.insert_files([f"{d}/nation.parquet"])]
    number = F.when(F.col("request_id") == ids[0], 1).otherwise(2)
    told = pipe.load_history().select(number.alias("request"), F.regexp_extract("file_name", "[^/]+$", 0).alias("file"), "status", "rows_inserted", F.col("errors_seen").cast("int").alias("errors_seen"))
    return told.unionByName(target.read().agg(F.count("*").alias("rows_inserted")).selectExpr("3 AS request", "'all rows' AS file", "'READ' AS status", "rows_inserted", "0 AS errors_seen"))


@query("history_csv", f"SELECT query_id, query_text, execution_time, CASE WHEN trim(coalesce(warehouse_size, '')) <> '' THEN warehouse_size END AS warehouse_size, CASE WHEN CAST(query_id AS BIGINT) % 9 = 0 THEN 0 ELSE bytes_scanned END AS bytes_scanned FROM ({_HIST}) h")
def _history_csv(spark, d):
    read_table(spark, d, "orders").createOrReplaceTempView("orders")
    place = new_dir(spark, "history")
    shown = spark.sql(_HIST).selectExpr("CASE WHEN CAST(query_id AS BIGINT) % 9 = 0 THEN 'n/a' ELSE CAST(bytes_scanned AS STRING) END AS ` bytes_scanned`", "warehouse_size AS Warehouse_Size", "query_text AS QUERY_TEXT", "date_format(start_time, 'yyyy-MM-dd HH:mm:ss') AS START_TIME", "query_id AS QUERY_ID", "execution_time AS EXECUTION_TIME")
    shown.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(place)
    return history.read_csv(spark, place).select("query_id", "query_text", "execution_time", "warehouse_size", "bytes_scanned")


# Results, observation, reports


@query("digest_pairs", """SELECT * FROM (VALUES ('array', false), ('map_order', true), ('map_value', false), ('struct', false), ('binary', false), ('small_float', false), ('whole_float', true), ('separator', false), ('null_text', false), ('empty_or_null_array', false), ('repeated', false), ('row_order', true), ('deep', false), ('columns', false)) t(pair, same)""")
def _digest_pairs(spark, d):
    """Results that differ in one place and results that must count as equal."""
    one = lambda *values: spark.sql("SELECT " + ", ".join(f"{v} AS c{i}" for i, v in enumerate(values)))
    rows = lambda *values: spark.sql(f"SELECT * FROM VALUES {', '.join(f'({v})' for v in values)} AS t(c0)")
    pairs = {
        "array": (one("array(1, 2)"), one("array(2, 1)")), "map_order": (one("map('a', 1, 'b', 2)"), one("map('b', 2, 'a', 1)")), "map_value": (one("map('a', 1)"), one("map('a', 2)")),
        "struct": (one("struct('a', 'bc')"), one("struct('ab', 'c')")), "binary": (one("X'00FF'"), one("X'00FE'")), "small_float": (one("1e-10D"), one("3e-10D")), "whole_float": (one("CAST(2 AS FLOAT)"), one("2.0D")),
        "separator": (one("concat('a', chr(31), 'b')", "'c'"), one("'a'", "concat('b', chr(31), 'c')")), "null_text": (one("CAST(NULL AS STRING)"), one("concat(chr(0), 'NULL')")),
        "empty_or_null_array": (one("array(CAST(NULL AS INT))"), one("CAST(array() AS ARRAY<INT>)")), "repeated": (rows(1, 1, 2), rows(1, 2, 2)), "row_order": (rows(1, 2, 3), rows(3, 1, 2)),
        "deep": (one("array(struct(map('k', array(1.5D))))"), one("array(struct(map('k', array(1.25D))))")), "columns": (one("1"), one("1", "1")),
    }
    return spark.createDataFrame([(name, digest.same_results(a, b)) for name, (a, b) in pairs.items()], "pair string, same boolean")


@query("result_paging", "SELECT CAST(k // 400 AS INTEGER) AS page, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS k FROM orders) GROUP BY 1")
def _paging(spark, d):
    pages = digest.paged(read_table(spark, d, "orders").select("o_orderkey"), 400)
    return pages.groupBy(F.col("_page").cast("int").alias("page")).agg(F.count("*").alias("n"))


@query("explain_analyze", "SELECT 'rows' AS what, count(*) AS n FROM orders WHERE o_totalprice > 5000 UNION ALL SELECT 'Filter', count(*) FROM orders WHERE o_totalprice > 5000 UNION ALL SELECT 'Scan', count(*) FROM orders")
def _explain(spark, d):
    rows, top = observe.analyze(read_table(spark, d, "orders").where("o_totalprice > 5000").select("o_orderkey"))
    told = [("rows", rows)] + [(n.name.split(" ")[0], n.metrics["numOutputRows"]) for _, n in top.walk() if n.name.split(" ")[0] in ("Filter", "Scan")]
    return spark.createDataFrame(told, "what string, n long")


@query("parity_sampler", "SELECT CAST(count(*) AS INTEGER) AS offered, 10 AS taken, CAST(count(*) - 10 AS INTEGER) AS dropped, 10 AS checked, CAST(0 AS INTEGER) AS failed, 0 AS never FROM nation")
def _sampler(spark, d):
    every, never = observe.Sampler(1.0, 10), observe.Sampler(0.0)
    for r in read_table(spark, d, "nation").select("n_nationkey").collect():
        every.offer(r[0])
        never.offer(r[0])
    checked, failed = every.drain(lambda k: k >= 0)
    return spark.createDataFrame([(every.offered, every.taken, every.dropped, checked, failed, never.taken)], "offered int, taken int, dropped int, checked int, failed int, never int")


@query("audit_report", f"""{_AUDIT}, t AS (SELECT table_fqn FROM c WHERE bucket = 'routable' GROUP BY table_fqn ORDER BY sum(dollars) DESC, table_fqn LIMIT 3)
SELECT count(*) AS total, round(sum(dollars), 2) AS dollars, round(100.0 * count(*) FILTER (WHERE bucket = 'routable') / count(*), 2) AS routable_pct, count(*) FILTER (WHERE table_fqn IN (SELECT table_fqn FROM t)) AS conservative,
round(sum(dollars) FILTER (WHERE table_fqn IN (SELECT table_fqn FROM t)), 2) AS saved, round(sum(dollars) FILTER (WHERE bucket = 'routable') * 365 / 30, 2) AS annualized, round(greatest(sum(dollars) - sum(dollars) FILTER (WHERE bucket = 'routable'), 0) / count(*), 4) AS post FROM c""")
def _report(spark, d):
    """The report read back from its JSON text."""
    out = json.loads(audit.to_json(audit.report(staged(_history(spark, d).drop("bucket", "reason", "tables", "redacted", "dollars"), "history"), n=3)))
    safe, static = out["routable_conservative"], out["routable_static"]
    row = (out["total_queries"], out["total_dollars"], static["pct"], safe["count"], safe["dollars_saved"], static["annualized"], static["dollar_per_query_post"])
    return spark.createDataFrame([row], "total long, dollars double, routable_pct double, conservative long, saved double, annualized double, post double")


@query("decimal_text", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 4)) AS VARCHAR) AS text FROM orders")
def _decimal_text(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", cdc.decimal_text(F.col("o_totalprice"), 18, 4).alias("text"))


@query("bootstrap_checks", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey > 0 OR n_nationkey = 1 THEN 'stream_empty' WHEN n_nationkey % 3 = 1 THEN 'partial' ELSE 'ok' END AS verdict FROM nation")
def _bootstrap(spark, d):
    drained = {0: lambda k: 0, 1: lambda k: k - 1, 2: lambda k: k}
    rows = [(k := r[0], cdc.bootstrap_check(drained[k % 3](k), k)) for r in read_table(spark, d, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame(rows, "n_nationkey long, verdict string").select(F.col("n_nationkey").cast(read_table(spark, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "verdict")


# Joins on time, exact quantiles, functions of one's own


@query("as_of_join", "SELECT o.o_orderkey, e.event_id, e.value FROM orders o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, ts) e ON o.o_custkey = e.user_id AND o.o_orderdate + INTERVAL 8766 DAY >= e.ts")
def _as_of(spark, d):
    o = read_table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS user_id", "o_orderdate + INTERVAL 8766 DAY AS ts")
    return temporal.as_of_join(o, read_table(spark, d, "events"), "user_id", "ts", ["event_id", "value"]).select("o_orderkey", "event_id", "value")


@query("band_join", "SELECT a.event_id AS a, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR GROUP BY a.event_id")
def _band(spark, d):
    e = read_table(spark, d, "events").select("event_id", "user_id", "ts")
    return temporal.band_join(e, e, "user_id", "ts", 6 * 3600).groupBy(F.col("l.event_id").alias("a")).agg(F.count("*").alias("n"))


@query("exact_quantiles", "SELECT l_returnflag, s AS share, round(quantile_cont(l_extendedprice, s), 4) AS quantile FROM lineitem, (VALUES (0.1::DOUBLE), (0.5), (0.99)) v(s) GROUP BY l_returnflag, s".replace("quantile_cont(l_extendedprice, s)", "CASE s WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.99) END"))
def _quantiles(spark, d):
    q = quantiles.exact_quantiles(read_table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.1, 0.5, 0.99])
    return q.select("l_returnflag", "share", F.round("quantile", 4).alias("quantile"))


@query("udf_scalar", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _udf(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weir_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN round(price * (1 - discount), 4)")
    read_table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, weir_net(l_extendedprice, l_discount) AS net FROM lineitem")


@query("udf_table", "SELECT n_name, g AS step FROM nation, LATERAL (SELECT unnest(range(1, n_regionkey + 1)) AS g)")
def _udtf(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weir_steps(upto BIGINT) RETURNS TABLE(step BIGINT) RETURN SELECT k FROM (SELECT explode(sequence(1L, 100L)) AS k) WHERE k <= upto")
    read_table(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n.n_name, s.step FROM nation n, LATERAL weir_steps(n.n_regionkey) s")


@query("udf_aggregate", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS weighted FROM lineitem GROUP BY l_returnflag")
def _udaf(spark, d):
    """A weighted mean as an aggregate of its own: a named expression over built-in sums, which are summed before the shuffle."""
    weighted = lambda value, weight: F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    return read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(weighted("l_quantity", "l_extendedprice"), 6).alias("weighted"))


@query("row_generator", "SELECT range AS k, range * range AS square FROM range(1000)")
def _generator(spark, d):
    return spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * F.col("id")).alias("square"))

