"""Merge, streaming, policies, sources, digests and the audit on small data."""

import json

import pytest
from pyspark.sql import functions as F

from weirflow.operators import audit, benchmarks, cdc, digest, policy
from weirflow.plans.analysis import classify_query
from weirflow.plans.execute import Control, Engine, TableWarehouse
from weirflow.plans.router import Config
from weirflow.session import Session
from weirflow.sources import history, remote, rowset
from weirflow.sources.lake import LakeTable, WriteConflict
from weirflow.streaming import sync


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


CHANGE = "__action string, __row_id string, v int"


def test_merge_cases(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "__row_id string, v int")
    change = lambda data: spark.createDataFrame(data, CHANGE)
    assert rows(cdc.merge(base, change([("INSERT", "d", 4)]))) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert rows(cdc.merge(base, change([("DELETE", "a", 1)]))) == [("b", 2), ("c", 3)]
    pair = change([("DELETE", "a", 1), ("INSERT", "a", 9), ("DELETE", "b", 2)])
    once = cdc.merge(base, pair)
    assert rows(once) == [("a", 9), ("c", 3)] == rows(cdc.merge(once, pair))
    wider = pair.withColumn("note", F.lit("n"))
    assert rows(cdc.merge(base, wider)) == [("a", 9, "n"), ("c", 3, None)]
    assert rows(cdc.merge(base, change([]))) == rows(base)
    assert cdc.counters(change([("DELETE", "a", 1), ("INSERT", "a", 2)])).first() == (0, 1, 0)
    assert cdc.infer_action(change([("INSERT", "a", 1), ("DELETE", "b", 1)])).first()[0] == "DELETE"
    assert [cdc.bootstrap_check(*x) for x in ((0, 5), (3, 5), (5, 5), (0, 0))] == ["stream_empty", "partial", "ok", "ok"]
    assert cdc.backoff(10, 6) == 20 and cdc.backoff(10, 6, 80) == 80 and cdc.backoff(10, 1, 80) == 10


EVENT = CHANGE + ", __commit long"


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "changes"
    write = lambda data: spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").parquet(str(src))
    write([("INSERT", "a", 1, 1), ("INSERT", "b", 2, 1)])
    write([("INSERT", "a", 5, 2)])
    write([("DELETE", "a", 1, 2), ("DELETE", "b", 2, 3)])
    table = LakeTable(spark, str(tmp_path / "lake"))
    schema = spark.createDataFrame([], EVENT).schema
    for _ in range(2):  # the second run finds nothing new
        sync.start(spark, str(src), schema, table, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
        assert rows(sync.current(table)) == [("a", 5)]
    write([("INSERT", "b", 7, 4), ("INSERT", "a", 0, 1)])  # a late event of an old commit
    sync.start(spark, str(src), schema, table, str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    assert rows(sync.current(table)) == [("a", 5), ("b", 7)]


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_rename", "_forget", "vacuum"])
def test_lake_writer_killed(spark, tmp_path, monkeypatch, step):
    """Whatever step a writer dies at, the table holds a whole version, and a batch that runs again comes right."""
    event = lambda *data: spark.createDataFrame(data, EVENT)
    table = LakeTable(spark, str(tmp_path / "lake"))
    sync.merge_batch(table, event(("INSERT", "a", 1, 1), ("INSERT", "b", 2, 1)), 0, 4)

    def dies(*_, **__):
        raise Killed

    monkeypatch.setattr(table, step, dies)
    second = event(("DELETE", "a", 1, 2), ("INSERT", "c", 3, 2))
    with pytest.raises(Killed):
        sync.merge_batch(table, second, 1, 4)
    again = LakeTable(spark, str(tmp_path / "lake"))
    before, after = [("a", 1), ("b", 2)], [("b", 2), ("c", 3)]
    assert rows(sync.current(again)) == (before if step == "_rename" else after)
    assert sync.merge_batch(again, second, 1, 4) == (step == "_rename")
    assert rows(sync.current(again)) == after
    again.vacuum(0)
    assert rows(sync.current(again)) == after and rows(again.read(number=0).where("NOT __gone").select("__row_id", "v")) == before


def test_lake_writers_meet(spark, tmp_path):
    """Of two writers that read one version, the second to publish fails, and its rows are not there."""
    one, two = (LakeTable(spark, str(tmp_path / "lake")) for _ in range(2))
    one.write(spark.range(3))
    read = two.state()
    one.write(spark.range(4))
    two.state = lambda number=None: read
    with pytest.raises(WriteConflict):
        two.write(spark.range(9))
    assert one.read().count() == 4 and one.pointers() == [0, 1]


def test_small_batch_rewrites_few_parts(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path / "lake"))
    sync.merge_batch(table, spark.range(200).selectExpr("'INSERT' AS __action", "CAST(id AS STRING) AS __row_id", "CAST(id AS INT) AS v", "1L AS __commit"), 0, 8)
    old = table.state()["parts"]
    sync.merge_batch(table, spark.createDataFrame([("DELETE", "7", 7, 2)], EVENT), 1, 8)
    new = table.state()["parts"]
    assert len(old) == 8 and sum(old[k] != new[k] for k in old) == 1
    assert sync.current(table).count() == 199 and table.read().count() == 200
    sync.compact(table, 3, 8)
    assert sync.current(table).count() == 199 and table.read().count() == 199 and table.last_batch == 1


def test_batches_read_state_and_events_once(spark):
    """Random batches against a plain model; the plan of several batches reads each input once."""
    import random

    def model(state, batch):
        out = dict(state)
        for key in {k for _, k, _, _ in batch}:
            last = max(c for _, k, _, c in batch if k == key)
            new = [(v, last, False) for a, k, v, c in batch if (k, c, a) == (key, last, "INSERT")]
            old = state.get(key, [])
            held = max((c for _, c, _ in old), default=None)
            half = not new and any((c, gone) == (last, False) for _, c, gone in old)
            if (held is None or last >= held) and not half:
                out[key] = new or [(None, last, True)]
        return out

    rng = random.Random(3)
    state, want, reads = None, {}, 0
    for _ in range(4):
        batch = [(rng.choice(("INSERT", "DELETE", "UPDATE")), rng.choice("abcdefghijklmnopqrst"), rng.randint(0, 9), rng.randint(1, 4)) for _ in range(14)]
        state, want, reads = sync.apply_batch(state, spark.createDataFrame(batch, EVENT)), model(want, batch), reads + 1
        got = {}
        for r in state.collect():
            got.setdefault(r["__row_id"], []).append((r["v"], r["__commit"], r["__gone"]))
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
        plan = state._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        assert plan <= reads


def test_poll_backs_off():
    slept, left = [], iter([True, "conflict", "conflict", True, False])

    def step():
        got = next(left)
        if got == "conflict":
            raise WriteConflict
        return got

    assert sync.poll(step, sync.Pace(10), sleep=slept.append) == 2
    assert slept == [10, 20, 40, 10]


def test_policies(spark):
    df = spark.createDataFrame([("eu", 1, None), ("us", 2, "x"), (None, 3, "y")], "region string, v int, s string")
    who = Session(role="ANALYST", user="ana", roles=("EU",))
    for body, want in {
        "region = 'eu'": [1], "region IN ('eu', 'us') AND NOT v = 1": [2], "s IS NULL OR v >= 3": [1, 3], "CURRENT_ROLE() = 'ANALYST'": [1, 2, 3], "CURRENT_USER() <> 'ana'": [],
        "IS_ROLE_IN_SESSION('eu') AND v < 2": [1], "IS_ROLE_IN_SESSION('other')": [], "COALESCE(region, 'none') = 'none'": [3], "v = -(-1)": [1], "UPPER(region) = 'US'": [2], "region NOT IN ('eu')": [2], "LENGTH(SUBSTRING(s, 1, 1)) = 1": [2, 3],
    }.items():
        assert sorted(r.v for r in policy.filtered(df, body, who).collect()) == want, body
    for body in ("INVOKER_ROLE() = 'X'", "v IN (SELECT 1)", "EXISTS (SELECT 1)", "v = ", "LIKE 'x'", "(v = 1", "IS_DATABASE_ROLE_IN_SESSION('x')", None):
        assert policy.filtered(df, body, who).count() == 0, body
    with pytest.raises(policy.UnsupportedPolicy):
        policy.compile_predicate("SOME_UDF(v)", who)


def test_rowset(spark):
    text = spark.createDataFrame([("1", "1.239", "T", "19000", "1.5"), ("x", "-1.239", "no", "", "-1000.5"), (None, "5", "0", "bad", None)], "i string, d string, b string, day string, ts string")
    fields = [rowset.Field("i", "fixed", 18, 0), rowset.Field("d", "fixed", 10, 2), rowset.Field("b", "boolean"), rowset.Field("day", "date"), rowset.Field("ts", "timestamp_ntz")]
    got = rowset.decode(text, fields)
    assert [str(r.d) for r in got.collect()] == ["1.23", "-1.23", "5.00"]
    assert [r.i for r in got.collect()] == [1, None, None] and [r.b for r in got.collect()] == [True, None, False]
    assert str(got.collect()[1].ts) == "1969-12-31 23:43:19.500000"
    assert dict(rowset.wire_type(got)) == {"i": "fixed", "d": "real", "b": "boolean", "day": "date", "ts": "timestamp_ntz"}


def test_history_csv(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text('START_TIME,QUERY_ID,QUERY_TEXT,EXECUTION_TIME,WAREHOUSE_SIZE,BYTES_SCANNED\n2026-01-01T00:00:00Z,q1,"SELECT ""a"", 1\nFROM t",12,Small,bad\n2026-01-02T00:00:00Z,q2,SELECT 1,x, ,5\n')
    got = {r.query_id: r for r in history.read_csv(spark, str(p)).collect()}
    assert got["q1"].query_text == 'SELECT "a", 1\nFROM t' and got["q1"].bytes_scanned == 0 and got["q2"].execution_time == 0 and got["q2"].warehouse_size is None
    p.write_text("QUERY_ID\nq\n")
    with pytest.raises(ValueError, match="START_TIME"):
        history.read_csv(spark, str(p))


def test_digest(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.5), (2, None, 2.5)], "i int, s string, x double")
    assert digest.same_results(df, df.orderBy(F.desc("i")))
    assert not digest.same_results(df, df.distinct())
    assert not digest.same_results(df, df.fillna("\x01"))
    assert [len(p) for p in digest.pages(df, 2)] == [2, 1]
    assert digest.digest(df.limit(0)).first()[0] == 0
    assert digest.same_results(df.limit(0), df.where("i > 5")) and not digest.same_results(df.limit(0), df)


def test_pages_stay_off_the_driver(spark, monkeypatch):
    """Pages in the result's order over several tasks, while only counts are collected."""
    df = spark.range(0, 1003, 1, 7).where("id % 5 <> 0").orderBy(F.desc("id"))
    want = [p for p in digest.pages(df, 100)]
    seen, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(got := collect(self)) or got)
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("the rows went to the driver"))
    paged = digest.paged(df, 100)
    assert sum(map(len, seen)) <= 16
    monkeypatch.undo()
    for k, page in enumerate(want):
        assert [r.id for r in paged.where(F.col("_page") == k).orderBy("_row").collect()] == [r.id for r in page]
    assert paged.count() == 802 and digest.paged(df.limit(0)).count() == 0


TEXTS = [
    "SELECT a FROM d.s.t WHERE b = 'x, 5' AND c IN (1, 2.5, 'it''s')", "SELECT a FROM d.s.t WHERE b = 'FLATTEN(' ", "SELECT a1, 7 FROM d.s.t2 WHERE c >= 10", "SELECT \"a 5\" FROM d.s.t WHERE x = 5",
    "SELECT 'odd FROM d.s.t", "SELECT a FROM d.s.t -- = 5", "SELECT $$ = 5 $$ FROM d.s.t", "SELECT a FROM d.s.t WHERE b LIKE '%, 3, %' LIMIT 10", "DELETE FROM d.s.t WHERE k = 3", "SELECT * FROM TABLE(GENERATOR(ROWCOUNT => 5))", "", "SELEC 1", "SELECT a FROM d.s.t AT(OFFSET => -60)", "SELECT x'00' FROM d.s.t, (SELECT 1, 2) q",
]


def test_shapes_are_analysed_like_their_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [("SELECT a FROM d.s.t WHERE b = 'other' AND c IN (9, 1.5, '')",)], "t string")
    shapes = {r.t: r.shape for r in df.select("t", audit.shape_of(F.col("t")).alias("shape")).collect()}
    for text, shape in shapes.items():
        assert classify_query(shape) == classify_query(text), text
    assert shapes[TEXTS[0]] == shapes["SELECT a FROM d.s.t WHERE b = 'other' AND c IN (9, 1.5, '')"]


def test_engine_keeps_policies_apart(spark):
    """Two sessions run one statement at a time: each sees what its own role may."""
    lake = {"t": spark.createDataFrame([(1, "eu"), (2, "us"), (3, "us")], "k int, region string")}
    source = lambda ref: lake[ref.name.lower()]
    stats = spark.createDataFrame([("D", "S", "t", 10, 3, "active", "include", None)], "database string, schema string, name string, bytes long, rows_count long, sync_state string, source string, view_strategy string")
    deps = spark.createDataFrame([], "parent_db string, parent_schema string, parent_name string, dep_db string, dep_schema string, dep_name string")
    marks = spark.createDataFrame([("D", "S", "t", "p", "UPPER(region) = CURRENT_ROLE()")], "database string, schema string, name string, policy_name string, body string")
    engine = Engine(spark, source, TableWarehouse(spark, source), Control(stats, deps, marks), Config(policy_mode="enforce"))
    got = {role: engine.execute("SELECT k FROM t ORDER BY k", Session(role=role, database="D", schema="S")) for role in ("EU", "US", "XX")}
    assert {role: [r.k for r in g.df.collect()] for role, g in got.items()} == {"EU": [1], "US": [2, 3], "XX": []}
    assert {g.outcome.route for g in got.values()} == {"lake"}
    written = engine.decide("DELETE FROM t WHERE k = 1", Session(database="D", schema="S"))
    assert (written.route, written.reason) == ("warehouse", "write_statement")


def test_remote_reads_every_partition(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "CAST(id AS STRING) AS s").repartition(5).write.parquet(str(tmp_path / "far"))
    far = remote.read_folder(spark, str(tmp_path / "far"))
    assert far.rdd.getNumPartitions() == 5 and far.count() == 1000
    assert sorted(r.id for r in far.where("k = 3 AND id < 50 AND s LIKE '%1'").collect()) == [31]
    # a reader that stops early is found out: the rows must add up to what was declared
    options = {"transport": "weirflow.sources.remote:FolderTransport", "with": json.dumps({"path": str(tmp_path / "far")})}
    reader = remote._Reader(far.schema, options)
    part = reader.partitions()[0]
    assert sum(b.num_rows for b in reader.read(part)) == part.rows
    with pytest.raises(remote.ShortRead):
        list(reader.read(remote.Part(part.name, part.rows + 1)))


def test_remote_holds_little_of_a_row_group(tmp_path):
    """A partition is decoded as it is asked for, however many rows its row group has; filters still hold."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "far.parquet")
    n, rng = 3_000_000, np.random.default_rng(1)
    pq.write_table(pa.table({"k": np.arange(n), "x": rng.random(n), "y": rng.random(n)}), path, row_group_size=n, use_dictionary=False)
    far = remote.FolderTransport(path)
    [(name, rows)] = far.partitions()
    before, most, seen = pa.total_allocated_bytes(), 0, 0
    for b in far.fetch(name, ["k", "x", "y"], []):
        seen += b.num_rows
        most = max(most, pa.total_allocated_bytes() - before)
    assert seen == rows == n and most < 24_000_000  # the row group has 72 MB
    got = [b for b in far.fetch(name, ["x"], [("k", ">=", 17), ("k", "<", 20), ("x", "not null", None)])]
    assert [b.schema.names for b in got] == [["x"]] and sum(b.num_rows for b in got) == 3
    assert list(far.fetch(name, ["x"], [("k", ">", n)])) == [] == list(far.fetch(name, ["x"], [("x", "in", [5.0])]))


def test_audit_report(spark):
    data = [("q1", "SELECT a FROM d.s.t WHERE b = 1", 3_600_000, "Small"), ("q2", "SELECT a FROM d.s.t WHERE b = 2", 0, "Small"), ("q3", "DELETE FROM d.s.t", 0, None), ("q4", "", 0, None), ("q5", "SELECT a FROM d.s.u, d.s.t", 1, "odd")]
    h = spark.createDataFrame([(i, q, "2026-01-01", ms, s) for i, q, ms, s in data], "query_id string, query_text string, start_time string, execution_time long, warehouse_size string")
    out = audit.report(h, n=1)
    assert out["total_queries"] == 5 and out["total_dollars"] == 6.0
    assert out["routable_static"]["count"] == 3 and out["routable_conservative"]["count"] == 2
    assert out["routable_static"]["annualized"] == 73.0 and out["passthrough"] == {"writes": 1, "features": 0, "parse_failed": 0, "no_tables": 1}
    assert out["top_patterns"][0]["pattern"] == "SELECT a FROM d.s.t WHERE b = ?" and out["top_patterns"][0]["freq"] == 2
    for show in (audit.to_json, audit.to_markdown, audit.to_table):
        assert show(out)


def test_bench_numbers():
    assert benchmarks.delta(2.0, None) == "infinite" and benchmarks.delta(2.0, 3.0) == 1.5
    mix = benchmarks.query_mix({"a": 0.9, "b": 0.1}, 1000)
    assert mix == benchmarks.query_mix({"a": 0.9, "b": 0.1}, 1000) and 850 < mix.count("a") < 950


def test_closure_depth(spark):
    """Dependencies below the cap are never left out without notice."""
    from weirflow.operators import control

    chain = [(f"v{i}", f"v{i + 1}") for i in range(4)] + [("v4", "base"), ("a", "b"), ("b", "a"), ("a", "t")]
    spark.createDataFrame(chain, "parent string, dep string").createOrReplaceTempView("chain_edges")
    spark.createDataFrame([("v0",), ("a",)], "root string").createOrReplaceTempView("chain_roots")
    spark.createDataFrame([("v1",), ("a",)], "root string").createOrReplaceTempView("near_roots")
    want = {("a", "b", 1), ("a", "t", 1), ("a", "a", 2)}
    with pytest.raises(control.DepGraphTooDeep, match="v0"):
        control.closure(spark, "chain_edges", "chain_roots")
    whole = control.closure(spark, "chain_edges", "chain_roots", max_depth=None)
    assert {tuple(r) for r in whole.collect()} == want | {("v0", f"v{i}", i) for i in range(1, 5)} | {("v0", "base", 5)}
    near = control.closure(spark, "chain_edges", "near_roots")
    assert {tuple(r) for r in near.collect()} == want | {("v1", f"v{i}", i - 1) for i in range(2, 5)} | {("v1", "base", 4)}
