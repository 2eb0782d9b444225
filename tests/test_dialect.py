"""The dialect by what it means: rewritten statements are run and their values compared; names, hints, splits
and decisions are checked on a small garden of tables."""

import datetime
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.plans import cost
from weirflow.plans.analysis import classify_query, classify_view, extract_tables, redact
from weirflow.plans.engine_queries import HINTS, ROUTES, VIEWS
from weirflow.plans.hints import parse_hints
from weirflow.plans.hybrid import Bail, ResultCache, build_plan
from weirflow.plans.rewrite import rewrite
from weirflow.plans.router import Config, Facts, Matcher, TtlCache, render, route
from weirflow.plans.tokens import SqlError, parse, text
from weirflow.session import Session, TableRef, parse_dotted

DAY, TIME = datetime.date, datetime.datetime


@pytest.fixture(scope="module")
def garden(spark):
    """Beds, two sowings in each, and readings as JSON."""
    spark.createDataFrame([(1, "north", 12.5, None), (2, "south", 0.0, "clay"), (3, None, -4.0, "sand")], "bed int, side string, area double, soil string").createOrReplaceTempView("beds")
    spark.sql("SELECT bed, kind, CAST(sown AS TIMESTAMP_NTZ) AS sown, note FROM VALUES (1, 'bean', '2023-12-31 23:30:00', 'IFF(x, y, z)'), (1, 'kale', '2024-02-29 06:00:00', ''), (2, 'bean', '2024-03-04 00:00:00', NULL), (3, 'leek', '2024-03-03 12:00:00', 'it''s late') AS v(bed, kind, sown, note)").createOrReplaceTempView("sowings")
    spark.createDataFrame([(1, '{"wet": 4, "at": {"depth": 30}}'), (2, '{"wet": null}'), (3, "{}")], "bed int, doc string").createOrReplaceTempView("probes")
    return lambda sql: [tuple(r) for r in spark.sql(rewrite(sql)).collect()]


VALUES = {
    # conditions, each with null on one side
    "SELECT bed, IFF(area > IFF(bed = 1, 10, 20), side, IFF(soil IS NULL, 'bare', soil)) FROM beds ORDER BY bed": [(1, "north"), (2, "clay"), (3, "sand")],
    "SELECT NVL(side, NVL(soil, 'none')) || NVL2(soil, '+', '-') FROM beds ORDER BY bed": [("north-",), ("south+",), ("sand+",)],
    "SELECT bed FROM beds WHERE EQUAL_NULL(side, NULLIF('a', 'a')) OR EQUAL_NULL(soil, side)": [(3,)],
    "SELECT DECODE(soil, 'clay', bed * 10, NULL, bed, -1) FROM beds ORDER BY bed": [(1,), (20,), (-1,)],
    "SELECT DECODE(side, 'south', 'warm') FROM beds ORDER BY bed": [(None,), ("warm",), (None,)],
    "SELECT SUM(ZEROIFNULL(NULLIF(area, -4.0))) FROM beds": [(12.5,)],
    "SELECT BOOLAND_AGG(area >= 0), BOOLOR_AGG(area > 12) FROM beds": [(False, True)],
    # dates: parts may be bare, quoted or short, bounds are counted and the type stays
    "SELECT DATEDIFF('year', sown, DATEADD(hour, 1, sown)), DATEDIFF(week, sown, DATEADD(day, 1, sown)) FROM sowings ORDER BY sown": [(1, 1), (0, 0), (0, 1), (0, 0)],
    "SELECT DATEADD('month', 12, CAST(sown AS DATE)) FROM sowings WHERE kind = 'kale'": [(DAY(2025, 2, 28),)],
    "SELECT DATE_TRUNC(quarter, sown), DATE_TRUNC('WEEK', sown) FROM sowings WHERE kind = 'leek'": [(TIME(2024, 1, 1), TIME(2024, 2, 26))],
    "SELECT CONVERT_TIMEZONE('Asia/Kathmandu', sown) FROM sowings WHERE kind = 'kale'": [(TIME(2024, 2, 29, 11, 45),)],
    "SELECT CONVERT_TIMEZONE('America/Lima', 'Asia/Tokyo', sown) FROM sowings WHERE bed = 3": [(TIME(2024, 3, 4, 2, 0),)],
    # documents
    "SELECT bed, CAST(GET_PATH(PARSE_JSON(doc), 'at.depth') AS INT) FROM probes ORDER BY bed": [(1, 30), (2, None), (3, None)],
    "SELECT p.bed, f.key FROM probes p, LATERAL FLATTEN(input => PARSE_JSON(p.doc)) f WHERE p.bed < 3 ORDER BY 1, 2": [(1, "at"), (1, "wet"), (2, "wet")],
    "SELECT ARRAY_CONSTRUCT(bed, 7, bed + 1)[2] FROM beds ORDER BY bed": [(2,), (3,), (4,)],
    # windows
    "SELECT kind, bed FROM sowings QUALIFY ROW_NUMBER() OVER (PARTITION BY kind ORDER BY sown DESC) = 1 ORDER BY kind": [("bean", 2), ("kale", 1), ("leek", 3)],
    "SELECT * EXCLUDE (sown, note) FROM sowings QUALIFY COUNT(*) OVER (PARTITION BY bed) > 1 ORDER BY kind": [(1, "bean"), (1, "kale")],
    # what only looks like a call stays as it is
    "SELECT note, 'NVL(1, 2)' FROM sowings WHERE note = 'IFF(x, y, z)' -- DECODE(a, b)": [("IFF(x, y, z)", "NVL(1, 2)")],
    "SELECT /* DATEADD(day, 1, x) */ note FROM sowings WHERE note LIKE 'it''s%'": [("it's late",)],
}


@pytest.mark.parametrize("sql", VALUES)
def test_meaning(garden, sql):
    assert garden(sql) == VALUES[sql]


@pytest.mark.parametrize("sql", ["SELECT OBJECT_CONSTRUCT('odd') FROM beds", "SELECT GET_PATH(doc, other) FROM probes"])
def test_calls_that_have_no_form_stay(sql):
    assert rewrite(sql) == sql


def test_three_parts_lose_the_database_and_columns_keep_theirs():
    assert rewrite("SELECT plot.beds.bed FROM farm.plot.beds JOIN plot.sowings USING (bed)") == "SELECT plot.beds.bed FROM plot.beds JOIN plot.sowings USING (bed)"
    assert rewrite("SELECT 1 FROM one.two.three.four") == "SELECT 1 FROM one.two.three.four"


def test_hidden_column():
    """Wildcards over a holder leave the row id out, once, wherever they stand."""
    held = lambda name: name.endswith("sowings")
    for sql, want in (
        ("SELECT w.*, bed * 2 FROM sowings w", "SELECT w.* EXCEPT (__row_id), bed * 2 FROM sowings w"),
        ("SELECT * EXCLUDE (note) FROM sowings", "SELECT * EXCEPT (note, __row_id) FROM sowings"),
        ("SELECT n FROM (SELECT * FROM sowings) x, beds", "SELECT n FROM (SELECT * EXCEPT (__row_id) FROM sowings) x, beds"),
        ("SELECT COUNT(*) FROM sowings", None), ("SELECT * FROM beds", None), ("WITH sowings AS (SELECT 2) SELECT * FROM sowings", None),
    ):
        once = rewrite(sql, held)
        assert once == (want or sql)
        assert rewrite(once, held) == once


_piece = st.sampled_from(["SELECT", "beds", '"a b"', "`tick`", "'it''s'", "$$raw ' text$$", "1.5e-3", "<=", "--x\n", "/* y */", ",", ".", " ", "\n", "é"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(_piece, st.sampled_from(["", "()", "[]"])), max_size=25))
def test_tokens_round_trip(parts):
    sql = " ".join(p + b.replace(")", f"{p} )").replace("]", " 0 ]") if not p.startswith("--") else p for p, b in parts)
    assert text(parse(sql)) == sql


@pytest.mark.parametrize("sql", ["SELECT f(1", "SELECT 1]", "SELECT 'open", "SELECT /* open", "SELECT (1]"])
def test_unbalanced(sql):
    with pytest.raises(SqlError):
        parse(sql)


def test_registered_hints_routes_and_views():
    for sql, r, s in HINTS:
        assert (parse_hints(sql).route, parse_hints(sql).strategy) == (r, s)
    for name, sql, kw, r, why in ROUTES:
        out = route(sql, **kw)
        assert (out.route, out.reason) == (r, why), name
        assert f"route: {r}" in render(sql, out).splitlines()
    for sql, kind, reasons in VIEWS:
        assert classify_view(sql) == (kind, reasons.split(",") if reasons else [])


def test_relations():
    s = Session(database="FARM", schema="PLOT")
    found = lambda sql: sorted({t.fqn for t in extract_tables(sql, s)})
    assert found("SELECT CURRENT_DATE()") == []
    assert found("SELECT b.bed FROM beds b, shed.tools t LEFT JOIN old.shed.tools USING (id) WHERE EXISTS (SELECT 1 FROM probes p WHERE p.bed = b.bed)") == ["FARM.PLOT.beds", "FARM.PLOT.probes", "FARM.shed.tools", "old.shed.tools"]
    assert found("WITH early AS (SELECT * FROM sowings) SELECT * FROM early JOIN (SELECT bed FROM beds) b USING (bed)") == ["FARM.PLOT.beds", "FARM.PLOT.sowings"]
    assert found("SELECT EXTRACT(MONTH FROM sown), SUBSTRING(kind FROM 2) FROM sowings WHERE soil IS NOT DISTINCT FROM kind") == ["FARM.PLOT.sowings"]
    assert [parse_dotted(x, "D") for x in ("", "x", "a..b", "p.q.r.s")] == [None] * 4
    assert parse_dotted("p.q", "D", "S") == TableRef("D", "p", "q")


def test_redaction_takes_literals_only():
    for sql, want in {
        "SELECT kind2, 3 FROM beds4 WHERE side = 'south' AND area >= 1.25": "SELECT kind2, ? FROM beds4 WHERE side = ? AND area >= ?",
        "SELECT \"Bed No 5\", 'o''clock' FROM `t 6`": 'SELECT "Bed No 5", ? FROM `t 6`',
        "SELECT $$pass word$$, $q$x 1$q$ -- keep 'this' 7": "SELECT ?, ? -- keep 'this' 7",
    }.items():
        assert redact(sql) == want
        assert redact(want) == want
    assert classify_query("SELECT bed FROM farm.plot.beds WHERE bed = 9").redacted.endswith("bed = ?")


def test_globs_by_precedence():
    m = Matcher(include=("FARM.*.*",), exclude=("*.SHED.*",), remote=("*.*.*_FAR", "FARM.SHED.*"))
    cases = {("farm", "plot", "beds"): "included", ("farm", "shed", "tools"): "excluded", ("mill", "plot", "sacks_far"): "remote", ("mill", "plot", "sacks"): "not_matched", ("farm", "Information_Schema", "tables"): "excluded", ("farm", "plot", "_stage_x"): "excluded", ("snowflake", "a", "b"): "excluded"}
    assert {c: m.classify(TableRef(*c)) for c in cases} == cases


@given(st.integers(1, 10**9), st.integers(1, 10**12), st.integers(1, 9), st.floats(1, 5))
def test_cost_laws(rows, size, scans, ratio):
    """Costs grow with rows, bytes and scans; of two costs at most one is cheaper by the ratio."""
    m = cost.CostModel()
    assert m.attach(rows, size) < m.attach(rows + 5_000_000, size) and m.materialize(rows, size, scans) < m.materialize(rows, size + 10**8, scans)
    assert m.materialize(rows, size, scans) <= m.materialize(rows, size, scans + 1)
    a, b = m.attach(rows, size), m.materialize(rows, size, scans)
    assert not (cost.cheaper(a, b, ratio + 0.01) and cost.cheaper(b, a, ratio + 0.01))
    assert m.attach(0, size) is None and m.materialize(rows, 0) is None and not cost.cheaper(0.0, a, ratio)


def test_cost_values_and_placement():
    m = cost.CostModel()  # per second: 100 MB, 5 M rows in place, 12 M written, 25 M read again; 5 ms to begin
    assert m.attach(10_000_000, 50_000_000) == pytest.approx(2.5)
    assert m.materialize(6_000_000, 0 + 300_000_000, 3) == pytest.approx(3 + 0.005 + 0.5 + 0.72)
    assert [cost.placement(n, on) for n, on in ((1, True), (3, True), (1, False))] == ["attach", "materialize", "materialize"]


FARM = Session(database="FAR", schema="MILL")
FAR = {TableRef("far", "mill", t) for t in ("sacks", "carts", "roads")}
ON = Config(hybrid=True)


def split(sql, **given):
    return build_plan(sql, FARM, FAR, {}, {}, ON, **given)


def test_split_by_what_a_subquery_reads():
    """Two far tables joined in a subquery become one fragment, the far table beside near ones is attached."""
    p = split("SELECT r.name FROM far.mill.roads r LEFT JOIN near.farm.beds b ON b.road = r.id WHERE r.id NOT IN (SELECT c.road FROM far.mill.carts c JOIN far.mill.sacks s ON s.cart = c.id WHERE s.kilos > 40)")
    assert (p.strategy, len(p.fragments), len(p.attached)) == ("mixed", 1, 1)
    (f,) = p.fragments
    assert {t.name for t in f.tables} == {"carts", "sacks"} and "kilos > 40" in f.sql and f.name in p.local_sql
    assert list(p.attached.values()) == ["link__far__mill__roads"] and "link__far__mill__roads" in p.local_sql and "kilos" not in p.local_sql


def test_split_edges():
    assert split("SELECT a.id FROM far.mill.carts a, far.mill.carts b WHERE a.next = b.id").fragments[0].scans == 2
    tied = split("SELECT b.bed FROM near.farm.beds b WHERE b.bed IN (SELECT c.bed FROM far.mill.carts c JOIN far.mill.sacks s ON s.cart = c.id WHERE c.road = b.road)")
    assert not tied.fragments and len(tied.attached) == 2  # the subquery needs a row of the outer statement
    assert split("SELECT road FROM far.mill.carts", attach=False).strategy == "materialize"
    for bad in ("SELECT SUM(kilos) OVER (PARTITION BY cart) FROM far.mill.sacks", "SELECT id FROM far.mill.carts EXCEPT SELECT road FROM far.mill.carts", "SELECT id FROM far.mill.carts QUALIFY RANK() OVER (ORDER BY id) < 3"):
        with pytest.raises(Bail):
            split(bad)


def test_caches():
    now, sown = [100.0], TableRef("F", "P", "sown")
    c = TtlCache(size=2, seconds=5, clock=lambda: now[0])
    made = []
    get = lambda key, *tables: c.get(key, lambda: made.append(key) or len(made), tables)
    assert [get("a", sown), get("a"), c.peek("a"), c.peek("b")] == [1, 1, 1, None]
    now[0] += 5
    assert not c.fresh("a") and get("a", sown) == 2
    assert c.invalidate(sown) == 1 and get("a") == 3
    get("b"), get("a"), get("c")
    assert c.fresh("a") and not c.fresh("b")  # the least recently used one went
    r = ResultCache(seconds=5, size=2, clock=lambda: now[0])
    r.put(FARM, "q", [(1,)], (sown,))
    r.put(FARM, "none", [], ())
    assert r.get(FARM, "q") == [(1,)] and r.get(Session(role="OTHER", database="FAR", schema="MILL"), "q") is None and r.get(FARM, "none") is None
    r.invalidate(sown)
    assert r.get(FARM, "q") is None and ResultCache().get(FARM, "q") is None


def test_an_estimate_that_fails_is_too_large():
    assert route("SELECT bed FROM beds", facts=Facts(estimate_failed=True)).reason == "above_threshold"


def test_decimal_literals_stay_exact(spark):
    assert spark.sql(rewrite("SELECT IFF(true, 0.10, 0.2) + NVL(NULL, 0.20)")).first()[0] == decimal.Decimal("0.30")
