"""Workload audit over query history: what could run on the lake, and what that saves."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..plans.analysis import classify_query

#: Credits per hour by warehouse size. Fixed values.
CREDITS = {"X-SMALL": 1, "XSMALL": 1, "SMALL": 2, "MEDIUM": 4, "LARGE": 8, "X-LARGE": 16, "XLARGE": 16, "2X-LARGE": 32, "3X-LARGE": 64, "4X-LARGE": 128, "5X-LARGE": 256, "6X-LARGE": 512}
PRICE, TOP_N, WINDOW_DAYS, PATTERNS = 3.0, 20, 30, 10
ANALYSIS = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("redacted", T.StringType())])


def credits_per_hour(size: Column) -> Column:
    """Unknown and null sizes cost 0."""
    name = F.regexp_replace(F.upper(F.trim(size)), "[ _]", "-")
    table = F.create_map(*[F.lit(x) for k, v in CREDITS.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, name), F.lit(0.0))


def credits(ms: Column, size: Column) -> Column:
    return ms / F.lit(3_600_000.0) * credits_per_hour(size)


#: Literals whose value the analysis doesn't look at: strings, and numbers after an operator, comma or bracket.
_STRING = r"'(?:[^']|'')*'"
_NUMBER = r"(?<=[=<>(,]|[=<>(,] )\d+(?:\.\d+)?(?=$|[ ,)])"
#: Where one of these is in a text, a quote may not be what it seems: comments, dollar quotes, escapes, names.
_DOUBT = r'''--|/\*|//|[$\\"]'''


def shape_of(text: Column) -> Column:
    """Text with literals replaced by '0' and 0, so that texts which differ in them only are equal.

    The analysis of the shape is that of the text: it sees a literal either way, and redaction turns either
    into one mark. Texts in doubt, or with an odd number of quotes, are left as they are.
    """
    masked = F.regexp_replace(F.regexp_replace(text, _STRING, "'0'"), _NUMBER, "0")
    odd = F.length(F.regexp_replace(text, "[^']", "")) % 2 == 1
    return F.when(odd | text.rlike(_DOUBT), text).otherwise(masked)


@F.pandas_udf(ANALYSIS)
def _classify(texts: pd.Series) -> pd.DataFrame:
    found = [classify_query(t or "") for t in texts]
    return pd.DataFrame([(a.bucket, a.reason, [x.fqn for x in a.tables], a.redacted) for a in found], columns=["bucket", "reason", "tables", "redacted"])


# Else a filter on its result would be carried over the join by shape, to every row of the history.
_classify = _classify.asNondeterministic()


def classified(history: DataFrame, price: float = PRICE) -> DataFrame:
    """History with bucket, reason, tables, redacted text and dollars.

    Only distinct shapes of texts are parsed, in Python; the shapes are found and joined back in the JVM.
    """
    h = history.withColumn("_shape", shape_of(F.coalesce("query_text", F.lit(""))))
    known = h.select(F.col("_shape").alias("_text")).distinct().select("_text", _classify("_text").alias("a"))
    joined = h.join(known, h["_shape"] == known["_text"])
    return joined.select(*[h[c] for c in history.columns], "a.*", (credits(F.col("execution_time"), F.col("warehouse_size")) * price).alias("dollars"))


def totals(c: DataFrame) -> DataFrame:
    n = lambda cond, name: F.count_if(cond).alias(name)
    passed = F.col("bucket") == "passthrough"
    return c.agg(
        F.count("*").alias("total"), n(F.col("bucket") == "routable", "routable"), n(passed & (F.col("reason") == "write"), "writes"),
        n(passed & (F.col("reason") == "feature"), "features"), n(passed & (F.col("reason") == "parse_failed"), "parse_failed"),
        n(F.col("bucket") == "unknown", "no_tables"), F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("dollars"),
        F.min("start_time").alias("first"), F.max("start_time").alias("last"),
    )


def table_spend(c: DataFrame) -> DataFrame:
    """Dollars per primary table, the first a query names."""
    return c.where("bucket = 'routable'").groupBy(F.col("tables")[0].alias("table_fqn")).agg(F.sum("dollars").alias("dollars"), F.count("*").alias("queries"))


def top_tables(c: DataFrame, n: int = TOP_N) -> DataFrame:
    return table_spend(c).orderBy(F.col("dollars").desc(), "table_fqn").limit(n)


def conservative(c: DataFrame, n: int = TOP_N) -> DataFrame:
    """Routable queries whose primary table, the first they name, is among the top n by spend."""
    top = F.broadcast(top_tables(c, n).select(F.col("table_fqn").alias("_top")))
    return c.where("bucket = 'routable'").join(top, F.col("tables")[0] == F.col("_top"), "left_semi")


def summary(total: int, dollars: float, routable: int, saved: float, days: int = WINDOW_DAYS) -> dict:
    """Share, cost per query afterwards, savings in the window and a year."""
    post = max(dollars - saved, 0.0) / total if total else 0.0
    saved = max(saved, 0.0)
    return {"count": routable, "pct": round(100 * routable / total, 2) if total else 0.0, "dollar_per_query_post": round(post, 4), "dollars_saved": round(saved, 2), "annualized": round(saved * 365 / days, 2) if days else 0.0}


def patterns(c: DataFrame, n: int = PATTERNS) -> DataFrame:
    """The n most frequent (table, redacted text) patterns."""
    g = c.where("bucket = 'routable'").groupBy(F.col("tables")[0].alias("table_fqn"), F.col("redacted").alias("pattern"))
    g = g.agg(F.count("*").alias("freq"), F.expr("sum(execution_time) div count(*)").alias("avg_ms"), F.round(F.sum("dollars"), 2).alias("est_dollars"))
    order = [F.col("freq").desc(), F.col("est_dollars").desc(), F.col("table_fqn"), F.col("pattern")]
    top = g.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def report(history: DataFrame, price: float = PRICE, n: int = TOP_N, days: int = WINDOW_DAYS) -> dict:
    """The whole audit as one nested value; only totals and top lists reach the driver."""
    c = classified(history, price)
    t = totals(c).first()
    saved = lambda df: df.agg(F.coalesce(F.sum("dollars"), F.lit(0.0)).alias("d"), F.count("*").alias("n")).first()
    every, safe = saved(c.where("bucket = 'routable'")), saved(conservative(c, n))
    return {
        "window": {"start": str(t["first"]), "end": str(t["last"]), "days": days},
        "total_queries": t["total"], "total_dollars": round(t["dollars"], 2),
        "routable_static": summary(t["total"], t["dollars"], every["n"], every["d"], days),
        "routable_conservative": summary(t["total"], t["dollars"], safe["n"], safe["d"], days),
        "top_patterns": [r.asDict() for r in patterns(c).collect()],
        "passthrough": {k: t[k] for k in ("writes", "features", "parse_failed", "no_tables")},
    }


def to_json(out: dict) -> str:
    return json.dumps(out, indent=2, sort_keys=True, default=str)


def to_markdown(out: dict) -> str:
    rows = ["# Workload audit", "", f"{out['total_queries']} queries, ${out['total_dollars']}, {out['window']['days']} days", "", "| rank | freq | avg ms | table | pattern | $ |", "| --- | --- | --- | --- | --- | --- |"]
    rows += [f"| {p['rank']} | {p['freq']} | {p['avg_ms']} | {p['table_fqn']} | `{p['pattern']}` | {p['est_dollars']} |" for p in out["top_patterns"]]
    return "\n".join(rows) + "\n"


def to_table(out: dict) -> str:
    lines = []
    for name in ("routable_static", "routable_conservative"):
        s = out[name]
        lines.append(f"{name:24} {s['count']:>8} {s['pct']:>7.2f} % {s['dollars_saved']:>12.2f} $ {s['annualized']:>14.2f} $/year")
    return "\n".join(lines) + "\n"
