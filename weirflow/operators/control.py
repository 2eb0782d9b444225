"""Queries over the control tables: table statistics and states, view dependencies, policy markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

KEY = ["database", "schema", "name"]


def estimate(wanted: DataFrame, stats: DataFrame, deps: DataFrame, measure: str = "bytes") -> DataFrame:
    """(ord, estimate) per wanted (ord, database, schema, name); a decomposed view is the sum of what it depends on."""
    plain = wanted.join(stats.where("coalesce(view_strategy, '') <> 'decomposed'"), KEY).select("ord", measure)
    views = wanted.join(stats.where("view_strategy = 'decomposed'").select(*KEY), KEY)
    below = deps.select(F.col("parent_db").alias("database"), F.col("parent_schema").alias("schema"), F.col("parent_name").alias("name"), "dep_db", "dep_schema", "dep_name")
    base = stats.select(F.col("database").alias("dep_db"), F.col("schema").alias("dep_schema"), F.col("name").alias("dep_name"), measure)
    through = views.join(below, KEY).join(base, ["dep_db", "dep_schema", "dep_name"]).select("ord", measure)
    sums = plain.unionAll(through).groupBy("ord").agg(F.sum(measure).alias("estimate"))
    return wanted.select("ord").join(sums, "ord", "left").select("ord", F.coalesce("estimate", F.lit(0)).cast("long").alias("estimate"))


def states(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """(ord, sync_state, active) in the wanted order; state is null for unknown tables."""
    return wanted.join(stats.select(*KEY, "sync_state"), KEY, "left").select("ord", "sync_state", (F.coalesce("sync_state", F.lit("")) == "active").alias("active"))


def first_blocker(wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """The first table in query order that isn't active."""
    return states(wanted, stats).where("not active").agg(F.min_by("sync_state", "ord").alias("sync_state"), F.min("ord").alias("ord"))


def discover(stats: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert of seen (database, schema, name, source): remote beats include beats what is there; new tables are pending."""
    new = seen.withColumnRenamed("source", "seen")
    rank = F.when(F.col("seen") == "remote", "remote").when((F.col("seen") == "include") & (F.coalesce("source", F.lit("")) != "remote"), "include").otherwise(F.coalesce("source", "seen"))
    return stats.join(new, KEY, "full").select(*KEY, rank.alias("source"), F.coalesce("sync_state", F.lit("pending")).alias("sync_state"))


def refreshed(stats: DataFrame, gone: DataFrame) -> DataFrame:
    """Named tables go back to pending; their progress is cleared by `dropped`."""
    hit = gone.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return stats.join(hit, KEY, "left").withColumn("sync_state", F.when(F.col("_hit"), "pending").otherwise(F.col("sync_state"))).drop("_hit")


def dropped(table: DataFrame, gone: DataFrame, *prefixes: str) -> DataFrame:
    """Rows of a control table without those of the named tables; prefixes name key columns, both sides of a dependency."""
    for p in prefixes or ("",):
        cols = {"": KEY, "parent": ["parent_db", "parent_schema", "parent_name"], "dep": ["dep_db", "dep_schema", "dep_name"]}[p]
        table = table.join(gone.select(*[F.col(k).alias(c) for k, c in zip(KEY, cols, strict=True)]).distinct(), cols, "left_anti")
    return table


def idle(stats: DataFrame, deps: DataFrame, now: str, days: int) -> DataFrame:
    """Tables not queried in so many days: discovered ones, and view dependencies without an active parent."""
    old = F.coalesce("last_queried_at", "discovered_at") < F.to_timestamp_ntz(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAY")
    quiet = stats.where(old & (F.col("sync_state") == "active"))
    active = stats.where("sync_state = 'active'").select(F.col("database").alias("parent_db"), F.col("schema").alias("parent_schema"), F.col("name").alias("parent_name"))
    held = deps.join(active, ["parent_db", "parent_schema", "parent_name"]).select(F.col("dep_db").alias("database"), F.col("dep_schema").alias("schema"), F.col("dep_name").alias("name")).distinct()
    found = quiet.where("source = 'discovered'").unionByName(quiet.where("source = 'view_dependency'").join(held, KEY, "left_anti"))
    return found.select(*KEY)


class DepGraphTooDeep(ValueError):
    """Views whose dependencies go on below the depth that a walk may reach."""


def closure(spark, edges: str, roots: str, max_depth: int | None = 4, beyond: str = "raise") -> DataFrame:
    """(root, dep, depth): what views depend on, level by level over views `edges`(parent, dep) and `roots`(root).

    A dependency is met once, at its least depth, so that cycles end. Where dependencies go on below `max_depth`,
    DepGraphTooDeep is raised; beyond="stop" asks for the levels down to it only. Without `max_depth` all are walked.
    """
    # each level is cut from its plan, which would double with every level
    cut = lambda x: staged(x, "closure")
    e = cut(spark.table(edges).select("parent", F.col("dep").alias("next")).distinct())
    step = spark.table(roots).select("root", F.col("root").alias("dep")).distinct()
    found, depth = step.limit(0).withColumn("depth", F.lit(0)), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        below = step.join(e, step["dep"] == e["parent"]).select("root", F.col("next").alias("dep")).distinct()
        step = cut(below.join(found, ["root", "dep"], "left_anti").withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            return found
        found = found.unionByName(step)
    if beyond == "raise":
        deep = step.join(e, step["dep"] == e["parent"]).select("root").distinct().limit(10).collect()
        if deep:
            raise DepGraphTooDeep(f"dep_graph_too_deep: {', '.join(sorted(str(r[0]) for r in deep))} beyond max_depth={max_depth}")
    return found


def bootstrap_plan(views: DataFrame, deps: DataFrame, stats: DataFrame) -> DataFrame:
    """(name, action) per view (name, class): decompose, stream_on_view or wait."""
    joined = deps.join(stats.select(F.col("name").alias("dep"), "sync_state", "excluded"), "dep", "left").groupBy("name").agg(F.bool_and(F.coalesce(F.col("sync_state") == "active", F.lit(False))).alias("ready"), F.bool_or(F.coalesce("excluded", F.lit(False))).alias("excluded"))
    v = views.join(joined, "name", "left").withColumn("usable", (F.col("class") != "unsupported") & ~F.coalesce("excluded", F.lit(False)))
    action = F.when(F.col("usable") & F.coalesce("ready", F.lit(True)), "decompose").when(~F.col("usable") & (F.col("class") == "stream_compatible"), "stream_on_view").when(F.col("usable"), "wait").otherwise("stream_on_view")
    return v.select("name", action.alias("action"))


def status(stats: DataFrame) -> DataFrame:
    return stats.groupBy("sync_state").agg(F.count("*").alias("tables"), F.sum("bytes").cast("long").alias("bytes"), F.sum("rows_count").cast("long").alias("rows"))


def markers_for(wanted: DataFrame, markers: DataFrame) -> DataFrame:
    """(ord, policy_name): the least policy name of each wanted table, null if none."""
    return wanted.join(markers.groupBy(*KEY).agg(F.min("policy_name").alias("policy_name")), KEY, "left").select("ord", "policy_name")
