"""Policy references, object kinds, view dependencies, and what follows when a change stream is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .control import KEY

#: Kinds, domains and status of the policies that protect tables. Fixed values.
POLICY_KINDS = ("ROW_ACCESS_POLICY", "MASKING_POLICY", "AGGREGATION_POLICY", "PROJECTION_POLICY")
POLICY_DOMAINS = ("TABLE", "VIEW", "MATERIALIZED_VIEW", "EXTERNAL_TABLE")
ACTIVE = "ACTIVE"

PARENT = ["parent_db", "parent_schema", "parent_name"]
DEP = ["dep_db", "dep_schema", "dep_name"]


def policy_references(raw: DataFrame) -> DataFrame:
    """(database, schema, name, policy_name, kind) of the active policies on table-like objects.

    Of `raw` (ref_database_name, ref_schema_name, ref_entity_name, ref_entity_domain, policy_name, policy_kind,
    policy_status). Rows without a full name are dropped; kind is row_access for row policies, else masking:
    whatever hides values counts as such.
    """
    named = [F.col(f"ref_{c}_name").alias(n) for c, n in (("database", "database"), ("schema", "schema"), ("entity", "name"))]
    held = raw.where(F.col("policy_kind").isin(*POLICY_KINDS) & F.col("ref_entity_domain").isin(*POLICY_DOMAINS) & (F.col("policy_status") == ACTIVE))
    kind = F.when(F.col("policy_kind") == "ROW_ACCESS_POLICY", "row_access").otherwise("masking")
    return held.select(*named, "policy_name", kind.alias("kind")).where(" AND ".join(f"coalesce({c}, '') <> ''" for c in KEY))


def object_kind(table_type: Column, secure: Column) -> Column:
    """base_table, view, secure_view, materialized_view, external_table or unknown."""
    kind = F.upper(F.trim(table_type))
    yes = F.upper(F.coalesce(secure.cast("string"), F.lit("NO"))).isin("YES", "TRUE")
    found = F.when(kind.isin("BASE TABLE", "LOCAL TEMPORARY", "TEMPORARY TABLE"), "base_table").when(kind == "VIEW", F.when(yes, "secure_view").otherwise("view"))
    return F.coalesce(found.when(kind == "MATERIALIZED VIEW", "materialized_view").when(kind == "EXTERNAL TABLE", "external_table"), F.lit("unknown"))


def object_kinds(wanted: DataFrame, tables: DataFrame, views: DataFrame) -> DataFrame:
    """wanted (database, schema, name) with kind, from information-schema rows; unknown where there are none."""
    return wanted.join(tables.select(*KEY, "table_type"), KEY, "left").join(views.select(*KEY, "is_secure"), KEY, "left").select(*wanted.columns, object_kind(F.col("table_type"), F.col("is_secure")).alias("kind"))


def view_sources(usage: DataFrame, tables: DataFrame, views: DataFrame) -> DataFrame:
    """Dependencies (parent..., dep..., dep_kind) from view-table-usage rows; incomplete names are dropped."""
    named = usage.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in DEP))
    as_wanted = named.select(*PARENT, *[F.col(c).alias(k) for c, k in zip(DEP, KEY, strict=True)])
    return object_kinds(as_wanted, tables, views).select(*PARENT, *[F.col(k).alias(c) for c, k in zip(DEP, KEY, strict=True)], F.col("kind").alias("dep_kind"))


def replace_dependencies(deps: DataFrame, fresh: DataFrame) -> DataFrame:
    """All dependencies of the parents in `fresh` give way to the fresh ones."""
    return deps.join(fresh.select(*PARENT).distinct(), PARENT, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_bodies(bodies: DataFrame, fresh: DataFrame) -> DataFrame:
    """View bodies (database, schema, name, body, ...) with a checksum; a fresh body replaces the stored one."""
    new = fresh.withColumn("checksum", F.sha2("body", 256))
    return bodies.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def dependents(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(database, schema, name) of the views that depend on changed tables, each once."""
    hit = changed.select(*[F.col(k).alias(c) for k, c in zip(KEY, DEP, strict=True)]).distinct()
    return deps.join(hit, DEP, "left_semi").select(*[F.col(c).alias(k) for c, k in zip(PARENT, KEY, strict=True)]).distinct()


#: What the text of a stream's failure says when only a new stream helps. Fixed values.
LOST_STREAM = ("does not exist", "002003", "stale")


def stream_lost(message: Column) -> Column:
    """Whether a stream's failure can't be cured by trying again."""
    text = F.lower(F.coalesce(message, F.lit("")))
    lost = (text.contains("offset")) & (text.contains("expired"))
    for part in LOST_STREAM:
        lost = lost | text.contains(part)
    return lost


def cascade(stats: DataFrame, deps: DataFrame, failures: DataFrame) -> DataFrame:
    """Table states after failures (database, schema, name, message) of change streams.

    A table whose stream is lost goes back to pending, and so do the views that depend on it, with the reason.
    Other failures change nothing: they are tried again.
    """
    lost = failures.where(stream_lost(F.col("message"))).select(*KEY).distinct()
    again = lost.withColumn("_why", F.lit("stream_lost")).unionByName(dependents(deps, lost).withColumn("_why", F.lit("dependency_invalidated")))
    again = again.groupBy(*KEY).agg(F.max("_why").alias("_why"))
    out = stats.join(again, KEY, "left")
    return out.withColumn("sync_state", F.when(F.col("_why").isNotNull(), "pending").otherwise(F.col("sync_state"))).withColumnRenamed("_why", "state_reason")
