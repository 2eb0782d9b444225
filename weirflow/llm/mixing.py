"""Mix sources to target weights with hash-threshold histograms.

Each document has a fixed key, the MD5 of its id. A source's tokens are summed by the first two hex
digits of the key; the bucket in which the running sum passes the budget is the boundary, and only
its rows are summed again by the next two digits, until the boundary is one key. Documents below the
boundary key are taken. Budgets are nested: a larger budget takes a superset. No document is sorted,
only the 256 sums of a source are.

A source whose target is above its size repeats whole documents: every one floor(target / size)
times and those below the boundary once more. The boundary key is taken if that brings the source
nearer to its target.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last
in order; a null id has the key of the empty string; rows with one id go together; an empty table
gives an empty result; reruns agree, as nothing depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small, staged, with_ordinal, words_of

#: Weights dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: No target exceeds so many times its source's size.
MAX_REPEATS = 3
DIGITS = 2


def targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds weight and target to (ordinal, source_size). The excess of capped sources is reshared
    until no target is above its cap; only two sums a round come to the driver."""
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_repeats
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rest, free = total, s.agg(F.sum("weight")).first()[0] or 0
    while free:
        over = cap * F.lit(float(free)) <= F.col("weight") * F.lit(float(rest))
        fixed, still = s.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        left, open_weight = total - (fixed or 0), still or 0
        if open_weight == free:
            break
        rest, free = left, open_weight
    if not free:
        return s.withColumn("target", cap.cast("double"))
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(free))
    return s.withColumn("target", F.when(cap * F.lit(float(free)) <= F.col("weight") * F.lit(float(rest)), cap.cast("double")).otherwise(share))


def boundaries(items: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """(ordinal, budget) to (ordinal, edge, take_edge): keys below edge fit the budget."""
    state = budgets.select("ordinal", "budget", F.lit("").alias("edge"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("inside"), F.lit(False).alias("one"))
    for level in range(32 // DIGITS):
        done = level * DIGITS
        digits = F.substring("key", done + 1, DIGITS)
        todo = state.filter(~F.col("one"))
        sums = (
            items.join(small(todo, n_sources), "ordinal")
            .filter(F.substring("key", 1, done) == F.col("edge") if done else F.lit(True))
            .groupBy("ordinal", digits.alias("digits"))
            .agg(F.sum("size").alias("sum"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("budget").alias("budget"), F.first("edge").alias("edge"), F.first("before").alias("before"))
        )
        run = F.sum("sum").over(Window.partitionBy("ordinal").orderBy("digits"))
        past = sums.withColumn("upto", F.col("before") + run).filter(F.col("upto") > F.col("budget"))
        first = past.groupBy("ordinal").agg(F.min_by(F.struct("*"), "digits").alias("x"))
        step = first.select(
            "ordinal", F.col("x.budget").alias("budget"),
            F.when(F.col("x.lo") == F.col("x.hi"), F.col("x.lo")).otherwise(F.concat("x.edge", "x.digits")).alias("edge"),
            (F.col("x.upto") - F.col("x.sum")).alias("before"), F.col("x.sum").alias("inside"), (F.col("x.lo") == F.col("x.hi")).alias("one"),
        )
        state = state.filter("one").unionByName(step).checkpoint()
        if not state.filter(~F.col("one")).limit(1).count():
            break
    nearer = F.col("before") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("before")
    return state.select("ordinal", "edge", nearer.alias("take_edge"))


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS):
    """(numbered documents with sizes and keys, one row per source with its target, copies and edge, number of sources)"""
    size = F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long")
    items = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _key(F.col(doc_id)).alias("key")), "mix")
    by_source = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = with_ordinal(by_source, "sources", F.col("source").asc_nulls_last())
    plan = targets(sources, weights, max_repeats)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    plan = staged(plan, "plan")
    n = plan.count()
    # the source's number takes the place of its name, so that null needs no care in later joins
    names = small(plan.select(F.col("source").alias("name"), "ordinal"), n)
    numbered = items.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    edges = boundaries(numbered, plan.filter("budget > 0").select("ordinal", "budget"), n)
    return numbered, staged(plan.join(edges, "ordinal", "left"), "edges"), n


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _copies() -> Column:
    once_more = (F.col("key") < F.col("edge")) | ((F.col("key") == F.col("edge")) & F.col("take_edge"))
    return F.col("times") + F.when(once_more, 1).otherwise(0)


def mix(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken); taken is size times copies."""
    numbered, plan, n = plan_mix(docs, **kw)
    mixed = numbered.join(small(plan.drop("source"), n), "ordinal").withColumn("copies", _copies())
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The documents the mix takes, all columns, each as often as the mix says.

    A filter by key on the documents themselves; documents without a word add nothing and stay out.
    """
    _, plan, n = plan_mix(docs, doc_id=doc_id, text=text, source=source, **kw)
    rows = docs.filter(F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(F.struct("*").alias("row"), _key(F.col(doc_id)).alias("key"), F.col(source).alias("name"))
    rows = rows.join(small(plan, n), F.col("name").eqNullSafe(F.col("source"))).withColumn("copies", _copies()).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
