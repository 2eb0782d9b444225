"""Exact quantiles of large groups without holding a group in memory: histograms refined around the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import staged

BINS, FEW, ROUNDS = 1024, 4096, 40


def exact_quantiles(df: DataFrame, group: str, value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """(group, share, quantile) with linear interpolation between the two rows around the rank; rows without a group or value
    don't count.

    For each group and rank the range that holds it is cut into BINS bins, which are counted before the
    shuffle, until the bin with the rank has few rows or a single value; only these rows are then sorted. A
    group's range shrinks about a thousandfold a round, so numbers that differ are told apart in a few.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("x")).where("g IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    place = whole.select("g", "n", "lo", "hi", at).withColumn("p", F.col("share") * (F.col("n") - 1))
    # the two ranks around the place, each with a range of its own; `below` rows are less than the range
    ranks = place.select("g", "share", "p", "lo", "hi", F.col("n").alias("m"), F.lit(0).cast("long").alias("below"), F.explode(F.array_distinct(F.array(F.floor("p"), F.ceil("p")))).alias("rank"))
    state = staged(ranks, "ranks")
    open_ = (F.col("m") > few) & (F.col("lo") < F.col("hi"))
    for _ in range(ROUNDS):
        todo = state.where(open_)
        if todo.isEmpty():
            break
        # ranges are few: groups x shares x 2; equal ranges are counted once
        spans = todo.select("g", "lo", "hi").distinct()
        inside = rows.join(F.broadcast(spans) if spans.count() <= 10_000 else spans, "g").where("x >= lo AND x <= hi")
        number = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1).cast("long"))
        bins = inside.groupBy("g", "lo", "hi", number.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("z"))
        upto = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("bin")))
        step = todo.join(upto, ["g", "lo", "hi"]).where((F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("c")))
        step = step.select("g", "share", "p", F.col("a").alias("lo"), F.col("z").alias("hi"), F.col("c").alias("m"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), "rank")
        state = staged(state.where(~open_).unionByName(step), "ranks")
    known = state.where("lo = hi").select("g", "share", "p", "rank", F.col("lo").alias("x"))
    left = state.where("lo < hi")
    spans = left.select("g", "lo", "hi").distinct()
    inside = rows.join(spans, "g").where("x >= lo AND x <= hi")
    order = F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("x")) - 1
    sorted_ = inside.withColumn("k", order).withColumnRenamed("x", "v")
    found = left.join(sorted_, ["g", "lo", "hi"]).where(F.col("k") == F.col("rank") - F.col("below")).select("g", "share", "p", "rank", F.col("v").alias("x"))
    both = known.unionByName(found).groupBy("g", "share", "p").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return both.select(F.col("g").alias(group), "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p"))).alias("quantile"))
