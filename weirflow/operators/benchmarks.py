"""Benchmark analytics: cost per record, latency summaries and the weighted query mix."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import credits_per_hour

Z95 = 1.6448536269514722


def cost(ms: Column, size: Column, path: Column, price: float = 3.0) -> Column:
    """Hours x credits x price on the warehouse; the lake costs 0."""
    return F.when(path == "lake", F.lit(0.0)).otherwise(ms / F.lit(3_600_000.0) * credits_per_hour(size) * price)


def summarize(records: DataFrame) -> DataFrame:
    """(path, n, p50, p95, usd, per_dollar) of records (path, ms, usd); per_dollar is null where nothing was spent."""
    g = records.groupBy("path").agg(F.count("*").alias("n"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"), F.sum("usd").alias("usd"))
    return g.withColumn("per_dollar", F.when(F.col("usd") > 0, F.col("n") / F.col("usd")))


def delta(base: float | None, new: float | None) -> float | str | None:
    """Ratio of queries per dollar; "infinite" when the new path costs nothing."""
    if new is None:
        return "infinite"
    return round(new / base, 4) if base else None


def query_mix(weights: dict[str, float], n: int, seed: int = 7) -> list[str]:
    """A reproducible weighted sequence."""
    return random.Random(seed).choices(list(weights), list(weights.values()), k=n)


def lognormal_latency(p50: float, p95: float, seed: Column | int = 7) -> Column:
    """Random latency whose median and 95th percentile are as given."""
    return F.exp(F.lit(math.log(p50)) + F.randn(seed) * F.lit((math.log(p95) - math.log(p50)) / Z95))
