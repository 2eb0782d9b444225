"""Warehouse functions as Spark columns, all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iff(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def decode(e: Column, *args: Column) -> Column:
    """Null-safe search: value, result pairs and an optional default."""
    out = None
    for i in range(0, len(args) - 1, 2):
        out = (out or F).when(e.eqNullSafe(args[i]), args[i + 1])
    return out.otherwise(args[-1]) if len(args) % 2 else out


def equal_null(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def zeroifnull(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def nvl2(a: Column, b: Column, c: Column) -> Column:
    return F.when(a.isNotNull(), b).otherwise(c)


def date_trunc(unit: str, x: Column) -> Column:
    return F.date_trunc(unit, x).cast("timestamp_ntz")


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit crossed between a and b."""
    if unit == "year":
        return F.year(b) - F.year(a)
    if unit == "quarter":
        return (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    if unit == "month":
        return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "week":
        return (F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("int")
    if unit == "day":
        return F.datediff(b.cast("date"), a.cast("date"))
    size = {"hour": 3600, "minute": 60, "second": 1}[unit]
    at = lambda x: F.floor(F.unix_seconds(x.cast("timestamp")) / size)
    return at(b) - at(a)


def convert_timezone(zone: str, ts: Column) -> Column:
    return F.convert_timezone(None, F.lit(zone), ts)


def object_construct(**fields: Column) -> Column:
    """JSON object that keeps nulls."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def get_path(text: Column, path: str, kind: str = "string") -> Column:
    """Typed value at a dotted path of JSON text; null where absent or of another type."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{path}", kind)


def time_slice(ts: Column, seconds: int) -> Column:
    """Start of the slice of so many seconds that holds ts."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")


def decimal_from_text(text: Column, precision: int, scale: int) -> Column:
    """Decimal cell: digits beyond the scale are cut, not rounded; bad cells are null."""
    clean = F.regexp_extract(F.trim(text), rf"^[+-]?\d+(\.\d{{0,{scale}}})?", 0)
    ok = F.trim(text).rlike(r"^[+-]?\d+(\.\d*)?$")
    return F.when(ok, F.rtrim(clean, F.lit("."))).try_cast(f"decimal({precision},{scale})")
