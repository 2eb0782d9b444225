"""Text rowsets to typed columns. Bad cells become null, never an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decimal_from_text


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # text, fixed, real, boolean, date, timestamp_ntz, timestamp_ltz, timestamp_tz or a semi-structured kind
    precision: int = 38
    scale: int = 0


def spark_type(f: Field) -> str:
    if f.kind == "fixed":
        return "bigint" if f.scale == 0 and f.precision <= 18 else f"decimal({min(f.precision, 38)},{f.scale})"
    return {"real": "double", "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp_ntz", "timestamp_ltz": "timestamp", "timestamp_tz": "timestamp"}.get(f.kind, "string")


def typed(c: Column, f: Field) -> Column:
    """Dates are days and timestamps seconds since 1970, both as text, as the wire has them."""
    kind = spark_type(f)
    if f.kind == "fixed" and kind != "bigint":
        return decimal_from_text(c, min(f.precision, 38), f.scale)
    if f.kind == "boolean":
        t = F.lower(F.trim(c))
        return F.when(t.isin("true", "t", "1"), True).when(t.isin("false", "f", "0"), False)
    if f.kind == "date":
        return F.date_from_unix_date(c.try_cast("int"))
    if f.kind.startswith("timestamp"):
        micros = F.split(F.trim(c), " ")[0].try_cast("decimal(30,9)") * 1_000_000
        at = F.timestamp_micros(F.floor(micros).cast("long"))
        return at.cast(kind)
    return c.try_cast(kind)


def decode(rows: DataFrame, fields: list[Field]) -> DataFrame:
    return rows.select(*[typed(F.col(f.name), f).alias(f.name) for f in fields])


def wire_type(df: DataFrame) -> list[tuple[str, str]]:
    """(column, family) as result metadata shows it; decimals are reported as real."""
    families = {"bigint": "fixed", "int": "fixed", "smallint": "fixed", "tinyint": "fixed", "double": "real", "float": "real", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ltz", "timestamp_ntz": "timestamp_ntz", "binary": "binary"}
    return [(c, "real" if t.startswith("decimal") else families.get(t, "text")) for c, t in df.dtypes]
