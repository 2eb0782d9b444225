"""Result text, order-insensitive digests and comparisons."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged


def cell_text(df: DataFrame, name: str) -> Column:
    """A value as the wire shows it; types without a text form show as <unsupported>."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000"))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.NumericType | T.StringType | T.BooleanType):
        return c.cast("string")
    return F.when(c.isNotNull(), F.lit("<unsupported>"))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[cell_text(df, c).alias(c) for c in df.columns])


def _float_text(c: Column) -> Column:
    """The shortest text that reads back as the value; whole numbers as integers read: 1.0 is 1, -0.0 is 0."""
    wide = c.cast("double")
    whole = (wide == F.floor(wide)) & (F.abs(wide) < 1e15)
    return F.when(whole, F.when(whole, wide).cast("long").cast("string")).otherwise(c.cast("string"))


def _body(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.FloatType | T.DoubleType):
        return _float_text(c)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType):
        return F.concat_ws("", F.transform(c, lambda x: canonical(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(canonical(e["key"], kind.keyType), canonical(e["value"], kind.valueType)))
        return F.concat_ws("", F.array_sort(pairs))
    if isinstance(kind, T.StructType):
        return F.concat(F.lit(""), *[canonical(c[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def canonical(c: Column, kind: T.DataType) -> Column:
    """Text that equal values share and others don't, whatever follows it: length, colon, body; N for null.

    Nested values are spelled out; a map's entries have no order.
    """
    body = _body(c, kind)
    return F.when(c.isNull(), "N").otherwise(F.concat(F.length(body).cast("string"), F.lit(":"), body))


def _hashes(df: DataFrame) -> DataFrame:
    """Two 64-bit hashes of each row, made in one pass without leaving the JVM."""
    row = F.concat(F.lit(""), *[canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    return df.select(row.alias("row")).select(*[F.xxhash64(F.lit(seed), "row").alias(f"h{i}") for i, seed in enumerate((11, 29))])


def _fold() -> list[Column]:
    """XOR and sum of each hash. XOR alone would cancel repeated rows; sums take 24 bits, so that no number
    of rows that fits on disks overflows them."""
    xors = [F.coalesce(F.bit_xor(f"h{i}"), F.lit(0)).alias(f"xor{i}") for i in range(2)]
    sums = [F.coalesce(F.sum(F.shiftrightunsigned(f"h{i}", 40)), F.lit(0)).alias(f"sum{i}") for i in range(2)]
    return [F.count("*").alias("n_rows"), *xors, *sums]


def digest(df: DataFrame) -> DataFrame:
    """One row that doesn't depend on the order of rows: count, XORs and sums of the rows' hashes."""
    return _hashes(df).agg(*_fold())


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, digest) of several tables in one job; a table without rows has no row."""
    parts = [_hashes(df).withColumn("name", F.lit(name)) for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("name").agg(*_fold())


def same_results(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same rows, in any order. The row count, which is part of the digest, is
    compared with it: both come from one pass."""
    if len(a.columns) != len(b.columns):
        return False
    found = [tuple(r)[1:] for r in digests({"a": a, "b": b}).collect()]
    return not found or (len(found) == 2 and found[0] == found[1])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one but not the other, as often as the counts differ."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def paged(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The result staged with its page, from 0, in the result's order. Pages stay where the tasks wrote them; only a
    number of rows for each task reaches the driver. One page is read by a filter on `_page`, ordered by `_row`."""
    at = F.monotonically_increasing_id()  # a task's number, then the row's place in the task
    held = staged(df.withColumn("_row", at), "pages")
    part = F.shiftright("_row", 33)
    shift, before = [], 0
    for r in sorted(held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        shift.append((r["part"], before - (r["part"] << 33)))
        before += r["n"]
    shifts = F.broadcast(df.sparkSession.createDataFrame(shift, "_part long, _shift long"))
    numbered = held.withColumn("_part", part).join(shifts, "_part").withColumn("_row", F.col("_row") + F.col("_shift"))
    return numbered.select(F.expr(f"_row div {int(rows)}").alias("_page"), "_row", *[F.col(f"`{c}`") for c in df.columns])


def pages(df: DataFrame, rows: int = 1000) -> Iterator[list]:
    """Sequential pages of a result that goes through the driver, which holds a page and two partitions at a time.
    For large results see `paged`."""
    page: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        page.append(r)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page
