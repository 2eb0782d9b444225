"""A warehouse that is read in partitions: a Python data source over a transport.

The statement's result comes as numbered partitions, each read by a task of its own; all of them are read,
and the rows must add up to the number that the warehouse declared. Columns that a query doesn't use and
comparisons with constants go to the transport, so that less crosses the network.

A transport is named by `module:class` and built from a JSON text, as options are text. `FolderTransport`
stands in where there is no warehouse: a table is a Parquet file or folder, a partition a row group.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "weirflow_remote"
#: Rows that the folder transport gives at a time, and bytes that it reads ahead in each column.
BATCH_ROWS, BUFFER_BYTES = 10_000, 1 << 20


class Transport(Protocol):
    def schema(self) -> pa.Schema: ...

    def partitions(self) -> list[tuple[str, int]]:
        """(name, rows) of each partition of the result."""

    def fetch(self, partition: str, columns: list[str], filters: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition for which all filters (column, operator, value) hold."""


class FolderTransport:
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[str]:
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet").files

    def schema(self) -> pa.Schema:
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet").schema

    def partitions(self) -> list[tuple[str, int]]:
        import pyarrow.parquet as pq

        found = []
        for f in self._files():
            meta = pq.ParquetFile(f).metadata
            found += [(json.dumps([f, g]), meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
        return found

    def fetch(self, partition: str, columns: list[str], filters: list[tuple]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        file, group = json.loads(partition)
        wanted = None
        for name, op, value in filters:
            f = ds.field(name)
            one = {"=": lambda: f == value, "<": lambda: f < value, "<=": lambda: f <= value, ">": lambda: f > value, ">=": lambda: f >= value, "in": lambda: f.isin(value), "not null": lambda: f.is_valid()}[op]()
            wanted = one if wanted is None else wanted & one
        fs, where = pafs.FileSystem.from_uri(file) if "://" in file else (pafs.LocalFileSystem(), file)
        part = ds.ParquetFileFormat().make_fragment(where, filesystem=fs, row_groups=[group])
        if wanted is not None and not part.split_by_row_group(filter=wanted):  # its statistics rule it out
            return
        read = list(dict.fromkeys([*columns, *(name for name, _, _ in filters)]))
        # a scan would decode the whole row group ahead of what is asked for; this reads it page by page
        with fs.open_input_file(where) as f, pq.ParquetFile(f, buffer_size=BUFFER_BYTES, pre_buffer=False) as file:
            for b in file.iter_batches(BATCH_ROWS, [group], read, use_threads=False):
                b = (b if wanted is None else b.filter(wanted)).select(columns)
                if b.num_rows or wanted is None:
                    yield b


def _build(options: dict[str, str]) -> Transport:
    module, _, name = options["transport"].partition(":")
    return getattr(importlib.import_module(module), name)(**json.loads(options.get("with", "{}")))


@dataclass
class Part(InputPartition):
    name: str
    rows: int


class ShortRead(RuntimeError):
    """A partition had fewer or more rows than the warehouse declared."""


#: Filters that a transport can apply, by their operator.
_OPERATORS = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in", IsNotNull: "not null"}


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.options, self.filters = schema.fieldNames(), options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Spark applies what is given back; the rest goes to the transport."""
        for f in filters:
            if type(f) in _OPERATORS and len(f.attribute) == 1:
                value = list(f.value) if isinstance(f, In) else getattr(f, "value", None)
                self.filters.append((f.attribute[0], _OPERATORS[type(f)], value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        return [Part(n, rows) for n, rows in _build(self.options).partitions()]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows = 0
        for b in _build(self.options).fetch(part.name, self.names, self.filters):
            rows += b.num_rows
            yield b.select(self.names)
        if not self.filters and rows != part.rows:
            raise ShortRead(f"{part.name}: {rows} of {part.rows} rows")


class RemoteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        columns = self.options.get("columns")
        found = from_arrow_schema(_build(dict(self.options)).schema(), prefer_timestamp_ntz=True)
        return StructType([found[c] for c in columns.split(",")]) if columns else found

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_remote(spark: SparkSession, transport: str, columns: list[str] | None = None, **given) -> DataFrame:
    """A remote table as a lazy DataFrame; name the columns that are needed, as a Python source gets no pruning."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteSource)
    reader = spark.read.format(FORMAT).option("transport", transport).option("with", json.dumps(given))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def read_folder(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    return read_remote(spark, "weirflow.sources.remote:FolderTransport", columns, path=path)
