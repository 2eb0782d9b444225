"""Table listings with sizes: Spark's own catalog, folders, and the REST and Glue forms of a table catalog.

The network side of the last two is a callable that the user gives, so that nothing here depends on a client.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..session import TableRef


class Catalog(Protocol):
    def tables(self) -> Iterator[tuple[TableRef, int | None]]:
        """Each table with its size in bytes, None where it isn't known."""


class FolderCatalog:
    """database/schema as given; each Parquet file or folder in a path is a table. Sizes come from the file system."""

    def __init__(self, spark: SparkSession, path: str, database: str = "LAKE", schema: str = "PUBLIC"):
        self.spark, self.path, self.database, self.schema = spark, path, database, schema

    def tables(self) -> Iterator[tuple[TableRef, int | None]]:
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(jpath):
            name = s.getPath().getName()
            if name.endswith(".parquet"):
                yield TableRef(self.database, self.schema, name.removesuffix(".parquet")), fs.getContentSummary(s.getPath()).getLength()


class SparkCatalog:
    """Databases and tables of the session's catalog; sizes where statistics were computed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def tables(self) -> Iterator[tuple[TableRef, int | None]]:
        for db in self.spark.catalog.listDatabases():
            for t in self.spark.catalog.listTables(db.name):
                if not t.isTemporary:
                    told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED `{db.name}`.`{t.name}`").collect()}
                    size = told.get("Statistics", "").split(" ")[0]
                    yield TableRef(self.spark.catalog.currentCatalog(), db.name, t.name), int(size) if size.isdigit() else None


class RestCatalog:
    """Iceberg's REST catalog: namespaces, their tables, and sizes from the current snapshot's summary.

    `get(path)` returns the decoded JSON of a GET; pages are followed by their token.
    """

    def __init__(self, get: Callable[[str], dict], database: str, prefix: str = "v1"):
        self.get, self.database, self.prefix = get, database, prefix

    def _pages(self, path: str, key: str) -> Iterator:
        token = None
        while True:
            page = self.get(f"{self.prefix}/{path}" + (f"?pageToken={token}" if token else ""))
            yield from page.get(key, [])
            token = page.get("next-page-token")
            if not token:
                return

    def tables(self) -> Iterator[tuple[TableRef, int | None]]:
        for space in self._pages("namespaces", "namespaces"):
            name = "\x1f".join(space)
            for t in self._pages(f"namespaces/{name}/tables", "identifiers"):
                meta = self.get(f"{self.prefix}/namespaces/{name}/tables/{t['name']}").get("metadata", {})
                now = next((s for s in meta.get("snapshots", []) if s.get("snapshot-id") == meta.get("current-snapshot-id")), {})
                size = now.get("summary", {}).get("total-files-size")
                yield TableRef(self.database, ".".join(space), t["name"]), int(size) if size is not None else None


class GlueCatalog:
    """Glue: `call(operation, arguments)` returns the decoded response; only Iceberg tables are listed."""

    def __init__(self, call: Callable[[str, dict], dict], database: str):
        self.call, self.database = call, database

    def _pages(self, operation: str, key: str, **given) -> Iterator[dict]:
        while True:
            page = self.call(operation, given)
            yield from page.get(key, [])
            if not page.get("NextToken"):
                return
            given = given | {"NextToken": page["NextToken"]}

    def tables(self) -> Iterator[tuple[TableRef, int | None]]:
        for db in self._pages("GetDatabases", "DatabaseList"):
            for t in self._pages("GetTables", "TableList", DatabaseName=db["Name"]):
                told = t.get("Parameters", {})
                if told.get("table_type", "").upper() == "ICEBERG":
                    size = told.get("totalSize") or told.get("total_size")
                    yield TableRef(self.database, db["Name"], t["Name"]), int(size) if size else None


class CachedListing:
    """A catalog's tables for a while; when it can't be reached, the last that were seen, marked stale."""

    def __init__(self, catalog: Catalog, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.catalog, self.seconds, self.clock = catalog, seconds, clock
        self.seen: dict[TableRef, int | None] = {}
        self.until, self.stale, self.error = float("-inf"), False, None

    def tables(self) -> dict[TableRef, int | None]:
        if self.clock() >= self.until:
            try:
                self.seen, self.stale, self.error = dict(self.catalog.tables()), False, None
            except Exception as e:  # whatever the network side raises
                self.stale, self.error = True, e
            self.until = self.clock() + self.seconds
        return self.seen

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.database, t.schema, t.name, size) for t, size in self.tables().items()]
        return spark.createDataFrame(rows, "database string, schema string, name string, bytes long")
