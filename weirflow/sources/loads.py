"""Loading files into a lake table with a history: a file is loaded once, and a bad one stops no other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import LakeTable

HISTORY = "file_name string, status string, rows_parsed long, rows_inserted long, errors_seen long, first_error string, request_id string, loaded_at timestamp"


class Pipe:
    """Files of one schema into `target`; `history` keeps a row for each file and request."""

    def __init__(self, spark: SparkSession, target: LakeTable, history: LakeTable, schema: str, fmt: str = "parquet"):
        self.spark, self.target, self.history, self.schema, self.fmt = spark, target, history, schema, fmt

    def load_history(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of the history, from `start` and before `end`."""
        rows = self.history.read() if self.history.exists() else self.spark.createDataFrame([], HISTORY)
        if start:
            rows = rows.where(F.col("loaded_at") >= F.to_timestamp(F.lit(start)))
        return rows.where(F.col("loaded_at") < F.to_timestamp(F.lit(end))) if end else rows

    def _parsed(self, path: str) -> DataFrame:
        reader = self.spark.read
        found = (reader if self.fmt == "parquet" else reader.schema(self.schema).option("mode", "FAILFAST")).format(self.fmt).load(path)
        return found.to(self.spark.createDataFrame([], self.schema).schema)

    def insert_files(self, paths: list[str]) -> str:
        """Load files that haven't been loaded yet; returns the id of the request.

        Data and history are two tables: the data go first, and each row names its file, so that a request
        that is repeated after a crash between the two finds what is there.
        """
        request = uuid.uuid4().hex
        here = self.target.read() if self.target.exists() else None
        there = set() if here is None else {r[0] for r in here.select("_file").distinct().collect()}
        rows, new = [], []
        for path in dict.fromkeys(paths):
            if path in there:
                rows.append((path, "ALREADY_LOADED", 0, 0, 0, None))
                continue
            try:
                part = self._parsed(path)
                n = part.count()
                new.append(part.withColumn("_file", F.lit(path)))
                rows.append((path, "LOADED", n, n, 0, None))
            except Exception as e:  # whatever Spark's readers raise on a file that is missing or malformed
                rows.append((path, "LOAD_FAILED", 0, 0, 1, str(e).splitlines()[0][:500]))
        if new:
            every = here if here is not None else new.pop(0)
            for part in new:
                every = every.unionByName(part)
            self.target.write(every)
        made = self.spark.createDataFrame(rows, "file_name string, status string, rows_parsed long, rows_inserted long, errors_seen long, first_error string")
        made = made.withColumn("request_id", F.lit(request)).withColumn("loaded_at", F.current_timestamp())
        self.history.write(self.load_history().unionByName(made))
        return request
