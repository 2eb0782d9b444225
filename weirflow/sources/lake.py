"""Versioned Parquet tables: a version is written whole, then published by a numbered pointer file.

Pointers are never changed or replaced. Readers take the one with the greatest number, so a writer that
dies at any step leaves the last published version as it was; what it wrote is unreferenced and goes with
`vacuum`. Of two writers that started from one version, the second to publish fails.

A version is a set of parts. `write` makes one; `write_parts` replaces some of the parts of a table that is
divided by a column of small integers and keeps the others, so that a small change rewrites little.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class WriteConflict(RuntimeError):
    """Another writer has published since this one read the table."""


class LakeTable:
    """One table under a folder that all executors share. Readers see a version or the next, never a mix."""

    #: Published versions that stay for readers that still hold them, the last included.
    KEEP = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at(self.path).getFileSystem(self.conf)

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def pointers(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names(f"{self.path}/_pointers") if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def state(self, number: int | None = None) -> dict | None:
        """{number, batch, parts}: of a published version, or the last; None before the first."""
        number = number if number is not None else max(self.pointers(), default=None)
        if number is None:
            return None
        f = self.fs.open(self._at(f"{self.path}/_pointers/{number:012d}.json"))
        try:
            return json.loads(bytes(f.readAllBytes())) | {"number": number}
        finally:
            f.close()

    def exists(self) -> bool:
        return bool(self.pointers())

    @property
    def last_batch(self) -> int:
        return (self.state() or {}).get("batch", -1)

    def read(self, parts: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
        """The last version, or an earlier one by number; of a divided table only the given parts."""
        state = self.state(number)
        if state is None:
            raise FileNotFoundError(self.path)
        wanted = None if parts is None else {str(p) for p in parts}
        paths = [f"{self.path}/{d}" for p, d in state["parts"].items() if wanted is None or p in wanted]
        schema = self.spark.read.parquet(f"{self.path}/{state['shape']}").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, batch: int = -1) -> None:
        """Replace the whole table."""
        old, version = self.state(), self._version()
        df.write.parquet(f"{self.path}/{version}")
        self._publish(old, {"batch": batch, "parts": {"0": version}, "shape": version})

    def write_parts(self, df: DataFrame, by: str, touched: Iterable[int], batch: int = -1) -> None:
        """Replace the touched parts by the rows of df with those values of `by`; the other parts stay.

        New columns are null in parts that stay.
        """
        old, version = self.state(), self._version()
        df.write.partitionBy(by).parquet(f"{self.path}/{version}")
        made = {m[1] for n in self._names(f"{self.path}/{version}") if (m := re.fullmatch(rf"{re.escape(by)}=(\d+)", n))}
        parts = {p: d for p, d in (old or {"parts": {}})["parts"].items() if p not in {str(t) for t in touched}}
        # the files lack the column that divides them; one empty file has the shape without it
        df.drop(by).limit(0).coalesce(1).write.parquet(f"{self.path}/{version}-shape")
        parts |= {p: f"{version}/{by}={p}" for p in made}
        self._publish(old, {"batch": batch, "parts": parts, "shape": f"{version}-shape"})

    def _version(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def _publish(self, old: dict | None, state: dict) -> None:
        number = old["number"] + 1 if old else 0
        tmp = self._at(f"{self.path}/_pointers/.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._rename(tmp, self._at(f"{self.path}/_pointers/{number:012d}.json"))
        self._forget(number)

    def _rename(self, tmp, final) -> None:
        """Fails if the target exists, which a plain rename doesn't on every file system."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(tmp), context.makeQualified(final), none)
        except Exception as e:
            if self.fs.exists(final):
                self.fs.delete(tmp, False)
                raise WriteConflict(self.path) from e
            raise

    def _forget(self, number: int) -> None:
        """Pointers before the ones to keep go, and then the folders that only they name."""
        for old in self.pointers():
            if old <= number - self.KEEP:
                self.fs.delete(self._at(f"{self.path}/_pointers/{old:012d}.json"), False)
        self.vacuum(older_than_s=24 * 3600)

    def vacuum(self, older_than_s: float = 24 * 3600) -> int:
        """Delete what no kept pointer names; younger folders may belong to a writer that hasn't published."""
        held = set()
        for n in self.pointers():
            s = self.state(n)
            held |= {d.split("/")[0] for d in [*s["parts"].values(), s["shape"]]}
        limit = self.jvm.System.currentTimeMillis() - 1000 * older_than_s
        gone = [s.getPath() for s in self.fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in held and s.getModificationTime() <= limit]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)
