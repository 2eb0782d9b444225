"""Spark sessions and table registration."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Settings the engine's semantics rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def make_session(name: str = "weirflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. Only a local master does without."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        sc.setCheckpointDir(place)
    return place


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM exits."""
    path = f"{shared_dir(spark)}/weirflow/{label}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath.getParent())
    fs.deleteOnExit(jpath)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its plan is cut, a lost executor costs only
    its tasks, and filters and columns still reach the scan."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class TableRef:
    """database.schema.name; equality is case-sensitive."""

    database: str
    schema: str
    name: str

    @property
    def fqn(self) -> str:
        return f"{self.database}.{self.schema}.{self.name}"


def parse_dotted(text: str, database: str | None = None, schema: str | None = None) -> TableRef | None:
    """1 to 3 parts, the missing ones from the defaults; None when empty, too long or without a default."""
    parts = [p.strip().strip('"`') for p in text.split(".")]
    if not all(parts) or len(parts) > 3:
        return None
    full = ([database, schema] + parts)[-3:] if len(parts) == 1 else ([database] + parts)[-3:] if len(parts) == 2 else parts
    return TableRef(*full) if all(full) else None


@dataclass
class Session:
    """Who asks, and the defaults for unqualified names."""

    role: str = "PUBLIC"
    user: str = "anonymous"
    roles: tuple[str, ...] = ()
    database: str | None = "ANALYTICS"
    schema: str | None = "PUBLIC"
    tags: dict[str, str] = field(default_factory=dict)

    def resolve(self, text: str) -> TableRef | None:
        return parse_dotted(text, self.database, self.schema)


#: Schemas of tables read before, by path, time of change and length: Spark would read a footer, in a job of its
#: own, each time a table is named.
_schemas: dict[tuple, StructType] = {}
_SCHEMAS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = str(PurePosixPath(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        if len(_schemas) >= _SCHEMAS:
            _schemas.clear()
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views over lake tables; nothing is read until a query asks for it."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
