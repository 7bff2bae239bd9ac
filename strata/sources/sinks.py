"""Writing tables: partitioned overwrite, managed tables and views, layer folders, entity files, payloads, replays."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared space that the cluster names. Without one, a local session gets one in the temporary space; on a
    cluster that would be another folder on every machine, so it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or f"file://{tempfile.gettempdir()}/spark-strata"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying: dict[str, int] = {}
_lock = threading.Lock()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes in here remove their shuffle files as they end. Else these stay until the driver's garbage is collected, so a run
    of many writes would hold the shuffles of all of them at once.
    """
    conf = spark.conf
    with _lock:
        if not _tidying.get("n"):
            _tidying["was"] = conf.get(_CLEANUP, "false")
            conf.set(_CLEANUP, "true")
        _tidying["n"] = _tidying.get("n", 0) + 1
    try:
        yield
    finally:
        with _lock:
            _tidying["n"] -= 1
            if not _tidying["n"]:
                conf.set(_CLEANUP, _tidying["was"])


def stored(df: DataFrame, path: str) -> DataFrame:
    """Written and read back: computed once, whoever reads it, and safe from lost executors."""
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder with all that is in it; a missing one is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Layers:
    """Layer names as databases, each exactly as named; ``prefix`` keeps runs apart."""

    def __init__(self, spark: SparkSession, prefix: str = ""):
        self.spark, self.prefix = spark, prefix

    def database(self, layer: str) -> str:
        name = f"{self.prefix}{layer}"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
        return name

    def table(self, layer: str, name: str) -> str:
        return f"{self.database(layer)}.{name}"

    def materialise(self, df: DataFrame, layer: str, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """CREATE OR REPLACE TABLE ... AS."""
        writer = df.write.mode("overwrite").format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with tidy(self.spark):
            writer.saveAsTable(self.table(layer, name))
        return self.spark.table(self.table(layer, name))

    def reset(self, *layers: str) -> None:
        """Drop the layers with all their tables, for a full replay."""
        for layer in layers:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.prefix}{layer} CASCADE")

    def inspect(self, layer: str) -> list[tuple[str, int]]:
        name = self.database(layer)
        return [(t.name, self.spark.table(f"{name}.{t.name}").count()) for t in self.spark.catalog.listTables(name)]


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def overwrite(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), whole: bool = False) -> None:
    """Replaces the partitions that ``df`` has, or with ``whole`` everything under the path."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.parquet(path)


def entity_files(df: DataFrame, path: str, key: str, partition_by: str = "ingest_date") -> None:
    """JSON records in partition folders, appended; records without key aren't written."""
    df.where(F.col(key).isNotNull()).write.mode("append").partitionBy(partition_by).json(path)


def payload(df: DataFrame, items: str, **header: Column) -> DataFrame:
    """One row, one JSON document: the header's values and all rows as an array. For serving tables of bounded size only."""
    whole = F.struct(*(v.alias(k) for k, v in header.items()), F.array_sort(F.collect_list(F.struct(*df.columns))).alias(items))
    return df.agg(F.to_json(whole).alias("payload"))


class Snapshots:
    """A parquet table as version folders and a pointer: readers see the old version until the new one is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[str]:
        """Whole versions, oldest first: those with a success mark."""
        root = self._hadoop(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(self._hadoop(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def write(self, df: DataFrame, keep: int = 2) -> DataFrame:
        """The highest version with a success mark is the current one; older ones than ``keep`` are removed."""
        found = self.versions()
        number = int(found[-1][1:9]) + 1 if found else 1
        name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        for old in found[: -(keep - 1) or None] if len(found) >= keep else []:
            self._fs.delete(self._hadoop(f"{self.path}/{old}"), True)
        return self.spark.read.parquet(f"{self.path}/{name}")
