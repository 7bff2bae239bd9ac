"""Tables in hash buckets that change in place: only the buckets that hold a changed key are written anew.

A ``BucketStore`` is a folder with several tables. Each row lies in the bucket that its table's key columns hash to, and
each bucket in a folder of its own; the manifest says which folder holds which bucket of which table now. A change
writes new folders and touches none that a reader may have open; ``commit`` writes one manifest for all tables, so readers
see all changes of a run or none, and a run that fails before leaves the store as it was. ``vacuum`` removes folders
that no kept manifest names.

The driver handles the manifest (a row for each bucket) and the numbers of touched buckets, never rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import Snapshots, remove, tidy

_MANIFEST = "kind string, name string, bucket int, value string"


def meeting(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on all columns of ``keys``; null equals null. Merged, since keys may be as many as rows, and small in their files."""
    renamed = keys.select(*(F.col(c).alias(f"_k_{c}") for c in keys.columns)).hint("merge")
    return rows.join(renamed, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys.columns)), how)


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """``buckets`` holds for tables made from now on; a table keeps the number it was made with."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._manifests = Snapshots(spark, f"{self.path}/manifests")
        self.reload()

    def reload(self) -> None:
        """Back to what was committed last."""
        found = self._manifests.read()
        rows = found.collect() if found is not None else []
        self._folders: dict[str, dict[int, str]] = {}
        self._tables: dict[str, tuple[list[str], int, T.StructType]] = {}
        self.notes: dict[str, list[str]] = {}
        for r in rows:
            if r.kind == "table":
                by, schema = r.value.split("\n", 1)
                self._tables[r.name] = (by.split(","), r.bucket, T.StructType.fromDDL(schema))
            elif r.kind == "bucket":
                self._folders.setdefault(r.name, {})[r.bucket] = r.value
            else:
                self.notes.setdefault(r.name, []).append(r.value)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def create(self, name: str, by: list[str], schema: T.StructType) -> None:
        if name not in self:
            # Columns stay nullable whatever the first frame promised.
            self._tables[name] = (by, self.buckets, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))

    def folders(self, name: str) -> dict[int, str]:
        """Where each bucket that has rows lies, relative to the table."""
        return dict(self._folders.get(name, {}))

    def read(self, name: str, only: list[int] | None = None) -> DataFrame:
        _, _, schema = self._tables[name]
        paths = [f"{self.path}/{name}/{folder}/_bucket={b}" for b, folder in sorted(self._folders.get(name, {}).items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str) -> Column:
        by, n, _ = self._tables[name]
        return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that the key columns of some rows fall into."""
        return sorted(r[0] for r in keys.select(self._bucket(name)).distinct().collect())

    def matching(self, name: str, keys: DataFrame, touched: list[int] | None = None) -> DataFrame:
        """Rows that agree with one of ``keys`` in all its columns, which include those the table is bucketed by. Here and below,
        who knows the touched buckets already can say so.
        """
        return meeting(self.read(name, self.touched(name, keys) if touched is None else touched), keys, "left_semi")

    def replace(self, name: str, gone: DataFrame, rows: DataFrame, touched: list[int] | None = None) -> None:
        """Without the rows that agree with one of ``gone`` in all its columns, and with ``rows``."""
        columns = self._tables[name][2].names
        rows = rows.select(*columns)
        by = self._tables[name][0]
        if touched is None:
            touched = self.touched(name, gone.select(*by).unionByName(rows.select(*by)))
        self._write(name, touched, meeting(self.read(name, touched), gone, "left_anti").unionByName(rows))

    def add(self, name: str, changes: DataFrame, touched: list[int] | None = None) -> None:
        """Counted rows: those equal in all columns but ``n`` are summed, and what sums to nothing goes."""
        schema = self._tables[name][2]
        columns = [c for c in schema.names if c != "n"]
        changes = changes.select(*schema.names)
        touched = self.touched(name, changes) if touched is None else touched
        merged = self.read(name, touched).unionByName(changes).groupBy(*columns).agg(F.sum("n").alias("n")).where("n > 0")
        self._write(name, touched, merged.select(*schema.names))

    def _write(self, name: str, touched: list[int], rows: DataFrame) -> None:
        if not touched:
            return
        folder = uuid.uuid4().hex
        at = f"{self.path}/{name}/{folder}"
        # Small buckets share a task and a large one is split, each by its measured size.
        with tidy(self.spark):
            rows.withColumn("_bucket", self._bucket(name)).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(at)
        here = self._folders.setdefault(name, {})
        for b in touched:
            here.pop(b, None)
        for sub in self._names(at):
            if sub.startswith("_bucket="):
                here[int(sub.removeprefix("_bucket="))] = folder

    def _names(self, path: str) -> list[str]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def commit(self, **notes: list[str]) -> None:
        """All changes since the last commit, with lists of notes that are kept beside them."""
        self.notes.update(notes)
        rows = [("table", n, many, ",".join(by) + "\n" + schema.toDDL()) for n, (by, many, schema) in self._tables.items()]
        rows += [("bucket", n, b, f) for n, found in self._folders.items() for b, f in found.items()]
        rows += [("note", n, None, v) for n, values in self.notes.items() for v in values]
        self._manifests.write(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1))

    def vacuum(self) -> int:
        """Removes folders named by none of the manifests that are kept (the current one and the one before, whose readers may
        still be at work); returns how many. Not to be called while a change is under way.
        """
        kept = {(r.name, r.value) for v in self._manifests.versions() for r in self.spark.read.parquet(f"{self._manifests.path}/{v}").where("kind = 'bucket'").collect()}
        old = [(n, f) for n in self._tables for f in self._names(f"{self.path}/{n}") if (n, f) not in kept]
        for n, f in old:
            remove(self.spark, f"{self.path}/{n}/{f}")
        return len(old)
