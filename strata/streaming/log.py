"""What a target holds: the log of landed batches, compaction of their files, and removal of what no reader needs.

Each batch is written into a folder of its own and counts from the moment its log entry is there: one file that names the
folder and the source files it took, so what a failed batch left behind is never read and its source files are landed again.
Readers take the folders from the log and list none. Entries are gathered into a snapshot of the log now and then.

Compaction packs small folders into larger ones and says so in a new snapshot; the rows keep the name of their batch,
so a reader that wants certain batches gets them from wherever they are. The old folders stay until ``vacuum``, which
spares those that the previous snapshot names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.sinks import Snapshots, remove

ENTRY = "batch string, folder string, source_file string, n_bytes long"
#: Entries that are gathered into a snapshot, so that what a reader lists stays short.
ENTRIES = 20
#: Rows that a task sorts and writes into a packed file, at most about: rows that compress well are many more in memory than in a file.
PACK_ROWS = 500_000


class BatchLog:
    """The log lies below the target in folders that readers of data skip."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self._snapshots = Snapshots(spark, f"{self.target}/_log/snapshots")
        self._entries = f"{self.target}/_log/entries"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.target}/{folder}")).getLength()

    def rows(self) -> DataFrame:
        """One row for each batch and source file. A batch that took nothing has none."""
        old, names = self._snapshots.read(), self._names(self._entries)
        parts = [] if old is None else [old]
        if names:
            new = self.spark.read.schema(ENTRY).parquet(*(f"{self._entries}/{n}" for n in names))
            parts.append(new if old is None else new.join(old.select("batch").distinct(), "batch", "left_anti").select(*old.columns))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ENTRY)

    def folders(self) -> dict[str, tuple[str, int]]:
        """Where each landed batch is, and how large its folder was when it was written."""
        return {r.batch: (r.folder, r.n_bytes) for r in self.rows().select("batch", "folder", "n_bytes").distinct().collect()}

    def record(self, batch: str, source_files: DataFrame) -> None:
        """The batch's folder, which has the batch's name, is whole. One file makes the entry, so it is there or it isn't."""
        name = f"{self._entries}/{batch}"
        line = source_files.select(F.lit(batch).alias("batch"), F.lit(batch).alias("folder"), "source_file", F.lit(self._size(batch)).cast("long").alias("n_bytes"))
        line.coalesce(1).write.mode("overwrite").parquet(name)
        if len(self._names(self._entries)) >= ENTRIES:
            self._gather(self.rows())

    def _gather(self, rows: DataFrame) -> None:
        names = self._names(self._entries)
        self._snapshots.write(rows)
        for n in names:
            remove(self.spark, f"{self._entries}/{n}")

    def compact(self, read, target_bytes: int = 128 << 20, partition_by: tuple[str, ...] = ("ingest_date",)) -> int:
        """Packs folders below half the target size into new ones of about the target size, oldest first; returns how many were
        packed. ``read(folder names)`` gives their rows with a column ``batch``.
        """
        by_folder: dict[str, int] = {}
        for folder, size in self.folders().values():
            by_folder[folder] = size
        packs: list[list[str]] = []
        room = 0
        for folder, size in sorted(by_folder.items()):
            if 2 * size >= target_bytes:
                continue
            if not packs or size > room:
                packs.append([])
                room = target_bytes
            packs[-1].append(folder)
            room -= size
        moved: dict[str, tuple[str, int]] = {}
        for pack in (p for p in packs if len(p) > 1):
            name = f"pack={uuid.uuid4().hex}"
            rows = read(pack)
            n = max(1, -(-rows.count() // PACK_ROWS), -(-2 * sum(by_folder[f] for f in pack) // target_bytes))
            # Ranges cut a partition that has many rows and leave small ones whole.
            dealt = rows.repartitionByRange(n, *partition_by, F.xxhash64(*(c for c in rows.columns if c not in partition_by and rows.schema[c].dataType.typeName() not in ("map", "variant"))))
            dealt.write.partitionBy(*partition_by).parquet(f"{self.target}/{name}")
            moved |= dict.fromkeys(pack, (name, self._size(name)))
        if moved:
            to = self.spark.createDataFrame([(f, n, size) for f, (n, size) in moved.items()], "folder string, _to string, _size long")
            rows = self.rows().join(to, "folder", "left")
            self._gather(rows.select("batch", F.coalesce("_to", "folder").alias("folder"), "source_file", F.coalesce("_size", "n_bytes").alias("n_bytes")))
        return len(moved)

    def vacuum(self) -> int:
        """Removes folders of failed batches and those that were packed before the last snapshot; returns how many. Not to be called
        while a batch is being written.
        """
        kept = {f for f, _ in self.folders().values()}
        for v in self._snapshots.versions():
            kept |= {r.folder for r in self.spark.read.schema(ENTRY).parquet(f"{self._snapshots.path}/{v}").select("folder").distinct().collect()}
        old = [n for n in self._names(self.target) if n.startswith(("batch=", "pack=")) and n not in kept]
        for n in old:
            remove(self.spark, f"{self.target}/{n}")
        return len(old)
