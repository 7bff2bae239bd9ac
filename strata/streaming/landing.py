"""Incremental landing of nested files: a file stream that drains what is new and appends it once, whatever is replayed."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.sources.drift import REST, with_rest
from strata.sources.ingest import is_broken, lineage, split_broken
from strata.sources.schemas import CORRUPT, schema

from .log import BatchLog

SALTS = 16


@dataclass
class Landed:
    rows: int = 0
    quarantined: int = 0
    batches: int = 0


def land(spark: SparkSession, source: str, ddl: str, key: str, target: str, checkpoint: str, files_per_batch: int = 10_000, quarantine: str | None = None, multi_line: bool = True, keep_rest: bool = False, pattern: str = "[!_]*.json") -> Landed:
    """Appends the records of files not seen before to ``target``, by ingest_date, and stops when none is left.

    A batch writes below a folder of its own, named by the query (which the checkpoint identifies) and its number, and then enters its
    files in the target's log. A batch that is run again after a failure overwrites its folder, so it lands once; one that
    never came to its end isn't in the log, so whoever finds its files next lands them. A new checkpoint is a new
    query: files that the log has from other queries are left out. Broken records go to ``quarantine`` if that is given,
    else they are only counted. A batch is parsed once, and once more only where broken records are to be kept.
    With ``keep_rest``, fields that ``ddl`` doesn't declare and values that its types can't hold are landed too, in ``_rest`` (``drift``);
    a file is then one record, so one with an array on top is broken.
    """
    out = Landed()
    log = BatchLog(spark, target)
    query_id: list[str] = []
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
    # Lineage is stamped on the stream itself, where the file's metadata is at hand.
    if keep_rest:
        stream = with_rest(lineage(reader.text(source, wholetext=multi_line)), ddl)
    else:
        stream = lineage(reader.schema(schema(ddl, corrupt=True)).option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(source))

    def batch(df: DataFrame, batch_id: int) -> None:
        if not query_id:
            query_id.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        name = f"batch={query_id[0]}-{batch_id}"
        others = log.rows().where(~F.col("batch").startswith(f"batch={query_id[0]}-") & F.col("source_file").isNotNull())
        # Salted, so that the rows of one large file aren't one task.
        others = others.select("source_file").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(others, ["source_file", "_salt"], "left_anti").select(*df.columns)
        seen = Observation()  # counts come from the write itself
        counted = df.observe(seen, F.count_if(~is_broken(key)).alias("good"), F.count_if(is_broken(key)).alias("broken"))
        split_broken(counted, key)[0].write.mode("overwrite").partitionBy("ingest_date").parquet(f"{target}/{name}")
        files = spark.read.schema("source_file string").parquet(f"{target}/{name}").select("source_file")
        if quarantine and seen.get["broken"]:
            split_broken(df, key)[1].drop(REST).write.mode("overwrite").json(f"{quarantine}/{name}")
            files = files.unionByName(spark.read.schema("source_file string").json(f"{quarantine}/{name}"))
        log.record(name, files.distinct())
        out.rows += seen.get["good"]
        out.quarantined += seen.get["broken"]
        out.batches += 1

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def batches(spark: SparkSession, target: str) -> list[str]:
    """The names of the batches that are written whole."""
    return sorted(BatchLog(spark, target).folders())


def landed(spark: SparkSession, target: str, ddl: str, only: list[str] | None = None) -> DataFrame:
    """The landed table, or only the named batches of it: records with lineage, without the batch column."""
    where = BatchLog(spark, target).folders()
    wanted = where if only is None else {b: where[b] for b in only if b in where}
    rows = _folders(spark, target, ddl, sorted({folder for folder, _ in wanted.values()}))
    # A packed folder may hold other batches too.
    return (rows if only is None else rows.where(F.col("batch").isin([b.removeprefix("batch=") for b in wanted]))).drop("batch")


def _folders(spark: SparkSession, target: str, ddl: str, folders: list[str]) -> DataFrame:
    """Rows of these folders with the batch they came in."""
    full = schema(ddl).add("source_file", "string").add("loaded_at", "timestamp").add("ingest_date", "date").add("batch", "string")
    # The name of a batch is a partition of its own folder, and a column of a packed one.
    reader = lambda names: spark.read.schema(full).option("basePath", target).parquet(*(f"{target}/{n}" for n in names)).select(*(f"`{c}`" for c in full.names))
    kinds = [[f for f in folders if f.startswith(kind)] for kind in ("batch=", "pack=")]
    parts = [reader(names) for names in kinds if names]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], full)


def compact(spark: SparkSession, target: str, ddl: str, target_bytes: int = 128 << 20) -> int:
    """Packs small batches of a landed table into larger files; returns how many folders were packed. Readers see the same rows."""
    return BatchLog(spark, target).compact(lambda names: _folders(spark, target, ddl, names), target_bytes)


def land_all(spark: SparkSession, streams: dict[str, dict]) -> dict[str, Landed]:
    """Several independent streams, one after the other."""
    return {name: land(spark, **settings) for name, settings in streams.items()}
