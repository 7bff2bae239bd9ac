"""Reading nested JSON: one document per file, an explicit schema, lineage columns, and a stated policy on drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import CORRUPT, schema

INGEST_DATE = r"ingest_date=(\d{4}-\d{2}-\d{2})"


def lineage(df: DataFrame) -> DataFrame:
    """source_file, ingest_date (from the path; null if the path has none) and loaded_at."""
    path = F.col("_metadata.file_path")
    date = F.nullif(F.regexp_extract(path, INGEST_DATE, 1), F.lit(""))
    return df.select("*", path.alias("source_file"), F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date").alias("ingest_date"), F.current_timestamp().alias("loaded_at"))


def read_documents(spark: SparkSession, path: str, ddl: str, pattern: str = "*.json", multi_line: bool = True) -> DataFrame:
    """One row per file (with ``multi_line`` off, per line) below ``path`` (partition folders included). Files whose name starts with '_' aren't records; a
    file that doesn't parse is a row with its text in ``_corrupt_record``.
    """
    reader = spark.read.schema(_without_partition(schema(ddl, corrupt=True))).option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT)
    return lineage(reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path))


def _without_partition(s: T.StructType) -> T.StructType:
    return T.StructType([f for f in s.fields if f.name != "ingest_date"])


def is_broken(key: str) -> Column:
    return F.col(CORRUPT).isNotNull() | F.col(key).isNull()


def split_broken(records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(good records without the corrupt column, quarantined rows)."""
    return records.where(~is_broken(key)).drop(CORRUPT), records.where(is_broken(key))


def apply_drift_policy(records: DataFrame, key: str, on_drift: str = "skip") -> DataFrame:
    """'skip' leaves broken records out, 'fail' raises when one is met while the result is computed."""
    if on_drift == "skip":
        return split_broken(records, key)[0]
    if on_drift != "fail":
        raise ValueError(f"on_drift is 'skip' or 'fail', not {on_drift!r}")
    message = F.concat(F.lit("record doesn't match its schema: "), F.col("source_file"))
    return records.where(F.when(is_broken(key), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop(CORRUPT)


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages: page_id, url, html."""
    return spark.read.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parquet")
