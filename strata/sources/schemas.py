"""Record schemas of the nested sources and the registry of named datasets. Every field is nullable; dates come as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VOTE = "struct<person_id string, person_name string, vote_value string>"
ACTION = f"struct<date string, body string, action string, result string, history_id string, history_url string, votes array<{VOTE}>>"
ATTACHMENT = "struct<name string, url string>"
MATTER = f"""
  file_number string, detail_url string, name string, title string, type string, status string, introduced string,
  on_agenda string, final_action string, enactment_date string, enactment_number string, in_control string, full_text string,
  sponsors array<string>, related_files array<string>, attachments array<{ATTACHMENT}>, actions array<{ACTION}>
"""
AGENDA_ITEM = """struct<item_seq bigint, matter_file string, matter_url string, agenda_number string, matter_name string,
  matter_type string, matter_status string, title string, action_raw string, action_result string, history_id string, history_url string>"""
MEETING_DOCUMENT = "struct<document_source string, document_title string, document_url string, body_text string>"
MEETING = f"""
  meeting_id string, event_guid string, body_name string, meeting_date string, meeting_time string, location string,
  meeting_subtype string, agenda_status string, minutes_status string, agenda_url string, minutes_url string, video_clip_id string,
  documents array<{MEETING_DOCUMENT}>, agenda_items array<{AGENDA_ITEM}>
"""
LINEAGE = ("source_file", "ingest_date", "loaded_at")
CORRUPT = "_corrupt_record"


def schema(ddl: str, corrupt: bool = False) -> T.StructType:
    out = T.StructType.fromDDL(" ".join(ddl.split()))
    return out.add(CORRUPT, "string") if corrupt else out


@dataclass(frozen=True)
class Dataset:
    """A declared source table: where it lies, in which format, under which schema."""

    name: str
    path: str
    ddl: str | None = None
    format: str = "parquet"

    def read(self, spark: SparkSession, root: str = "") -> DataFrame:
        reader = spark.read.format(self.format)
        if self.ddl:
            reader = reader.schema(schema(self.ddl))
        return reader.load(f"{root.rstrip('/')}/{self.path}" if root else self.path)


class Registry:
    """Named datasets; ``source(name)`` instead of paths in transforms."""

    def __init__(self, *datasets: Dataset):
        self.datasets = {d.name: d for d in datasets}

    def source(self, spark: SparkSession, name: str, root: str = "") -> DataFrame:
        if name not in self.datasets:
            raise KeyError(f"no dataset named {name!r}; declared: {', '.join(sorted(self.datasets))}")
        return self.datasets[name].read(spark, root)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TABLES = Registry(*(Dataset(t, f"{t}.parquet") for t in _TABLES.split()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TABLES.source(spark, name, sf_dir)
