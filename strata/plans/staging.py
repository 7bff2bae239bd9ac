"""Silver: nested bronze records flattened to typed tables, one function per table; lineage columns pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.dates import parse_date, raw_and_parsed
from strata.functions.text import array_count
from strata.operators.flatten import fields, unnest
from strata.sources.schemas import LINEAGE


def stg_matters(matters: DataFrame) -> DataFrame:
    dates = [c for raw, name in (("introduced", "introduced"), ("on_agenda", "on_agenda"), ("final_action", "final_action")) for c in raw_and_parsed(raw, name)]
    enactment = [F.col("enactment_date").alias("enactment_date_raw"), parse_date("enactment_date").alias("enactment_date")]
    return matters.select(
        F.col("file_number").alias("matter_file"),
        *("detail_url", "name", "title", "type", "status"),
        *dates,
        *enactment,
        *("enactment_number", "in_control", "related_files"),
        array_count("actions").alias("n_actions"),
        array_count("sponsors").alias("n_sponsors"),
        *_lineage(matters),
    )


def _lineage(df: DataFrame) -> list[str]:
    return [c for c in LINEAGE if c in df.columns]


def _of_matters(matters: DataFrame, array: str, item: str, pos: str) -> DataFrame:
    return unnest(matters, array, item, pos, keep=[F.col("file_number").alias("matter_file"), *_lineage(matters)])


def stg_actions(matters: DataFrame) -> DataFrame:
    flat = _of_matters(matters, "actions", "action", "action_seq")
    return flat.select(
        "matter_file",
        "action_seq",
        *raw_and_parsed("action.date", "action"),
        *fields("action", body="body", action_type="action", action_result="result", history_id="history_id", history_url="history_url"),
        array_count("action.votes").alias("n_votes"),
        *_lineage(matters),
    )


def stg_votes(matters: DataFrame) -> DataFrame:
    """The action's position and body are kept; the vote's position isn't."""
    actions = _of_matters(matters, "actions", "action", "action_seq")
    votes = unnest(actions, "action.votes", "vote")
    return votes.select(
        "matter_file",
        "action_seq",
        parse_date("action.date").alias("action_date"),
        F.col("action.history_id").alias("history_id"),
        F.col("action.body").alias("body"),
        *fields("vote", person_id="person_id", person_name="person_name", vote_value_raw="vote_value"),
        *_lineage(matters),
    )


def stg_attachments(matters: DataFrame) -> DataFrame:
    flat = _of_matters(matters, "attachments", "attachment", "attachment_seq")
    return flat.select("matter_file", "attachment_seq", *fields("attachment", attachment_name="name", attachment_url="url"), *_lineage(matters))


def stg_sponsors(matters: DataFrame) -> DataFrame:
    return _of_matters(matters, "sponsors", "sponsor_name", "sponsor_pos").select("matter_file", "sponsor_pos", "sponsor_name", *_lineage(matters))


def stg_meetings(meetings: DataFrame) -> DataFrame:
    return meetings.select(
        *("meeting_id", "event_guid", "body_name"),
        *raw_and_parsed("meeting_date", "meeting"),
        *("meeting_time", "location", "meeting_subtype", "agenda_status", "minutes_status", "agenda_url", "minutes_url", "video_clip_id"),
        array_count("agenda_items").alias("n_agenda_items"),
        array_count("documents").alias("n_documents"),
        *_lineage(meetings),
    )


def stg_agenda_items(meetings: DataFrame) -> DataFrame:
    """The sequence is the element's own, not its position."""
    flat = unnest(meetings, "agenda_items", "item", keep=["meeting_id", parse_date("meeting_date").alias("meeting_date"), *_lineage(meetings)])
    same = ("item_seq", "matter_file", "history_id", "agenda_number", "matter_name", "matter_type")
    rest = ("title", "action_raw", "action_result", "matter_url", "history_url")
    names = {**{n: n for n in same}, "matter_status_at_meeting": "matter_status", **{n: n for n in rest}}
    return flat.select("meeting_id", "meeting_date", *fields("item", **names), *_lineage(meetings))


def stg_meeting_documents(meetings: DataFrame) -> DataFrame:
    flat = unnest(meetings, "documents", "document", "document_seq", keep=["meeting_id", *_lineage(meetings)])
    names = ("document_source", "document_title", "document_url", "body_text")
    return flat.select("meeting_id", "document_seq", *fields("document", **{n: n for n in names}), *_lineage(meetings))


SILVER = {
    "stg_matters": ("matters", stg_matters),
    "stg_actions": ("matters", stg_actions),
    "stg_votes": ("matters", stg_votes),
    "stg_attachments": ("matters", stg_attachments),
    "stg_sponsors": ("matters", stg_sponsors),
    "stg_meetings": ("meetings", stg_meetings),
    "stg_agenda_items": ("meetings", stg_agenda_items),
    "stg_meeting_documents": ("meetings", stg_meeting_documents),
}
