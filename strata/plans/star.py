"""Latest captures and the gold star built from them. ``compat`` keeps the source system's odd choices where ours differ.

Tables as large as the entities are joined by merging: their columns repeat themselves, so their files say little of what a broadcast would hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.codes import disposition, first_is, lifecycle
from strata.functions.keys import coalesced_key, sk, url_id
from strata.operators.latest import conform, dedup_by_key, keep_latest_children, latest_wins, lowest_parent
from strata.operators.quality import merged, report

from .staging import SILVER

Tables = dict[str, DataFrame]
#: Where a person's key comes from, and how the key of one without id begins.
FROM_VOTES, FROM_SPONSORS, NAME_KEY = "vote", "sponsor_only", "NAME:"
#: Entities with their key and the tables of their child rows.
RECORD_KEYS = {"matters": "file_number", "meetings": "meeting_id"}
ENTITIES = (("matters", "matter_file", ("actions", "votes", "sponsors", "attachments")), ("meetings", "meeting_id", ("agenda_items", "meeting_documents")))


def latest_captures(silver: Tables, store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Tables:
    """int_*: the latest capture of each matter and meeting, and the child rows of exactly those captures.

    ``store(name, df)`` may write a table and return it as read back; the entities are stored before their children join them.
    """
    out: Tables = {}
    for entity, key, children in ENTITIES:
        entities = out[f"int_{entity}"] = store(f"int_{entity}", latest_wins(silver[f"stg_{entity}"], [key]))
        for child in children:
            out[f"int_{child}"] = store(f"int_{child}", keep_latest_children(silver[f"stg_{child}"], entities, [key]))
    return out


def latest_records(bronze: Tables, before: Tables | None = None, store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Tables:
    """The latest record of each matter and meeting, whole as it was captured, of new records and of the latest so far (``before``).

    All tables that are flattened from these are those of the latest captures (``of_records``), so that no child table has to meet
    its entities again: records are shuffled once instead of each of their tables.
    """
    rows = {zone: before[zone].unionByName(df) if before else df for zone, df in bronze.items()}
    return {zone: store(zone, latest_wins(df, [RECORD_KEYS[zone]])) for zone, df in rows.items()}


def of_records(records: Tables) -> Tables:
    """int_*: the tables of records that are the latest already."""
    return {f"int_{name.removeprefix('stg_')}": build(records[source]) for name, (source, build) in SILVER.items()}


def advance(latest: Tables, silver: Tables, store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Tables:
    """The latest captures after further silver rows. Whether a capture wins depends on the winner so far and the new ones only, so no
    older silver is read; late captures that lose change nothing. An empty ``latest`` starts from the rows alone.
    """
    rows = {name: latest[f"int_{name[4:]}"].unionByName(df) if latest else df for name, df in silver.items()}
    return latest_captures(rows, store)


def int_history_to_meeting(agenda_items: DataFrame) -> DataFrame:
    """One meeting per history id, the lowest id as text, so a link can't multiply rows."""
    return lowest_parent(agenda_items, "history_id", "meeting_id").select("history_id", sk("meeting_id").alias("meeting_sk"))


def dim_matter(matters: DataFrame, actions: DataFrame, compat: bool = False) -> DataFrame:
    in_committee = F.lower("body").contains("committee")
    milestone = actions.where(in_committee).groupBy("matter_file").agg(F.min("action_date").alias("first_committee_date"))
    m = matters.withColumn("final_disposition", disposition("status")).join(milestone.hint("merge"), "matter_file", "left")
    return m.select(
        sk("matter_file").alias("matter_sk"),
        "matter_file",
        url_id("detail_url", compat=compat).alias("matter_id"),
        F.col("name").alias("matter_name"),
        F.col("type").alias("matter_type"),
        F.col("title").alias("matter_title"),
        "in_control",
        "status",
        lifecycle("final_disposition").alias("lifecycle"),
        *("final_disposition", "introduced_date", "first_committee_date", "final_action_date", "enactment_date", "enactment_number"),
    )


def distinct_names(*columns: tuple[DataFrame, str]) -> DataFrame:
    """name: the different non-null values of several tables' columns."""
    return reduce(DataFrame.union, (df.select(F.col(c).alias("name")) for df, c in columns)).where("name IS NOT NULL").distinct()


def dim_committee(actions: DataFrame, meetings: DataFrame, matters: DataFrame) -> DataFrame:
    names = distinct_names((actions, "body"), (meetings, "body_name"), (matters, "in_control"))
    return names.select(sk("name").alias("committee_sk"), F.col("name").alias("committee_name"))


def identified(people: DataFrame, id_col: str, name: str, compat: bool = False) -> DataFrame:
    """key, id, name, id_source of those with an id. An id has one row: its latest name by action_date where the table has one, else
    the greatest name. In compat mode it has a row for each name.
    """
    known = people.where(F.col(id_col).isNotNull()).select(id_col, F.col(name).alias("full_name"), *[c for c in ("action_date",) if c in people.columns])
    order = [F.col("action_date").desc_nulls_last()] if "action_date" in known.columns else []
    one = known.select(id_col, "full_name").distinct() if compat else dedup_by_key(known, [id_col], [*order, F.col("full_name").desc_nulls_last()])
    return one.select(sk(id_col).alias("person_sk"), id_col, "full_name", F.lit(FROM_VOTES).alias("id_source"))


def named_only(names: DataFrame, id_col: str) -> DataFrame:
    """The same columns for different names (full_name) that nobody with an id has."""
    return names.select(F.xxhash64(F.concat(F.lit(NAME_KEY), "full_name")).alias("person_sk"), F.lit(None).cast("string").alias(id_col), "full_name", F.lit(FROM_SPONSORS).alias("id_source"))


def two_populations(people: DataFrame, named: DataFrame, id_col: str, name: str, compat: bool = False) -> DataFrame:
    """key, id, name, id_source: those with an id, then names that none of them has."""
    known = people.where(F.col(id_col).isNotNull()).select(F.col(name).alias("full_name")).distinct()
    only = named.select(F.col(named.columns[0]).alias("full_name")).distinct().join(known.hint("merge"), "full_name", "left_anti")
    return identified(people, id_col, name, compat).unionByName(named_only(only, id_col))


def dim_person(votes: DataFrame, sponsors: DataFrame, compat: bool = False) -> DataFrame:
    return two_populations(votes, sponsors.select("sponsor_name"), "person_id", "person_name", compat)


def dim_document(attachments: DataFrame, meeting_documents: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """One row per URL, its greatest title (compat: per URL and title). Meetings' documents join in where given."""
    docs = attachments.select(F.col("attachment_url").alias("document_url"), F.col("attachment_name").alias("document_title"))
    if meeting_documents is not None:
        docs = docs.unionByName(meeting_documents.select("document_url", "document_title"))
    docs = docs.where("document_url IS NOT NULL")
    one = docs.distinct() if compat else docs.groupBy("document_url").agg(F.max("document_title").alias("document_title"))
    return one.select(sk("document_url").alias("document_sk"), url_id("document_url", compat=compat).alias("document_id"), "document_title", "document_url")


def dim_meeting(meetings: DataFrame) -> DataFrame:
    kept = ("meeting_date", "meeting_time", "meeting_subtype", "agenda_status", "agenda_url")
    return meetings.select(sk("meeting_id").alias("meeting_sk"), "meeting_id", sk("body_name").alias("committee_sk"), "body_name", *kept)


def action_key() -> Column:
    return coalesced_key("history_id", "matter_file", "action_date", "action_type")


def fact_matter_action(actions: DataFrame, history: DataFrame) -> DataFrame:
    """Key: history_id, else matter, date and type; equal keys leave the earliest action."""
    keyed = actions.withColumn("matter_action_sk", action_key())
    one = dedup_by_key(keyed, ["matter_action_sk"], ["action_date", "matter_file", "action_seq"])
    return one.join(history.hint("merge"), "history_id", "left").select(
        "matter_action_sk",
        sk("matter_file").alias("matter_sk"),
        sk("body").alias("committee_sk"),
        "meeting_sk",
        F.col("action_type").alias("action_type_code"),
        *("action_date", "action_result", "history_id"),
    )


def merged_rows(latest: Tables) -> DataFrame:
    """How many rows each fact's key leaves out: an action with a history id is known by that alone."""
    votes, actions = latest["int_votes"], latest["int_actions"]
    rest = [F.when(F.col("history_id").isNull(), F.col(c)) for c in ("matter_file", "action_date", "action_type")]
    return report(merged(votes, ["history_id", "person_id"], "fact_vote", "vote_sk"), merged(actions, ["history_id", *rest], "fact_matter_action", "matter_action_sk"))


def with_body(votes: DataFrame, actions: DataFrame) -> DataFrame:
    """Votes with the body of their action, which they have from silver or else are given here."""
    if "body" in votes.columns:
        return votes
    body = dedup_by_key(actions.select("matter_file", "action_seq", "body"), ["matter_file", "action_seq"], ["body"])
    return votes.join(body.hint("merge"), ["matter_file", "action_seq"], "left")


def first_votes(votes: DataFrame) -> DataFrame:
    """One row per history id and person."""
    keyed = votes.withColumn("vote_sk", sk("history_id", "person_id"))
    return dedup_by_key(keyed, ["vote_sk"], ["action_date", "matter_file", "action_seq", "vote_value_raw"])


def vote_facts(votes: DataFrame, history: DataFrame) -> DataFrame:
    """Votes that have their key and body, with their meeting."""
    return votes.join(history.hint("merge"), "history_id", "left").select(
        "vote_sk",
        sk("matter_file").alias("matter_sk"),
        sk("person_id").alias("person_sk"),
        sk("body").alias("committee_sk"),
        "meeting_sk",
        F.col("action_date").alias("vote_date"),
        F.col("vote_value_raw").alias("vote_value"),
        "history_id",
    )


def fact_vote(votes: DataFrame, actions: DataFrame, history: DataFrame) -> DataFrame:
    """One row per history id and person; the vote's body is its action's."""
    return vote_facts(with_body(first_votes(votes), actions), history)


def bridge_matter_sponsor(sponsors: DataFrame, person: DataFrame, compat: bool = False) -> DataFrame:
    """A sponsor listed twice counts once, by its first position (compat: 'co' before 'primary')."""
    resolved = conform(sponsors, "sponsor_name", person.groupBy("full_name").agg(F.min("person_sk").alias("person_sk")).hint("merge"), "full_name", "person_sk")
    rows = resolved.select(sk("matter_file").alias("matter_sk"), "person_sk", first_is("sponsor_pos").alias("sponsor_type"), "sponsor_pos")
    return dedup_by_key(rows, ["matter_sk", "person_sk"], ["sponsor_type" if compat else "sponsor_pos"]).drop("sponsor_pos")


def bridge_matter_document(attachments: DataFrame) -> DataFrame:
    some = attachments.where("attachment_url IS NOT NULL")
    return some.select(sk("matter_file").alias("matter_sk"), sk("attachment_url").alias("document_sk")).distinct()


def bridge_meeting_document(meeting_documents: DataFrame) -> DataFrame:
    some = meeting_documents.where("document_url IS NOT NULL")
    return some.select(sk("meeting_id").alias("meeting_sk"), sk("document_url").alias("document_sk"), "document_source").distinct()


def meeting_resolver(facts: DataFrame, meetings: DataFrame, committee: str, date: str, strict: bool = True) -> DataFrame:
    """Adds meeting_sk by committee name and date. A committee that no meeting has raises; unless ``strict`` its facts stay, without meeting."""
    lookup = meetings.groupBy(F.col("body_name").alias(committee), F.col("meeting_date").alias(date)).agg(F.min("meeting_sk").alias("meeting_sk"))
    if not strict:
        return facts.join(lookup, [committee, date], "left")
    names = meetings.select(F.col("body_name").alias(committee)).distinct().withColumn("_known", F.lit(True))
    checked = facts.join(names, committee, "left")
    known = F.when(F.col("_known") | F.col(committee).isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown committee: "), F.col(committee))).cast("boolean"))
    return checked.where(known).drop("_known").join(lookup, [committee, date], "left")


def build_gold(latest: Tables, compat: bool = False) -> Tables:
    t = latest
    history = int_history_to_meeting(t["int_agenda_items"])
    person = dim_person(t["int_votes"], t["int_sponsors"], compat)
    return {
        "dim_matter": dim_matter(t["int_matters"], t["int_actions"], compat),
        "dim_committee": dim_committee(t["int_actions"], t["int_meetings"], t["int_matters"]),
        "dim_person": person,
        "dim_document": dim_document(t["int_attachments"], None if compat else t["int_meeting_documents"], compat),
        "dim_meeting": dim_meeting(t["int_meetings"]),
        "fact_matter_action": fact_matter_action(t["int_actions"], history),
        "fact_vote": fact_vote(t["int_votes"], t["int_actions"], history),
        "bridge_matter_sponsor": bridge_matter_sponsor(t["int_sponsors"], person, compat),
        "bridge_matter_document": bridge_matter_document(t["int_attachments"]),
        "bridge_meeting_document": bridge_meeting_document(t["int_meeting_documents"]),
    }
