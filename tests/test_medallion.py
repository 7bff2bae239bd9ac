"""The run end to end over invented records: two captures, ties, nulls, a broken file, renamed people, Draft then Final."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strata.functions.keys import sk
from strata.operators import latest, quality
from strata.plans import serve, star
from strata.plans.pipeline import Run
from strata.plans.staging import SILVER
from strata.sources.ingest import apply_drift_policy, read_documents, split_broken
from strata.sources.schemas import MATTER, MEETING, schema
from strata.sources.sinks import Layers, entity_files, overwrite
from strata.streaming.landing import land, landed

FIRST, SECOND = "2026-06-01", "2026-06-08"


def vote(pid, name, value):
    return {"person_id": pid, "person_name": name, "vote_value": value}


def action(date, body, kind, history=None, votes=()):
    return {"date": date, "body": body, "action": kind, "result": "Pass", "history_id": history, "history_url": None, "votes": list(votes)}


def matter(number, status, actions=(), sponsors=(), attachments=(), **more):
    return {"file_number": number, "detail_url": f"https://h/D.aspx?ID={number}", "name": f"Matter {number}", "title": "t", "type": "Ordinance", "status": status, "introduced": "5/1/2026", "in_control": "Board", "sponsors": sponsors, "attachments": attachments, "actions": actions, **more}


def meeting(number, status, items=(), body="Rules Committee", date="6/2/2026"):
    return {"meeting_id": number, "body_name": body, "meeting_date": date, "minutes_status": status, "documents": [], "agenda_items": [{"item_seq": i, "history_id": h} for i, h in enumerate(items)]}


def write(root, kind, day, name, record):
    folder = f"{root}/{kind}/ingest_date={day}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(record if isinstance(record, str) else json.dumps(record, indent=2))


def first_week(root):
    leg = [{"name": "Leg Ver1", "url": "https://h/V?ID=1"}, {"name": "Same", "url": "https://h/V?ID=2"}, {"name": "Other title", "url": "https://h/V?ID=2"}]
    write(root, "matters", FIRST, "1", matter("1", "New Business", [action("5/20/2026", "Rules Committee", "REFERRED", "h1", [vote("p1", "Ann", "Aye"), vote("p2", "Bob", "No")])], ["Ann", "Mayor", "Ann"], leg))
    write(root, "matters", FIRST, "2", matter("2", None, None, None, None))
    write(root, "matters", FIRST, "3", matter("3", "Weird", [action("junk", None, "", None, [vote("p1", "Ann", "Aye")]), action("5/21/2026", "Board", "", None, [vote("p1", "Ann", "Excused")])]))
    write(root, "matters", FIRST, "broken", "{ not json")
    write(root, "matters", FIRST, "_index", {"file_number": "index"})
    write(root, "meetings", FIRST, "m1", meeting("20", "Draft"))


def second_week(root):
    # Actions shifted by one; a person renamed under one id; the meeting turned Final and another one shares its history.
    shifted = [action("5/2/2026", "Board", "INTRODUCED", "h0"), action("5/20/2026", "Rules Committee", "REFERRED", "h1", [vote("p1", "Ann B", "Aye"), vote("p2", "Bob", "No")])]
    write(root, "matters", SECOND, "1", matter("1", "Passed", shifted, ["Mayor", "Ann B"], [{"name": "Leg Ver2", "url": "https://h/V?ID=1"}]))
    write(root, "meetings", SECOND, "m1", meeting("20", "Final", ["h1"]))
    write(root, "meetings", SECOND, "m2", meeting("100", "Final", ["h1"], date="6/3/2026"))


@pytest.fixture
def run(spark, tmp_path, request):
    r = Run(spark, f"{tmp_path}/raw", f"{tmp_path}/work", prefix=f"t{random.randrange(10**9)}_")
    first_week(r.raw)
    yield r
    Layers(spark, r.prefix).reset("silver", "gold")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_run_lands_latest_and_serves(spark, run):
    found = run.ingest()
    assert (found["matters"].rows, found["matters"].quarantined, found["meetings"].rows) == (3, 1, 1)
    second_week(run.raw)
    found = run.ingest()
    assert (found["matters"].rows, found["meetings"].rows) == (1, 2)
    assert run.ingest()["matters"].rows == 0  # nothing new
    t = run.transform()
    assert rows(t["int_matters"], "matter_file", "status") == [("1", "Passed"), ("2", None), ("3", "Weird")]
    assert rows(t["int_actions"].where("matter_file = '1'"), "action_seq", "history_id") == [(0, "h0"), (1, "h1")]
    assert rows(t["int_attachments"], "attachment_url", "attachment_name") == [("https://h/V?ID=1", "Leg Ver2")]
    assert rows(t["dim_matter"], "matter_file", "final_disposition", "lifecycle") == [("1", "passed", "passed"), ("2", "in_progress", "in_progress"), ("3", "UNMAPPED", "UNMAPPED")]
    assert [str(r[0]) for r in t["dim_matter"].where("matter_file = '1'").select("first_committee_date").collect()] == ["2026-05-20"]
    people = {(r.person_id, r.full_name, r.id_source) for r in t["dim_person"].collect()}
    assert {p for p in people if p[0] == "p2"} == {("p2", "Bob", "vote")} and (None, "Mayor", "sponsor_only") in people
    assert len([p for p in people if p[0] == "p1"]) == 1  # one row however often renamed
    # history h1 stands under meetings 100 and 20: the lowest as text wins
    wanted = spark.range(1).select(sk(F.lit("100"))).first()[0]
    votes = t["fact_vote"].where("history_id = 'h1'")
    assert {r.meeting_sk for r in votes.collect()} == {wanted} and votes.count() == 2
    # votes without history of one person collapse to one
    assert t["fact_vote"].where("history_id IS NULL").count() == 1
    report = {(r["check"], r["table"]): r.failing_count for r in run.check(t).collect()}
    assert report["merged_vote_sk", "fact_vote"] == 1 and report["merged_matter_action_sk", "fact_matter_action"] == 0
    assert report["no_fan_out", "member_vote_record"] == 0 and report["unmapped_lifecycle", "dim_matter"] == 1
    with pytest.raises(quality.QualityError, match="unmapped"):
        quality.fail_on(run.check(t), "unmapped_lifecycle")
    assert t["member_vote_record"].columns == "vote_sk vote_date vote_value person_id member_name matter_file matter_name matter_title matter_type matter_status lifecycle final_disposition committee_name meeting_date matter_sk person_sk committee_sk meeting_sk".split()
    # People and a year picked first give the rows that picking them last gives; an unknown date is in no year.
    for who, year in ((["p1"], None), (["p2", "nobody"], 2026), ([], None), (None, 2026), (["p1"], 2025)):
        whole = t["member_vote_record"].where(F.col("person_id").isin(who) if who is not None else F.lit(True)).where(F.year("vote_date") == year if year else F.lit(True))
        assert sorted(map(str, serve.member_vote_record(t, who, year).collect())) == sorted(map(str, whole.collect()))
    assert serve.member_vote_record(t, ["p1"]).count() == 2 and serve.member_vote_record(t, None, 2026).count() == 2


def test_replay_equals_incremental(spark, run):
    run.ingest()
    second_week(run.raw)
    run.ingest()
    before = {n: df.drop("loaded_at").toPandas().astype(str).sort_values(by=sorted(set(df.columns) - {"loaded_at"})).to_csv(index=False) for n, df in run.transform().items() if n.startswith(("dim", "fact", "bridge"))}
    run.reset()
    assert run.ingest()["matters"].rows == 4
    after = {n: df.drop("loaded_at").toPandas().astype(str).sort_values(by=sorted(set(df.columns) - {"loaded_at"})).to_csv(index=False) for n, df in run.transform().items() if n.startswith(("dim", "fact", "bridge"))}
    assert before == after


def contents(tables, *kinds):
    kept = {n: df.drop("loaded_at") for n, df in tables.items() if n.startswith(kinds)}
    return {n: df.toPandas().astype(str).sort_values(by=sorted(df.columns)).to_csv(index=False) for n, df in kept.items()}


def test_refresh_equals_full_run(spark, run, monkeypatch):
    kinds = ("stg", "int", "dim", "fact", "bridge")
    assert set(run.refresh()) >= {"stg_votes", "int_votes", "dim_matter", "fact_vote"}  # nothing landed yet
    run.ingest()
    first = run.refresh()
    assert rows(first["int_matters"], "matter_file", "status") == [("1", "New Business"), ("2", None), ("3", "Weird")]
    second_week(run.raw)
    write(run.raw, "matters", "2026-05-01", "1", matter("1", "Assigned", [action("5/1/2026", "Board", "LATE", "h9")]))  # late: loses
    run.ingest()
    with monkeypatch.context() as m:
        m.setattr(Run, "_gold", lambda self, latest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run.refresh()
    second = contents(run.refresh(), *kinds)  # what failed is done again, once
    assert contents(run.refresh(), *kinds) == second  # nothing new
    assert contents(run.transform(), *kinds) == second


def test_broken_files(spark, run):
    records = read_documents(spark, f"{run.raw}/matters", MATTER, "[!_]*.json")
    good, broken = split_broken(records, "file_number")
    assert good.count() == 3 and broken.count() == 1
    assert rows(good.where("file_number = '1'"), F.col("ingest_date").cast("string")) == [(FIRST,)]
    assert apply_drift_policy(records, "file_number").count() == 3
    with pytest.raises(Exception, match="doesn't match"):
        apply_drift_policy(records, "file_number", "fail").collect()
    with pytest.raises(ValueError):
        apply_drift_policy(records, "file_number", "ignore")


def test_batch_written_twice_lands_once(spark, run, tmp_path):
    for _ in range(2):  # a lost checkpoint replays batch 0 into the same folder
        land(spark, f"{run.raw}/matters", MATTER, "file_number", f"{tmp_path}/b", f"{tmp_path}/c{_}", quarantine=f"{tmp_path}/q")
    assert landed(spark, f"{tmp_path}/b", MATTER).count() == 3


def test_new_checkpoint_overwrites_nothing(spark, run, tmp_path):
    """The landing zone holds other files by the time a new checkpoint starts to count its batches from 0."""
    land(spark, f"{run.raw}/matters", MATTER, "file_number", f"{tmp_path}/b", f"{tmp_path}/c1")
    write(f"{tmp_path}/other", "matters", SECOND, "9", matter("9", "Passed"))
    found = land(spark, f"{tmp_path}/other/matters", MATTER, "file_number", f"{tmp_path}/b", f"{tmp_path}/c2")
    assert found.rows == 1 and rows(landed(spark, f"{tmp_path}/b", MATTER), "file_number") == [("1",), ("2",), ("3",), ("9",)]


def test_tie_in_one_partition_keeps_one_childs_set(spark):
    lineage = "ingest_date string, source_file string, loaded_at string"
    parents = spark.createDataFrame([("1", "2026-06-01", "a", "t"), ("1", "2026-06-01", "b", "t")], f"matter_file string, {lineage}")
    children = spark.createDataFrame([("1", 0, "2026-06-01", "a", "t"), ("1", 0, "2026-06-01", "b", "t"), ("1", 1, "2026-06-01", "b", "t")], f"matter_file string, seq int, {lineage}")
    won = latest.latest_wins(parents, ["matter_file"])
    assert rows(won, "source_file") == [("b",)]
    assert latest.keep_latest_children(children, won, ["matter_file"]).count() == 2
    assert rows(latest.latest_narrow(parents, ["matter_file"], latest.RECENT), "source_file") == [("b",)]


def test_sponsor_listed_twice(spark):
    person = spark.createDataFrame([(7, "Ann")], "person_sk long, full_name string")
    sponsors = spark.createDataFrame([("1", 0, "Ann"), ("1", 2, "Ann"), ("1", 1, "Zed")], "matter_file string, sponsor_pos int, sponsor_name string")
    assert rows(star.bridge_matter_sponsor(sponsors, person).where("person_sk = 7"), "sponsor_type") == [("primary",)]
    assert rows(star.bridge_matter_sponsor(sponsors, person, compat=True).where("person_sk = 7"), "sponsor_type") == [("co",)]


def test_empty_sources_give_empty_star(spark):
    lineage = {"source_file": "string", "ingest_date": "date", "loaded_at": "timestamp"}
    bronze = {}
    for name, ddl in (("matters", MATTER), ("meetings", MEETING)):
        s = schema(ddl)
        for c, k in lineage.items():
            s = s.add(c, k)
        bronze[name] = spark.createDataFrame([], s)
    gold = star.build_gold(star.latest_captures({n: f(bronze[src]) for n, (src, f) in SILVER.items()}))
    assert all(df.count() == 0 for df in gold.values()) and serve.member_vote_record(gold).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2026-01-01"), (None, "b", "2026-01-01"), (2, "c", "2026-01-02")], "k int, v string, ingest_date string")
    entity_files(df, f"{tmp_path}/e", "k")
    assert spark.read.json(f"{tmp_path}/e").count() == 2
    overwrite(df, f"{tmp_path}/p", ("ingest_date",))
    overwrite(df.where("ingest_date = '2026-01-02'").withColumn("v", F.lit("z")), f"{tmp_path}/p", ("ingest_date",))
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/p").collect()) == ["a", "b", "z"]


def test_meeting_resolver(spark):
    meetings = spark.createDataFrame([(1, "Rules", "d1"), (2, "Rules", "d2")], "meeting_sk long, body_name string, meeting_date string")
    facts = spark.createDataFrame([("Rules", "d2"), ("Rules", "d9"), (None, "d1")], "c string, d string")
    assert sorted(str(r.meeting_sk) for r in star.meeting_resolver(facts, meetings, "c", "d").collect()) == ["2", "None", "None"]
    with pytest.raises(Exception, match="unknown committee"):
        star.meeting_resolver(facts.union(facts.limit(0)).unionByName(spark.createDataFrame([("Zoo", "d1")], "c string, d string")), meetings, "c", "d").collect()


def test_meeting_resolver_keeps_facts_of_unknown_committees(spark):
    meetings = spark.createDataFrame([(1, "Rules", "d1"), (3, "Rules", "d1")], "meeting_sk long, body_name string, meeting_date string")
    facts = spark.createDataFrame([("Rules", "d1"), ("Zoo", "d1"), ("Zoo", None)], "c string, d string")
    got = star.meeting_resolver(facts, meetings, "c", "d", strict=False).collect()
    assert sorted((r.c, str(r.meeting_sk)) for r in got) == [("Rules", "1"), ("Zoo", "None"), ("Zoo", "None")]


def test_events_of_users_without_orders_have_no_meeting(spark, tmp_path, sf_dir):
    from strata.plans import catalog

    for name in ("customer", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    far = events.withColumn("user_id", events["user_id"] + 1_000_000)
    events.unionByName(far).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.meeting_by_committee_and_date(spark, str(tmp_path))
    assert got.count() == 2 * events.count()
