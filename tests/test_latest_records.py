"""The latest captures by whole records, and votes with their body."""

from pyspark.sql import functions as F

from strata.plans import star, staging
from strata.plans.staging import SILVER
from strata.sources.schemas import MATTER, MEETING, schema

from test_medallion import FIRST, SECOND, action, matter, meeting, vote


def bronze(spark):
    early = [matter("1", "New", [action("5/20/2026", "Rules", "REFERRED", "h1", [vote("p1", "Ann", "Aye")])], ["Ann", "Mayor"]), matter("2", None, None, None, None)]
    late = [matter("1", "Passed", [action("5/2/2026", "Board", "IN"), action("5/20/2026", "Rules", "REFERRED", "h1", [vote("p1", "Ann B", "No"), vote("p2", "Bob", "No")])], ["Ann B"])]
    of = lambda rows, ddl, day: spark.createDataFrame(rows, schema(ddl)).withColumns({"source_file": F.lit(f"{day}.json"), "ingest_date": F.lit(day).cast("date"), "loaded_at": F.lit(day).cast("timestamp_ntz")})
    filled = lambda rows: [{**dict.fromkeys(schema(MATTER).names), **r} for r in rows]
    meetings = [{**dict.fromkeys(schema(MEETING).names), **m} for m in (meeting("20", "Draft"), meeting("21", "Final", ["h1"]))]
    first = {"matters": of(filled(early), MATTER, FIRST), "meetings": of(meetings, MEETING, FIRST)}
    second = {"matters": of(filled(late), MATTER, SECOND), "meetings": of([{**meetings[0], "minutes_status": "Final"}], MEETING, SECOND)}
    return first, second


def rows(tables):
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name, df in tables.items()}


def test_latest_records_give_the_latest_captures(spark):
    first, second = bronze(spark)
    both = {zone: first[zone].unionByName(second[zone]) for zone in first}
    want = rows(star.latest_captures({n: build(both[source]) for n, (source, build) in SILVER.items()}))
    assert len(want["int_votes"]) == 2 and len(want["int_matters"]) == 2
    assert rows(star.of_records(star.latest_records(both))) == want
    for weeks in ((first, second), (second, first)):  # late captures lose
        assert rows(star.of_records(star.latest_records(weeks[1], star.latest_records(weeks[0])))) == want


def test_votes_know_their_body_without_meeting_the_actions(spark):
    matters = bronze(spark)[1]["matters"]
    votes, actions = staging.stg_votes(matters), staging.stg_actions(matters)
    history = spark.createDataFrame([("h1", 5)], "history_id string, meeting_sk long")
    facts = star.fact_vote(votes, actions, history)
    assert str(facts._jdf.queryExecution().optimizedPlan()).count("Join ") == 1
    assert {(r.committee_sk, r.meeting_sk) for r in facts.collect()} == {(spark.range(1).select(star.sk(F.lit("Rules"))).first()[0], 5)}
    given = star.with_body(votes.drop("body"), actions)
    assert sorted(map(str, given.select("person_id", "body").collect())) == sorted(map(str, votes.select("person_id", "body").collect()))
