"""The star by changes against the full build: random captures in random order, late, changed, repeated and withdrawn ones."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata.plans import incremental, star
from strata.plans.pipeline import Run
from strata.plans.staging import SILVER
from strata.sources.buckets import BucketStore
from strata.sources.schemas import MATTER, MEETING, schema
from strata.sources.sinks import Layers, stored
from test_medallion import FIRST, SECOND, action, contents, first_week, matter, rows, second_week, vote, write

LINEAGE = "source_file string, ingest_date date, loaded_at timestamp"


def day(n):
    return datetime(2026, 6, 1 + n)


def bronze(spark, ddl, records):
    full = schema(ddl)
    for f in schema(LINEAGE):
        full = full.add(f)
    return spark.createDataFrame(records, full)


def record(ddl, fields, n, name):
    """A row of the schema's columns in order, with lineage."""

    def shaped(kind, v):
        if v is None:
            return None
        if hasattr(kind, "elementType"):
            return [shaped(kind.elementType, x) for x in v]
        if hasattr(kind, "fields"):
            return tuple(shaped(f.dataType, v.get(f.name)) for f in kind.fields)
        return v

    return (*shaped(schema(ddl), fields), f"{name}-{n}.json", day(n).date(), day(n))


def random_matter(rng, number, n):
    people, histories = [("p1", "Ann"), ("p1", "Ann B"), ("p2", "Bob"), ("p3", "Bob"), (None, "Zed"), ("p4", None)], ["h1", "h2", "h3", "h4", None]
    actions = [action(rng.choice(["5/1/2026", "5/2/2026", "junk"]), rng.choice(["Rules Committee", "Board", None]), rng.choice(["REFERRED", "PASSED"]), rng.choice(histories), [vote(*rng.choice(people), rng.choice(["Aye", "No"])) for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(3))]
    files = [{"name": rng.choice("abc"), "url": rng.choice(["https://h/V?ID=1", "https://h/V?ID=2", None])} for _ in range(rng.randrange(3))]
    fields = matter(number, rng.choice(["Passed", "New Business", None]), actions, [rng.choice(["Ann", "Ann B", "Mayor", "Zed", "Bob"]) for _ in range(rng.randrange(3))], files, in_control=rng.choice(["Board", "Old Board"]))
    return record(MATTER, fields, n, f"m{number}")


def random_meeting(rng, number, n):
    items = [{"item_seq": i, "history_id": rng.choice(["h1", "h2", "h3", None])} for i in range(rng.randrange(3))]
    documents = [{"document_source": "meeting_agenda", "document_title": rng.choice("xyz"), "document_url": rng.choice(["https://h/V?ID=2", "https://h/V?ID=3", None])} for _ in range(rng.randrange(2))]
    return record(MEETING, {"meeting_id": number, "body_name": rng.choice(["Rules Committee", "Hall"]), "meeting_date": "6/2/2026", "documents": documents, "agenda_items": items}, n, f"g{number}")


def same(got, want):
    for name, df in want.items():
        columns = sorted(set(df.columns) - {"loaded_at"})
        assert sorted(map(str, got[name].select(*columns).collect())) == sorted(map(str, df.select(*columns).collect())), name


@pytest.mark.parametrize("seed,compat", [(1, False), (2, True)])
def test_any_batches_equal_the_full_build(spark, tmp_path, seed, compat):
    rng = random.Random(seed)
    store, seen, left = BucketStore(spark, f"{tmp_path}/star", 4), {}, {}
    captures = [("m", str(k), n) for k in range(8) for n in rng.sample(range(12), 2)] + [("g", str(k), n) for k in range(4) for n in rng.sample(range(12), 2)]
    rng.shuffle(captures)
    for batch in range(3):
        part = captures[batch::3]
        frames = {"matters": bronze(spark, MATTER, [random_matter(rng, k, n) for z, k, n in part if z == "m"]), "meetings": bronze(spark, MEETING, [random_meeting(rng, k, n) for z, k, n in part if z == "g"])}
        silver = {name: stored(build(frames[source]), f"{tmp_path}/silver/{batch}/{name}") for name, (source, build) in SILVER.items()}
        gone = {}
        if batch:
            gone = {
                "stg_matters": stored(spark.createDataFrame([(k, "seen", day(n).date(), day(n)) for k, n in (("1", 5), ("2", 20), ("99", 3))], f"matter_file string, {LINEAGE}"), f"{tmp_path}/gone/{batch}/m"),
                "stg_meetings": stored(spark.createDataFrame([("1", "seen", day(6).date(), day(6))], f"meeting_id string, {LINEAGE}"), f"{tmp_path}/gone/{batch}/g"),
            }
        seen = {n: seen[n].unionByName(df) if seen else df for n, df in silver.items()}
        left = {n: left[n].unionByName(df) if left else df for n, df in gone.items()}
        incremental.Changes(store, lambda name, df, b=batch: stored(df, f"{tmp_path}/changes/{b}/{name}"), compat).apply(silver, gone)
        store.commit()
        store = BucketStore(spark, f"{tmp_path}/star")
        if batch:
            whole = {n: stored(df, f"{tmp_path}/whole/{batch}/{n}") for n, df in star.latest_captures(incremental.in_force(seen, left)).items()}
            same(incremental.gold(store), star.build_gold(whole, compat))
    same(incremental.latest(store), whole)
    assert store.vacuum() > 0 and incremental.gold(store)["fact_vote"].count() == star.build_gold(whole, compat)["fact_vote"].count()


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/t", 16)
    rows_of = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    store.create("t", ["k"], rows_of.schema)
    store.replace("t", rows_of.select("k"), rows_of)
    store.commit(applied=["one"])
    before = store.folders("t")
    change = spark.createDataFrame([(3, "b"), (500, "c")], "k long, v string")
    touched = store.touched("t", spark.createDataFrame([(3,), (4,), (500,)], "k long"))
    store.replace("t", spark.createDataFrame([(3,), (4,)], "k long"), change)
    after = store.folders("t")
    assert {b for b in before if before[b] != after.get(b)} <= set(touched) and 0 < len(touched) < 4
    files = {b: sorted(os.listdir(f"{tmp_path}/t/t/{f}/_bucket={b}")) for b, f in before.items()}
    assert all(sorted(os.listdir(f"{tmp_path}/t/t/{after[b]}/_bucket={b}")) == files[b] for b in before if b not in touched)
    assert BucketStore(spark, f"{tmp_path}/t").read("t").where("v <> 'a'").count() == 0  # not committed yet
    store.commit()
    again = BucketStore(spark, f"{tmp_path}/t")
    assert again.notes == {"applied": ["one"]}
    assert rows(again.read("t").where("k IN (3, 4, 500)"), "k", "v") == [(3, "b"), (500, "c")] and again.read("t").count() == 200
    again.replace("t", again.read("t").select("k"), again.read("t").limit(0))
    assert again.folders("t") == {} and again.read("t").count() == 0 and again.matching("t", change.select("k")).count() == 0


def test_counts_add_up_and_vanish(spark, tmp_path):
    store = BucketStore(spark, f"{tmp_path}/t", 4)
    frame = lambda *r: spark.createDataFrame(r, "k string, v int, n long")
    store.create("t", ["k"], frame(("a", 1, 1)).schema)
    store.add("t", frame(("a", 1, 2), ("a", 2, 1), (None, None, 1)))
    store.add("t", frame(("a", 1, -1), ("a", 2, -1), (None, None, 1), ("b", 1, 5)))
    assert sorted(map(tuple, store.read("t").collect()), key=str) == [("a", 1, 1), ("b", 1, 5), (None, None, 2)]


def test_run_withdraws_and_brings_back(spark, tmp_path):
    """Draft, then Final with actions, then withdrawn, then captured again, through the whole run; each refresh equals transform."""
    run = Run(spark, f"{tmp_path}/raw", f"{tmp_path}/work", prefix=f"w{random.randrange(10**9)}_", buckets=4)
    first_week(run.raw)
    run.ingest()
    first = run.refresh()
    assert rows(first["int_meetings"], "meeting_id", "minutes_status") == [("20", "Draft")] and first["int_agenda_items"].count() == 0
    assert first["fact_vote"].where("meeting_sk IS NOT NULL").count() == 0
    second_week(run.raw)
    run.ingest()
    second = run.refresh()
    assert rows(second["int_meetings"], "meeting_id", "minutes_status") == [("100", "Final"), ("20", "Final")]
    assert second["fact_vote"].where("meeting_sk IS NOT NULL").count() == 2  # the votes didn't change, their meeting did
    lineage = lambda k, d: spark.createDataFrame([(k, "list", d)], "k string, source_file string, d string").select("k", "source_file", F.col("d").cast("date").alias("ingest_date"), F.col("d").cast("timestamp").alias("loaded_at"))
    run.withdraw("matters", lineage("1", "2100-01-01").withColumnRenamed("k", "matter_file"))
    run.withdraw("meetings", lineage("100", "2100-01-01").withColumnRenamed("k", "meeting_id"))
    third = run.refresh()
    assert rows(third["dim_matter"], "matter_file") == [("2",), ("3",)] and rows(third["dim_meeting"], "meeting_id") == [("20",)]
    assert third["bridge_matter_sponsor"].count() == 0 and rows(third["dim_person"], "person_id") == [("p1",)]
    kinds = ("int", "dim", "fact", "bridge")
    assert contents(third, *kinds) == contents(run.transform(), *kinds)
    write(run.raw, "matters", "2100-02-01", "1", matter("1", "Passed", [action("5/20/2026", "Rules Committee", "REFERRED", "h1", [vote("p2", "Bob", "Aye")])]))
    run.ingest()
    fourth = run.refresh()
    assert rows(fourth["dim_matter"], "matter_file") == [("1",), ("2",), ("3",)] and contents(fourth, *kinds) == contents(run.transform(), *kinds)
    Layers(spark, run.prefix).reset("silver", "gold")
