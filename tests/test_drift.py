"""Fields and values that a schema has no place for, and tags from a table of phrases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strata.operators import quality
from strata.operators.search import phrase_tags
from strata.plans.pipeline import Run
from strata.sources.drift import REST, drift_report, read_with_rest, with_rest
from strata.sources.ingest import read_documents
from test_medallion import FIRST, SECOND, matter, write

DDL = "a bigint, b string, c array<struct<d string, e array<int>>>, f struct<g date, h boolean>"


def kept(spark, *texts):
    rows = with_rest(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string"), DDL)
    value = lambda e: e["value"].cast("string")
    found = rows.select("n", "a", "b", "_corrupt_record", F.transform(REST, lambda e: F.struct(e["path"], e["problem"], value(e))).alias("rest"))
    return {r.n: (r.a, r.b, r._corrupt_record, sorted(map(tuple, r.rest))) for r in found.collect()}


def test_unknown_and_retyped_at_every_level(spark):
    got = kept(
        spark,
        '{"a": 1, "b": "x", "c": [{"d": "y", "e": [1, 2]}], "f": {"g": "2024-01-08", "h": true}}',
        '{"a": 1, "z": {"y": 2}, "c": [{"d": "y", "x": 3}, {"x": 4}], "f": {"w": [5]}}',
        '{"a": "one", "b": 7, "c": [8, {"e": ["nine"]}], "f": [10]}',
        '{"a": null, "z": null, "c": [null], "f": {"g": "never"}}',
    )
    assert got[0] == (1, "x", None, [])
    assert got[1] == (1, None, None, [("c[].x", "unknown", "3"), ("c[].x", "unknown", "4"), ("f.w", "unknown", "[5]"), ("z", "unknown", '{"y":2}')])
    assert got[2] == (None, "7", None, [("a", "retyped", "one"), ("c[]", "retyped", "8"), ("c[].e[]", "retyped", "nine"), ("f", "retyped", "[10]")])
    assert got[3] == (None, None, None, [("f.g", "retyped", "never")])


def test_broken_texts_have_no_rest(spark):
    got = kept(spark, '{"a": 1', "", '[{"a": 1}]', None, '{"a": 1, "a": 2}', "7", "{}")
    assert [got[i] for i in range(7)] == [(None, None, t or "", []) for t in ('{"a": 1', "", '[{"a": 1}]', None, '{"a": 1, "a": 2}', "7")] + [(None, None, None, [])]


def test_declared_fields_read_as_without_the_rest(spark, tmp_path):
    write(str(tmp_path), "matters", FIRST, "1", {**matter("1", "Passed"), "extra": [1]})
    from strata.sources.schemas import MATTER

    plain = read_documents(spark, f"{tmp_path}/matters", MATTER).drop("loaded_at")
    more = read_with_rest(spark, f"{tmp_path}/matters", MATTER)
    assert more.select(*plain.columns).collect() == plain.collect()
    assert [tuple(r) for r in drift_report(more).collect()] == [("extra", "unknown", 1, 1)]
    assert drift_report(more.where("false")).collect() == [] and quality.drifted(more, "m").first().failing_count == 1


def test_a_run_keeps_and_counts_the_rest(spark, tmp_path):
    run = Run(spark, raw=f"{tmp_path}/raw", work=f"{tmp_path}/work", prefix="drift_")
    write(run.raw, "matters", FIRST, "1", {**matter("1", "Passed"), "topics": ["parks"]})
    write(run.raw, "matters", SECOND, "2", {**matter("2", "Passed"), "sponsors": "nobody"})
    write(run.raw, "meetings", FIRST, "m", {"meeting_id": "m", "body_name": "Council"})
    assert run.ingest()["matters"].rows == 2 and run.landed["matters"].quarantined == 0
    want = {("matters", "topics", "unknown", 1, 1), ("matters", "sponsors", "retyped", 1, 1)}
    assert {tuple(r) for r in run.drift().collect()} == want
    run.compact()
    assert {tuple(r) for r in run.drift().collect()} == want


def brute(docs, phrases):
    known, out = {}, {}
    for tag, p in phrases:
        if tag is not None and p and re.findall("[a-z0-9]+", p.lower()):
            known.setdefault(tuple(re.findall("[a-z0-9]+", p.lower())), set()).add(tag)
    for i, t in docs:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        for at in range(len(w)):
            best = max((p for p in known if tuple(w[at : at + len(p)]) == p), key=len, default=None)
            for tag in known.get(best, ()):
                n, first = out.get((i, tag), (0, at))
                out[i, tag] = n + 1, min(first, at)
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("at_once", [0, 100_000])
def test_phrases_equal_brute_force(spark, at_once):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,", "d2"]) for _ in range(n))
    docs = [(i % 37, text(rng.randrange(40))) for i in range(60)] + [(None, "a b c"), (50, None), (51, ""), (52, "d2 d2"), (52, "d2 d2")]
    phrases = [(rng.choice("xyz"), text(rng.randrange(1, 5))) for _ in range(40)] + [("x", "-"), ("x", None), (None, "a"), ("y", "d2"), ("y", "D2")]
    table = spark.createDataFrame(phrases, "tag string, phrase string")
    got = phrase_tags(spark.createDataFrame(docs, "id int, body string").withColumn("tag", F.lit(1)), "id", "body", table, at_once)
    assert got.columns == ["id", "tag", "n", "first"] and {tuple(r) for r in got.collect()} == brute(docs, phrases)
    none = phrase_tags(spark.createDataFrame(docs, "id int, body string"), "id", "body", table.where("false"), at_once)
    assert none.count() == 0


def test_ten_thousand_phrases(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    phrases = [(f"t{i % 7}", " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i in range(10_000)]
    docs = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)]
    got = phrase_tags(spark.createDataFrame(docs, "id int, body string"), "id", "body", spark.createDataFrame(phrases, "tag string, phrase string"))
    assert {tuple(r) for r in got.collect()} == brute(docs, phrases)
