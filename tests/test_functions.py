import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.functions import codes, dates, keys, text


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


@pytest.mark.parametrize("raw, n", [("A, B and C", 3), ("A; B", 2), ("A, ", 1), ("A,,B", 2), (None, 0), ("", 0)])
def test_split_names(spark, raw, n):
    got = one(spark, raw, text.split_names("x"))[0]
    assert len(got) == n and all(p == p.strip() and p for p in got)


@pytest.mark.parametrize("status, bucket", [("Passed", "passed"), (" finally PASSED ", "passed"), ("Assigned", "in_works"), ("Filed", "other"), ("", "other"), (None, "other")])
def test_producer_bucket(spark, status, bucket):
    assert one(spark, status, codes.producer_bucket("x")) == (bucket,)


@pytest.mark.parametrize("status, disp, life", [("Mayor Approved", "passed", "passed"), ("Filed", "filed", "terminal_other"), ("killed", "killed", "terminal_other"), (None, "in_progress", "in_progress"), ("New thing", "UNMAPPED", "UNMAPPED"), ("", "UNMAPPED", "UNMAPPED")])
def test_disposition(spark, status, disp, life):
    d = codes.disposition("x")
    assert one(spark, status, d, codes.lifecycle(d)) == (disp, life)


def test_code_table_joins_when_long(spark):
    groups = {f"g{i}": tuple(f"c{i}_{j}" for j in range(20)) for i in range(4)}
    df = spark.createDataFrame([("C2_7 ",), ("zz",), (None,)], "x string")
    got = [r["y"] for r in codes.map_codes(df, "x", groups, "y", if_null="none").collect()]
    assert sorted(got) == ["UNMAPPED", "g2", "none"]


@pytest.mark.parametrize("raw, start, end, inside", [("6/1/2026", "2026-06-01", "2026-06-30", True), ("6/30/2026", "2026-06-01", "2026-06-30", True), ("7/1/2026", "2026-06-01", "2026-06-30", False), (None, None, None, True), ("junk", None, None, True), ("junk", "2026-01-01", None, False), ("7/1/2026", "2026-06-01", None, True), ("7/1/2026", None, "2026-06-01", False)])
def test_window(spark, raw, start, end, inside):
    assert one(spark, raw, dates.in_window(dates.parse_date("x"), start, end)) == (inside,)


@pytest.mark.parametrize("raw, date", [("6/1/2026", dt.date(2026, 6, 1)), ("12/31/1999", dt.date(1999, 12, 31)), ("", None), ("junk", None), ("13/1/2020", None), (None, None)])
def test_parse_date_never_throws(spark, raw, date):
    assert one(spark, raw, dates.parse_date("x")) == (date,)


def test_weekly_slices(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), dt.date(2026, 1, 10)), (dt.date(2026, 1, 5), dt.date(2026, 1, 5)), (dt.date(2026, 2, 2), dt.date(2026, 2, 1))], "start date, end date")
    got = sorted((r.slice_start.day, r.slice_end.day) for r in dates.weekly_slices(df).collect())
    assert got == [(1, 7), (5, 5), (8, 10)]


@pytest.mark.parametrize("url, got", [("https://h/x?ID=42&G=1", "42"), ("https://h/x?a=1&ID=42", "42"), ("https://h/x", None), (None, None)])
def test_url_id(spark, url, got):
    assert one(spark, url, keys.url_id("x")) == (got,)
    if url and got is None:
        assert one(spark, url, keys.url_id("x", compat=True)) == ("",)


def test_keys_skip_nulls_and_strict_ones_dont(spark):
    none = F.lit(None).cast("string")
    row = one(spark, "a", keys.sk("x", none), keys.sk("x"), keys.sk(none), keys.sk_strict("x", none), keys.sk(F.lit("a|b")), keys.sk(F.lit("a"), F.lit("b")))
    assert row[0] == row[1] and row[2] == -7444071767201028348 and row[3] is None and row[4] == row[5]


@pytest.mark.parametrize("raw, place, kind", [("City Hall, Room 250 Recessed Meeting", "City Hall, Room 250", "Recessed"), ("City Hall,\n SPECIAL meeting ", "City Hall", "Special"), ("Room 1 Closed Session Meeting", "Room 1", "Closed Session"), ("Room 1", "Room 1", None), (" ", None, None), (None, None, None)])
def test_split_suffix(spark, raw, place, kind):
    assert one(spark, raw, *text.split_suffix("x")) == (place, kind)


@pytest.mark.parametrize("raw, got", [("Page 1 of 3, items 1 to 100 of 1,234.", (3, 1234)), ("no pager", (1, None)), (None, (1, None))])
def test_pager(spark, raw, got):
    assert one(spark, raw, *text.pager("x")) == got


def test_text_helpers(spark):
    assert one(spark, "View.ashx?M=F&amp;ID=9", text.absolute_url("x", "https://h/")) == ("https://h/View.ashx?M=F&ID=9",)
    assert one(spark, "https://o/x", text.absolute_url("x", "https://h/")) == ("https://o/x",)
    assert one(spark, "&amp;lt;", text.unescaped("x")) == ("&lt;",)
    assert one(spark, "   ", text.normalised("x")) == (None,)
    assert one(spark, "  ", text.first_filled("x", F.lit(" b "))) == ("b",)
    arr = F.array(F.struct(F.lit("Other").alias("name")), F.struct(F.lit("LEG VER2").alias("name")), F.struct(F.lit("leg ver1").alias("name")))
    assert one(spark, "", text.first_matching(arr, "leg ver")["name"], text.first_matching(arr, "zz")["name"]) == ("LEG VER2", None)
    assert one(spark, None, text.array_count("x"), kind="array<int>") == (0,)
    assert one(spark, "No", codes.canonical_vote("x")) == ("Nay",)
    assert one(spark, "Rules Committee", codes.body_scope("x")) == ("committee",)


def test_canonical_action(spark):
    labels = spark.createDataFrame([("Finally Passed", "FINAL", "vote")], "label string, action_code string, category string")
    df = spark.createDataFrame([("FINALLY PASSED",), ("odd",)], "a string")
    got = {r.a: (r.action_code, r.category) for r in codes.canonical_action(df, "a", labels).collect()}
    assert got == {"FINALLY PASSED": ("FINAL", "vote"), "odd": ("OTHER", None)}
