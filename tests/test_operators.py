import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.operators import flatten, latest, pages, quality, scd, search
from strata.operators.upsert import merge, upsert
from strata.sources.sinks import Snapshots, payload


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_unnest_and_back(spark):
    df = spark.createDataFrame([(1, [("a", 2), ("b", 1)]), (2, []), (3, None)], "id int, xs array<struct<n string, v int>>")
    flat = flatten.unnest(df, "xs", "x", "pos")
    assert rows(flat, "id", "pos", "x.n") == [(1, 0, "a"), (1, 1, "b")]
    assert rows(flatten.unnest(df, "xs", "x", outer=True), "id", F.col("x").isNull()) == [(1, False), (1, False), (2, True), (3, True)]
    back = flatten.nest(flat.select("id", "pos", "x.n", "x.v"), ["id"], ["n", "v"], "xs", order=["pos"])
    assert [tuple(x) for x in back.first().xs] == [("a", 2), ("b", 1)]
    both = flatten.renest(df.select("id"), flat.select("id", "x.n"), ["id"], "names")
    assert {r.id: [x.n for x in r.names] for r in both.collect()} == {1: ["a", "b"], 2: [], 3: []}


def test_first_seen_and_not_landed(spark):
    feed = spark.createDataFrame([(1, "C"), (2, "A"), (3, "C"), (4, "B"), (5, None), (6, " ")], "at int, url string")
    assert [r.url for r in latest.first_seen(feed, "url", ["at"]).collect()] == ["C", "A", "B"]
    assert rows(latest.not_landed(feed, spark.createDataFrame([("A",)], "url string"), "url").where("url IS NOT NULL AND url != ' '"), "url") == [("B",), ("C",), ("C",)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 2)), min_size=1, max_size=25))
def test_scd2_against_a_loop(spark, changes):
    df = spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(changes)], "k int, t int, v int, seq int")
    got = rows(scd.build_scd2(df, ["k"], ["v"], "t", tie=["seq"]), "k", "v", "effective_from", F.coalesce("effective_to", F.lit(99)))
    want = []
    for k in {c[0] for c in changes}:
        last = {}
        for i, (kk, t, v) in enumerate(changes):
            if kk == k:
                last[t] = v
        runs = []
        for t in sorted(last):
            if not runs or runs[-1][1] != last[t]:
                runs.append((t, last[t]))
        want += [(k, v, t, runs[i + 1][0] if i + 1 < len(runs) else 99) for i, (t, v) in enumerate(runs)]
    assert got == sorted(want)


def test_as_of(spark):
    versions = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, None)], "k int, v string, effective_from int, effective_to int")
    facts = spark.createDataFrame([(1, -1), (1, 0), (1, 4), (1, 5), (2, 3)], "k int, t int")
    assert [tuple(r) for r in scd.as_of(facts, versions, ["k"], "t").select("k", "t", "v").orderBy("k", "t").collect()] == [(1, -1, None), (1, 0, "a"), (1, 4, "a"), (1, 5, "b"), (2, 3, None)]


def test_diff_and_status(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k int, v string")
    assert rows(scd.snapshot_diff(a, b, ["k"], ["v"])) == [(1, "removed"), (2, "changed"), (4, "added")]
    assert rows(scd.text_changes(a, b, "k", "v")) == [(2, True), (3, False), (4, True)]
    assert rows(scd.open_set(a, F.col("v"), ("x",)), "k") == [(2,), (3,)]


def test_merge_and_snapshots(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, v string, w int")
    source = spark.createDataFrame([(2, "B", 9), (2, "C", 9), (3, None, 3), (4, "d", 4), (None, "n", 0)], "k int, v string, w int")
    got = {r.k: (r.v, r.w, r._action) for r in merge(target, source, ["k"]).collect()}
    assert got == {1: ("a", 1, "unchanged"), 2: ("B", 9, "updated"), 3: (None, 3, "unchanged"), 4: ("d", 4, "inserted")}  # no row without a key: every run would insert it again
    only_w = {r.k: (r.v, r.w, r._action) for r in merge(target, source, ["k"], update=["w"]).collect()}
    assert only_w[2] == ("b", 9, "updated")
    assert {r.k: r._action for r in merge(target, source, ["k"], update=False).collect()}[2] == "unchanged"
    table = Snapshots(spark, f"{tmp_path}/t")
    keyed = source.where("k IS NOT NULL")
    assert upsert(table, target, ["k"]) == {"inserted": 3, "updated": 0, "unchanged": 0}
    assert upsert(table, keyed, ["k"]) == {"inserted": 1, "updated": 1, "unchanged": 2}
    once = rows(table.read())
    assert upsert(table, keyed, ["k"]) == {"inserted": 0, "updated": 0, "unchanged": 4}
    assert rows(table.read()) == once and len(table.versions()) == 2


def test_quality_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (None, "a", "y")], "k int, n string, v string")
    dim = spark.createDataFrame([(2,)], "k int")
    one = lambda c: (c.first().failing_count, c.first().passed)
    assert one(quality.orphans(df, "k", dim, "k", "t")) == (2, False)
    assert one(quality.collisions(df, "n", "v", "t")) == (1, False)
    assert one(quality.unique(df, ["k"], "t")) == (1, False)
    assert one(quality.accepted(df, "v", ("x",), "t")) == (1, False)
    assert one(quality.not_empty(df.limit(0), "t")) == (1, False)
    assert one(quality.unresolved(df, "v", "t")) == (1, False)
    assert one(quality.not_empty(df, "t")) == (0, True)
    got = quality.reconcile(df, df.union(df.where("k = 1")).where("n != 'b'"), "t").first()
    assert (got.only_left, got.only_right) == (1, 1)
    assert quality.report(quality.not_empty(df, "t"), quality.unique(df, ["n"], "u")).count() == 2


def test_search(spark):
    docs = spark.createDataFrame([(1, "Zoning and ZONING rules"), (2, "budget"), (3, None), (4, "zoning")], "id int, text string")
    assert rows(search.keyword_tags(docs, "id", "text", {"land": ("zoning", "parcel"), "money": ("budget",)})) == [(1, "land"), (2, "money"), (4, "land")]
    assert [tuple(r) for r in search.keyword_search(docs, "id", "text", ["Zoning"], 5).collect()] == [(1, 2), (4, 1)]


def test_payload(spark):
    got = payload(spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string"), "items", generated=F.lit("now")).first()[0]
    assert got == '{"generated":"now","items":[{"id":1,"v":"a"},{"id":2,"v":"b"}]}'


ENTITY = """<html><script>var x='<table id="gridLegislation">';</script>
<span id="ctl_lblFile2">77</span><span id="ctl_lblName2">Noise &amp; dust</span><span id="ctl_lblStatus2"> Passed </span>
<span id="ctl_lblSponsors2">Ann, Bob and Cy</span><a id="ctl_hypInControlOf2" href="#">Rules&nbsp;Committee</a>
<a href="View.ashx?M=F&amp;ID=1">Leg Ver1</a><a href="View.ashx?M=F&amp;ID=2">Memo</a><a href="other">no</a>
<table class="rgMasterTable" id="x_gridLegislation_ctl00"><tr><th>Date</th></tr>
<tr><td>6/1/2026</td><td>1</td><td>Rules</td><td>REFERRED</td><td>Pass</td><td><a onclick="radopen('HistoryDetail.aspx?ID=5&amp;GUID=AB');">d</a></td></tr>
<tr><td>6/2/2026</td><td>1</td><td>Board</td><td></td><td></td></tr><tr><td>short</td></tr></table></html>"""
ROLL = """<table class="rgMasterTable"><tbody><tr><td><a href="PersonDetail.aspx?ID=9">Ann</a></td><td>D1</td><td>Aye</td></tr>
<tr><td><a href="PersonDetail.aspx?ID=8">Bob</a></td><td></td><td>Recused</td></tr><tr><td>Cy</td><td>No</td></tr><tr><td>Total</td><td>3</td></tr><tr><td><a href="PersonDetail.aspx?ID=7">Di</a></td><td> </td></tr></tbody></table>"""


def test_entity_pages_with_votes(spark):
    df = spark.createDataFrame([(1, "https://h/D?ID=1", ENTITY), (2, "https://h/D?ID=2", '<span id="lblFile2">78</span>'), (3, "https://h/D?ID=3", "<p>"), (4, "https://h/D?ID=4", None)], "page_id int, url string, html string")
    good, bad = pages.isolate_errors(pages.entity_pages(df, "https://h/"))
    assert sorted(r.detail_url[-1] for r in bad.collect()) == ["3", "4"]
    assert rows(pages.drift_signal(pages.entity_pages(df, "https://h/"), "pages"), "error", "n_pages") == [("no file number", 2), ("no history grid", 1)]
    calls = pages.roll_call_pages(spark.createDataFrame([("https://h/HistoryDetail.aspx?ID=5", ROLL)], "url string, html string"))
    got = {r.file_number: r for r in pages.attach_votes(good, calls).collect()}
    r = got["77"]
    assert (r.name, r.status, r.in_control, r.sponsors) == ("Noise & dust", "Passed", "Rules Committee", ["Ann", "Bob", "Cy"])
    assert [(a.name, a.url) for a in r.attachments] == [("Leg Ver1", "https://h/View.ashx?M=F&ID=1"), ("Memo", "https://h/View.ashx?M=F&ID=2")]
    assert [(a.date, a.body, a.action, a.history_id) for a in r.actions] == [("6/1/2026", "Rules", "REFERRED", "5"), ("6/2/2026", "Board", "", None)]
    assert [(v.person_id, v.person_name, v.vote_value) for v in r.actions[0].votes] == [("9", "Ann", "Aye"), ("8", "Bob", "Recused"), (None, "Cy", "No")]
    assert r.actions[1].votes == [] and got["78"].actions == []


def _row(*cells, n=11):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in [*cells, *[""] * (n - len(cells))]) + "</tr>"


def test_calendar_and_meeting_pages(spark):
    link = '<a href="MeetingDetail.aspx?ID=11&amp;GUID=ab-1">d</a>'
    grid = "<table class='x rgMasterTable'><tbody>" + _row("Board", "6/1/2026", "", "2 PM", "Room 250 Special Meeting", link, '<a href="View.ashx?M=A&amp;ID=3">Agenda</a>', "Not&nbsp;available", '<a onclick="x?ID1=55">v</a>') + _row("Board", "6/2/2026", "", "", "", "no link") + _row("short", n=4) + "</tbody></table>"
    df = spark.createDataFrame([(1, grid), (2, "<p>")], "page_id int, html string")
    got = pages.calendar_rows(df, "https://h/").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.meeting_id, r.event_guid, r.location, r.meeting_subtype, r.agenda_url, r.minutes_url, r.video_clip_id, r.has_minutes) == ("11", "AB-1", "Room 250", "Special", "https://h/View.ashx?M=A&ID=3", None, "55", False)
    items = _row("short", n=2) + _row('<a href="LegislationDetail.aspx?ID=4">260001</a>', "", "1", "Name", "Ord", "Passed", "Title", "APPROVED", "Pass", '<a onclick="radopen(\'HistoryDetail.aspx?ID=6&amp;GUID=A\')">x</a>')
    page = f'<span id="lblDate">6/1/2026</span><span id="lblMinutesStatus">Draft</span><a id="z_hypAgenda" href="View.ashx?a">A</a><table class="rgMasterTable"><tbody>{items}</tbody></table>'
    m = pages.meeting_pages(spark.createDataFrame([(1, page)], "page_id int, html string"), "https://h/")
    r = pages.meeting_documents(m, "https://v/").first()
    assert [(i.item_seq, i.matter_file, i.history_id, i.action_raw) for i in r.agenda_items] == [(1, "260001", "6", "APPROVED")]
    assert [d.document_source for d in r.documents] == ["meeting_agenda"] and r.error is None
    assert pages.without_drafts(m).count() == 0 and pages.completed(pages.calendar_rows(df, "https://h/")).count() == 0


def test_complete(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "p int, u string")
    assert pages.assert_complete(items, spark.createDataFrame([(1, 2)], "p int, total int"), ["p"], "u", "total").first().n_found == 2
    with pytest.raises(Exception, match="incomplete"):
        pages.assert_complete(items, spark.createDataFrame([(1, 3)], "p int, total int"), ["p"], "u", "total").collect()
