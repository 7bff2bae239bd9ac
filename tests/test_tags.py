"""The tag reader: one record in many shapes, damage, and the records read from it."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.operators import pages, tags

PLAIN = """<span id="x_lblDate">6/1/2026</span><a id="y_hypAgenda" href="View.ashx?M=A&amp;ID=3">Agenda</a><table class="rgMasterTable"><thead><tr><td>h</td></tr></thead><tbody>
<tr><td><a href="PersonDetail.aspx?ID=9">Ann</a></td><td>Aye</td></tr><tr><td>Cy</td><td onclick="radopen('H.aspx?ID=5', 'x')">No</td></tr></tbody></table>"""
SHAPES = {
    "upper case": PLAIN.replace("table", "TABLE").replace("<td", "<TD").replace("</td", "</TD").replace("<tr", "<Tr").replace("id=", "ID = ").replace("href=", "HREF=").replace("class=", "Class="),
    "single quotes": PLAIN.translate(str.maketrans("\"'", "'\"")),
    "no quotes": PLAIN.replace('id="x_lblDate"', "id=x_lblDate").replace('href="PersonDetail.aspx?ID=9"', "href=PersonDetail.aspx?ID=9").replace('class="rgMasterTable"', "class=rgMasterTable"),
    "no end tags": PLAIN.replace("</td>", "").replace("</tr>", "").replace("</tbody></table>", ""),
    "table in a cell": PLAIN.replace("<td>", "<td><table class='rgMasterTable'><tbody><tr><td></td></tr></table>"),
    "hidden parts": PLAIN.replace("<tbody>", "<tbody><!-- <tr><td>no</td></tr> --><script>'<tr><td>'</script><style>td {}</style>"),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes_give_the_plain_record(shape):
    want, got = tags.tree(PLAIN), tags.tree(SHAPES[shape])
    strip = lambda t: [[(c["text"], c["links"]) for c in r["cells"]] for r in t["tables"][0]["rows"]]
    assert strip(got) == strip(want) == [[("Ann", ["PersonDetail.aspx?ID=9"]), ("Aye", [])], [("Cy", []), ("No", [])]]
    assert got["labels"] == want["labels"] == [{"id": "x_lblDate", "text": "6/1/2026", "href": None}, {"id": "y_hypAgenda", "text": "Agenda", "href": "View.ashx?M=A&ID=3"}]
    assert [a["href"] for a in got["anchors"]] == ["View.ashx?M=A&ID=3", "PersonDetail.aspx?ID=9"]


def test_records_of_all_shapes(spark):
    df = spark.createDataFrame([(f"HistoryDetail.aspx?ID={i}", s) for i, s in enumerate([PLAIN, *SHAPES.values()])] + [("HistoryDetail.aspx?ID=99", None)], "url string, html string")
    calls = {r.history_id: r.votes for r in pages.roll_call_pages(df).collect()}
    assert calls.pop("99") is None and len(calls) == 7
    assert all([(v.person_id, v.person_name, v.vote_value) for v in votes] == [("9", "Ann", "Aye"), (None, "Cy", "No")] for votes in calls.values())
    links = pages.anchors(spark.createDataFrame([(1, "<A HREF='a'>x</A><a\nclass=q href=b>y</a><a  href = \"c d\">z</a><!-- <a href=no> -->")], "page_id int, html string"))
    assert [(r.pos, r.href) for r in links.collect()] == [(0, "a"), (1, "b"), (2, "c d")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/='\" abtd!-\n", max_size=60) | st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "<td>", "</td>", "<a href=x>", "</a>", "<p id=q>", "text", "<td", "'", '="']), max_size=30).map("".join))
def test_any_page_is_read(page):
    got = tags.tree(page)
    assert set(got) == {"labels", "anchors", "tables", "attributes"}


def test_rows_belong_to_the_innermost_table():
    rng = random.Random(2)

    def table(depth):
        cells = [[table(depth - 1) if depth and rng.random() < 0.4 else "x" for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 3))]
        shapes.append([len(r) for r in cells])
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>"

    for _ in range(50):
        shapes = []
        got = tags.tree(table(3))
        assert sorted(map(str, shapes)) == sorted(str([len(r["cells"]) for r in t["rows"]]) for t in got["tables"])


def test_columns_beside_the_page_stay(spark):
    df = spark.createDataFrame([(1, ["a"], "<p id=k>v", 2.5)], "tree2 int, `odd name` array<string>, html string, w double")
    r = tags.with_tree(df).first()
    assert (r["tree2"], r["odd name"], r["w"], r["tree"]["labels"][0]["text"]) == (1, ["a"], 2.5, "v")


def test_a_busy_day_is_more_pages_not_a_longer_one(spark, tmp_path, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from strata.plans import catalog

    sheets = {}
    monkeypatch.setattr(catalog.pages, "calendar_rows", lambda df, *a: sheets.update(df=df) or df.select(*(F.lit(1).alias(c) for c in ("meeting_id", "event_guid", "body_name", "location", "meeting_subtype", "has_minutes"))))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("event_id", F.col("event_id") + F.col("copy") * events.count()).drop("copy").write.parquet(f"{tmp_path}/events.parquet")
    longest = lambda: sheets["df"].agg(F.max(F.regexp_count(F.lower("html"), F.lit("<tr")))).first()[0]
    catalog.calendar_page_rows(spark, str(tmp_path))
    assert longest() <= 5 * 12 * catalog.SHEET and sheets["df"].count() > 20


def test_pages_held_at_a_time_are_bounded_by_their_length():
    some = ["x" * (tags.CHARACTERS // 2), None, "x" * tags.CHARACTERS, "", *[""] * 100]
    runs = list(tags.portions(some))
    assert runs[:2] == [(0, 3), (3, 67)] and runs[-1][1] == len(some) and [a for a, _ in runs[1:]] == [b for _, b in runs[:-1]]
    assert list(tags.portions([])) == []


def test_cells_of_text_alone_read_as_any_others():
    whole = "<table><tr><td>a &amp; b</td><TD></td><td>x</TD></tr></table><td>loose</td><table><td>no row</td><tr><td>1</td><td id=i>2<table><tr><td>in</td></tr></table></td></tr></table>"
    apart = whole.replace("<td>", "<td >").replace("<TD>", "<TD >")
    assert tags.tree(whole) == {**tags.tree(apart), "attributes": tags.tree(whole)["attributes"]}
    assert [[c["text"] for c in r["cells"]] for t in tags.tree(whole)["tables"] for r in t["rows"]] == [["a & b", None, "x"], ["1", "2 in"], ["in"]]
