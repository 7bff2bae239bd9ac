"""Page queries: pages of other writers read by columns, flat items, and each page read once for what is wanted of it."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from strata.operators import flatten, grids, pages, tags
from strata.plans import catalog

from test_grids import page


def shaped(html, kind, rng):
    if kind == "upper":
        return re.sub(r"</?(table|tbody|tr|td|a|span|script)\b", lambda m: m[0].upper(), html).replace(" href=", " HREF = ")
    if kind == "bare":
        return re.sub("</t[dr]>", "", re.sub(r"""(\w)=(["'])([^"'\s>]+)\2""", r"\1=\3", html))
    if kind == "inner":
        return html.replace("<td>", rng.choice(["<td><table class='x'><tbody><tr><td></td></tr></tbody></table>", "<td>q<table border=1><tbody><tr><td>a &amp; b</td></tr></tbody></table> "]))
    if kind == "labelled":
        return html.replace("<table>", "<table id='grid'>", 1)
    return re.sub("<table.*</table>", "", html, flags=re.S)


def test_pages_of_other_writers_are_read_by_columns():
    rng = random.Random(11)
    for kind in ("upper", "bare", "inner", "labelled", "gridless"):
        made = pa.array([shaped(page(rng), kind, rng) for _ in range(1500)])
        plain = made.filter(grids.plain(made))
        assert len(plain) > 300, kind
        got = grids.trees(plain, lambda texts: tags.columns([tags.tree(p) for p in texts]))
        got.validate(full=True)
        assert got.to_pylist() == [tags.tree(p) for p in plain.to_pylist()], kind


def test_all_pages_of_the_queries_are_read_by_columns(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(pages, "with_tree", lambda p, html, *a, **k: seen.append(p.select(html)) or tags.with_tree(p, html, *a, **k))
    for name in ("meeting_page_items", "entity_page_records", "roll_call_votes"):
        catalog.QUERIES[name](spark, sf_dir)
    for df in seen:
        html = pa.array([r[0] for r in df.collect()])
        assert len(html) and grids.plain(html).to_pylist() == [True] * len(html)


def test_items_are_those_of_the_meeting_pages(spark):
    cells = lambda first: "<tr>" + f"<td><a href='LegislationDetail.aspx?ID=4'>{first}</a></td>" + "<td>x</td>" * 9 + "<td><a onclick=\"radopen('HistoryDetail.aspx?ID=7', 'x')\">d</a></td></tr>"
    html = [f"<span id='q_hypName'>B</span><table class='rgMasterTable'><tbody><tr><td>short</td></tr>{cells('1')}{cells('2')}</tbody></table>", "<p>nothing</p>", None, f"<table class='rgMasterTable'><tbody>{cells('3')}</table>"]
    made = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    flat = flatten.unnest(pages.meeting_pages(made, "https://h"), "agenda_items", "i")
    items = pages.meeting_items(made, "https://h")
    want = flat.select(*(c if c in flat.columns else F.col(f"i.{c}").alias(c) for c in items.columns))
    assert sorted(map(str, items.collect())) == sorted(map(str, want.collect())) and items.count() == 3
    some = pages.meeting_items(made, "https://h", only=("item_seq", "history_id"))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, items.select("page_id", "item_seq", "history_id").collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detail_pages_are_read_once(spark, sf_dir):
    assert plan(catalog.entity_page_records(spark, sf_dir)).count("MapInArrow") == 1


def test_records_of_one_url_share_actions_and_those_without_url_have_none(spark):
    action = "struct<date:string,body:string,action:string,result:string,history_id:string,history_url:string>"
    rows = [("u", "1", [("d", "b", "x", "r", "h", "l"), ("d", "b", "y", "r", None, "l")]), ("u", "2", []), ("v", "3", []), ("w", "4", None), (None, "5", [("d", "b", "z", "r", "h", "l")])]
    records = spark.createDataFrame(rows, f"detail_url string, file_number string, actions array<{action}>")
    calls = spark.createDataFrame([("h", [("p", "n", "Aye", True)])], "history_id string, votes array<struct<person_id:string,person_name:string,vote_value:string,known:boolean>>")
    got = {r.file_number: [(a.action, len(a.votes)) for a in r.actions] for r in pages.attach_votes(records, calls).collect()}
    assert got == {"1": [("x", 1), ("y", 0)], "2": [("x", 1), ("y", 0)], "3": [], "4": [], "5": []}


def test_drift_takes_no_rows_out_of_the_reader(spark, sf_dir):
    assert "cells" not in spark_output(catalog.page_drift_signal(spark, sf_dir))


def spark_output(df):
    """The schema of what the page reader gives."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "MapInArrow":
        node = node.children().apply(0)
    return node.output().toString() + node.schema().simpleString()


def test_quarantine_takes_no_rows_out_of_the_reader(spark, sf_dir):
    assert "cells" not in spark_output(catalog.page_quarantine(spark, sf_dir))
