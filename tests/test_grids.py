"""Plain pages read by columns against the reader of any page; roll calls dealt by rows and worked out once."""

import random

import pyarrow as pa

from strata.operators import grids, pages, tags
from strata.plans import catalog

TEXTS = ["", "", "x", " a  b\n", "R&amp;D", "&nbsp;", "&amp;nbsp;", "Zoë あ", "1 > 0", "&lt;", "\x1c", "<br>"]
ATTRIBUTES = [" href='#'", ' href="P?ID=3&amp;G=4"', "\n class=''", ' onclick="r(\'x\')"', " href=''", " id='q'", " HREF='x'", " href=x", " title='>'"]


def page(rng):
    some = lambda items, n, most: "".join(rng.choices(items[: len(items) - (rng.random() < 0.9) * n], k=rng.randrange(most)))
    text = lambda: some(TEXTS, 3, 2)

    def cell():
        tag = rng.choice(("a", "a", "b", "span"))
        return f"<td>{text()}" + rng.choice(["", f"<{tag}{some(ATTRIBUTES, 4, 4)}>{text()}</{tag}>{text()}"]) + "</td>"

    rows = "".join("<tr>" + "".join(cell() + rng.choice(["", "\n"]) for _ in range(rng.randrange(4))) + "</tr>" for _ in range(rng.randrange(4)))
    head = some(["<html>", "<head>", '<span id="x_hypName">A &amp; B</span>', "<a id='z' href='q'>s</a>", "<script>'<table>'</script>", "<title>T</title>", "<script>'<tbody>'</script>", "<div id=q>"], 2, 4)
    return f"{head}<table{rng.choice(['', chr(32) + 'class=' + chr(39) + 'rgMasterTable' + chr(39), ' id=' + chr(34) + 'g' + chr(34)])}><tbody>{rows}</tbody></table>{rng.choice(['', '</body></html>', '<a href=t>u</a>'])}"


def test_plain_pages_read_as_any_others():
    rng = random.Random(8)
    made = pa.array([None, "", *(page(rng) for _ in range(6000))])
    plain = made.filter(grids.plain(made))
    assert 1000 < len(plain) < 5000
    got = grids.trees(plain, lambda texts: tags.columns([tags.tree(p) for p in texts]))
    got.validate(full=True)
    assert got.to_pylist() == [tags.tree(p) for p in plain.to_pylist()]


def test_short_cells_read_as_any_others():
    """A blank in the tag keeps the reader from taking rows and cells as one piece."""
    rng = random.Random(9)
    for _ in range(1500):
        one = page(rng).replace("</td>", rng.choice(["</td>", ""])).replace("<tbody>", rng.choice(["<tbody>", "", "<tr>", "<td>"]))
        assert tags.tree(one) == tags.tree(one.replace("<td>", "<td >").replace("<tr>", "<tr >"))


def test_pages_of_both_kinds_keep_their_columns(spark):
    rng = random.Random(10)
    made = [None, *(page(rng) for _ in range(300))]
    got = tags.with_tree(spark.createDataFrame(list(enumerate(made)), "id long, html string")).collect()
    assert {r.id: None if r.tree is None else r.tree.asDict(True) for r in got} == {i: None if p is None else tags.tree(p) for i, p in enumerate(made)}


def test_roll_calls_are_dealt_by_rows_and_worked_out_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "LINES_PER_TASK", 500, raising=False)
    plan = catalog.roll_call_votes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = catalog.table(spark, sf_dir, "lineitem").count()
    assert f"{-(-lines // 500)}), REPARTITION_BY_NUM" in plan
    assert plan.count("PersonDetail") == 1


def test_a_roll_call_of_plain_and_other_pages(spark):
    row = "<tr><td><a href='#' href=\"PersonDetail.aspx?ID=9\">Ann</a></td><td></td><td><b>Maybe</b></td></tr><tr><td>Cy</td><td>No</td></tr><tr><td>Total</td><td>9</td></tr>"
    made = [f"<table class='rgMasterTable'><tbody>{row}</tbody></table>", f"<TABLE class=rgMasterTable>{row.upper().replace('PERSONDETAIL.ASPX', 'PersonDetail.aspx')}", "<table><tbody></tbody></table>", None]
    calls = {r.history_id: r.votes for r in pages.roll_call_pages(spark.createDataFrame([(f"H.aspx?ID={i}", p) for i, p in enumerate(made)], "url string, html string")).collect()}
    assert [tuple(v) for v in calls["0"]] == [("9", "Ann", "Maybe", False), (None, "Cy", "No", True)]
    assert [tuple(v) for v in calls["1"]] == [("9", "ANN", "MAYBE", False)] and calls["2"] == [] and calls["3"] is None
