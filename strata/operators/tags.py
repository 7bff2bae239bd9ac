"""A web page as a small tree of what records are read from: labelled elements, anchors, and tables of rows and cells.

Tags may be in any case, attributes in either kind of quotes or none; end tags may be missing where HTML implies them; a
table inside a cell is a table of its own, and its rows and cells don't count among those around it. Script, style and
comments are skipped. Nothing that a page holds raises an error: what isn't a tag is text, and what is still open at
the end of the page (or of the table or cell around it) ends there.

Pages of one plain grid are read by columns (``grids``), with the same result.

The result is one struct column, so whatever picks records from it stays in built-in functions:

* ``labels``: elements with an id, in page order, with their text and, for anchors, their link;
* ``anchors``: the links in page order with their text;
* ``tables``: in page order, the attributes of the table tag and its own rows (those of its bodies where it marks any), a row's
  cells (``td``) with their text, their links, and the attributes of all tags in them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strata.shipping import ship

from . import grids

_CELL = "struct<text:string,links:array<string>,attributes:string>"
TREE = f"struct<labels:array<struct<id:string,text:string,href:string>>,anchors:array<struct<href:string,text:string>>,tables:array<struct<attributes:string,rows:array<struct<attributes:string,cells:array<{_CELL}>>>>>,attributes:string>"
_S = pa.string()

#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What an opening tag ends, up to the element that bounds it.
_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "li": ("li",), "option": ("option",), "p": ("p",)}
_ENDS |= {"thead": _ENDS["tbody"], "tfoot": _ENDS["tbody"]}
_BOUNDS = {"li": ("ul", "ol", "table", "td", "th"), "option": ("select",), "p": ("td", "th", "li", "div", "table")}
_ATTRIBUTE = r"""[^\s"'>/=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_INSIDE = rf"""(?>{_ATTRIBUTE}|[\s/="'])*+"""
#: What isn't shown: a script or style with its content, up to its end tag or the end of the page.
_RAW = "|".join(rf"(?i:{t})(?=[\s/>]){_INSIDE}>(?>.*?</(?i:{t})\b[^>]*+>|.*)" for t in ("script", "style"))
_NAME = r"[a-zA-Z][^\s/>]*+"
#: Elements without end, or that begin or end others: what isn't inside a short cell.
_UNLIKE = "|".join(sorted({*_VOID, *_ENDS, "table", "script", "style"}))


def _short(before="", name="", attributes="", inner="", after="") -> str:
    """Pattern of a short cell: text with at most one element of text in it. The arguments name the groups."""
    group = lambda of, pattern: f"(?P<{of}>{pattern})" if of else pattern
    element = rf"<(?!(?i:{_UNLIKE})[\s/>]){group(name, _NAME)}{group(attributes, _INSIDE)}>{group(inner, '[^<]*+')}</(?P={name})>{group(after, '[^<]*+')}"
    return rf"<(?i:td)>{group(before, '[^<]*+')}(?>{element})?+</(?i:td)>"


_CELL = re.compile(_short("before", "name", "attributes", "inner", "after"))
#: A short cell and a row of nothing else are one piece; of any other tag the slash, name and attributes.
_TAG = re.compile(rf"""(<(?i:tr)>(?>\s*+{_short(name="n")})*+\s*+</(?i:tr)>)|({_short(name="m")})|<(?>{_RAW}|(/?)({_NAME})({_INSIDE})>|!--(?>.*?(?:-->|\Z))|[!?][^>]*+>)""", re.S)
_PAIR = re.compile(r"""([^\s"'>/=]++)(?>\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
#: Pages that are held as Python objects at a time: so many, or one after so many characters.
AT_ONCE, CHARACTERS = 64, 1 << 20
#: The same for pages of one plain grid, which are held as columns.
GRIDS_AT_ONCE = 2048


def plain(text: str) -> str | None:
    """Entities decoded, white space (non-breaking too) one space, blank nothing."""
    return " ".join((html.unescape(text) if "&" in text else text).split()) or None


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', text, ''), ('open' or 'close', tag in lower case, attributes), ('cell' or 'row', markup, '') in page order, without what isn't shown."""
    at = 0
    for m in _TAG.finditer(page):
        start = m.start()
        if start > at:
            yield "text", page[at:start], ""
        at = m.end()
        row, _, cell, _, slash, name, attributes = m.groups()
        if row is not None:
            yield "row", row, ""
        elif cell is not None:
            yield "cell", cell, ""
        elif name is not None:
            yield ("close" if slash else "open"), name.lower(), attributes
    if at < len(page):
        yield "text", page[at:], ""


class _Element:
    __slots__ = ("tag", "start", "label", "anchor", "part")

    def __init__(self, tag: str, start: int):
        self.tag, self.start, self.label, self.anchor, self.part = tag, start, None, None, None


def tree(page: str) -> dict:
    text: list[str] = []
    labels, anchors, tables, every = [], [], [], []
    open_: list[_Element] = []
    cells: list[dict] = []  # rows and cells that are open, outermost first: what is inside adds its attributes and links

    def close(depth: int) -> None:
        """Ends the open elements from this depth on."""
        while len(open_) > depth:
            e = open_.pop()
            if e.label is not None or e.anchor is not None or e.tag == "td":
                own = plain(" ".join(text[e.start :]))
                for found in (e.label, e.anchor, e.part if e.tag == "td" else None):
                    if found is not None:
                        found["text"] = own
            if e.part is not None and e.tag in ("td", "tr"):
                cells.pop()

    def within(tags: tuple[str, ...], bounds: tuple[str, ...]) -> int | None:
        """Depth of the innermost open element of these tags inside the innermost bound."""
        for depth in range(len(open_) - 1, -1, -1):
            if open_[depth].tag in tags:
                return depth
            if open_[depth].tag in bounds:
                return None
        return None

    def shut(name: str) -> None:
        if open_ and open_[-1].tag == name:
            close(len(open_) - 1)
        else:
            depth = within((name,), () if name == "table" else ("table",) if name in _ENDS else ("table", "td", "th"))
            if depth is not None:
                close(depth)

    def note(name: str, attributes: str, around: list[dict]) -> tuple[dict | None, dict | None]:
        """Gives a tag's attributes and links to the rows and cells around it; its label and anchor, still without text."""
        raw = html.unescape(attributes) if "&" in attributes else attributes
        every.append(raw)
        for c in around:
            c["attributes"].append(raw)
        label = anchor = None
        if name == "a" or "id" in attributes.lower():
            given: dict[str, list[str]] = {}
            for key, value in _PAIR.findall(attributes):
                value = value[1:-1] if value[:1] in "\"'" and value[1:] else value
                given.setdefault(key.lower(), []).append(html.unescape(value) if "&" in value else value)
            links = given.get("href", []) if name == "a" else []
            if links:
                anchor = {"href": links[0], "text": None}
                anchors.append(anchor)
                for c in around:
                    c.get("links", []).extend(links)
            if given.get("id"):
                label = {"id": given["id"][0], "text": None, "href": links[0] if links else None}
                labels.append(label)
        return label, anchor

    def fill(row: dict, outer: list[dict], markup: str) -> None:
        """Short cells between the cells of an open row: each opens and ends nothing else."""
        for before, name, attributes, inner, after in _CELL.findall(markup):
            cell = {"text": None, "links": [], "attributes": []}
            row["cells"].append(cell)
            if not name:
                if before:
                    cell["text"] = plain(before)
                    text.append(before)
                continue
            label, anchor = note(name.lower(), attributes, [*outer, row, cell]) if attributes.strip() else (None, None)
            cell["text"] = own = plain(f"{before} {inner} {after}") if before or after else plain(inner)
            for found in (label, anchor):
                if found is not None:
                    found["text"] = plain(inner) if before or after else own
            text.extend((before, inner, after))

    def read(markup: str) -> None:
        """Short cells, wherever they are."""
        if open_ and open_[-1].tag == "tr" and open_[-1].part is not None:
            fill(open_[-1].part, cells[:-1], markup)
            return
        for before, name, attributes, inner, after in _CELL.findall(markup):
            start("td", "")
            text.append(before)
            if name:
                start(name.lower(), attributes)
                text.append(inner)
                shut(name.lower())
                text.append(after)
            shut("td")

    def start(name: str, attributes: str) -> None:
        if name in _ENDS:
            while (depth := within(_ENDS[name], _BOUNDS.get(name, ("table",)))) is not None:
                close(depth)
        e = _Element(name, len(text))
        if attributes.strip():
            e.label, e.anchor = note(name, attributes, cells)
        if name == "table":
            e.part = {"attributes": html.unescape(attributes), "sections": []}
            tables.append(e.part)
        elif name == "tr":
            table = next((x for x in reversed(open_) if x.tag == "table"), None)
            if table is not None:
                section = within(("thead", "tbody", "tfoot"), ("table",))
                e.part = {"attributes": [attributes] if attributes.strip() else [], "cells": []}
                table.part["sections"].append((open_[section].tag if section is not None else "", e.part))
                cells.append(e.part)
        elif name == "td":
            row = within(("tr",), ("table",))
            if row is not None and open_[row].part is not None:
                e.part = {"text": None, "links": [], "attributes": []}
                open_[row].part["cells"].append(e.part)
                cells.append(e.part)
        if name not in _VOID:
            open_.append(e)

    under, sections, kind_of = None, [], ""  # where the last row of short cells lay: the next one there needs no search
    for kind, name, attributes in pieces(page):
        if kind == "text":
            text.append(name)
        elif kind == "close":
            shut(name)
        elif kind == "open":
            start(name, attributes)
        elif kind == "cell":
            read(name)
        elif open_ and open_[-1] is under:
            row = {"attributes": [], "cells": []}
            sections.append((kind_of, row))
            fill(row, cells, name)
        else:
            start("tr", "")
            row = open_[-1].part
            read(name)
            shut("tr")
            # Nothing in a table or a section of it is ended by a row.
            under = open_[-1] if row is not None and open_ and open_[-1].tag in ("table", "thead", "tbody", "tfoot") else None
            if under is not None:
                sections = next(x for x in reversed(open_) if x.tag == "table").part["sections"]
                kind_of = sections[-1][0]
    close(0)
    for t in tables:
        parts = t.pop("sections")
        bodies = [r for kind, r in parts if kind == "tbody"]
        t["rows"] = bodies if bodies else [r for _, r in parts]
        for r in t["rows"]:
            r["attributes"] = " ".join(r["attributes"])
            for c in r["cells"]:
                c["attributes"] = " ".join(c["attributes"])
    return {"labels": labels, "anchors": anchors, "tables": tables, "attributes": " ".join(every)}


def _nested(lists: list[list], of) -> pa.ListArray:
    """Lists of items as Arrow: the items of all lists side by side, made an array by ``of``, and where each list ends."""
    ends = [0, *accumulate(map(len, lists))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of([x for one in lists for x in one]))


def _texts(*names: str):
    return lambda items: pa.StructArray.from_arrays([pa.array([x[n] for x in items], _S) for n in names], names)


def _parts(names: str, items: list[dict], of) -> pa.StructArray:
    """Structs of an attributes text and a list, or of a cell's text, links and attributes."""
    return pa.StructArray.from_arrays([_nested([x[n] for x in items], of) if n in ("rows", "cells", "links") else pa.array([x[n] for x in items], _S) for n in names.split()], names.split())


def columns(trees: list[dict | None]) -> pa.StructArray:
    """Trees as one Arrow array, from flat columns: dicts inside dicts would be looked at item by item."""
    there = [t or {"labels": [], "anchors": [], "tables": [], "attributes": None} for t in trees]
    cells = lambda items: _parts("text links attributes", items, lambda links: pa.array(links, _S))
    rows = lambda items: _parts("attributes cells", items, cells)
    tables = lambda items: _parts("attributes rows", items, rows)
    each = [
        _nested([t["labels"] for t in there], _texts("id", "text", "href")),
        _nested([t["anchors"] for t in there], _texts("href", "text")),
        _nested([t["tables"] for t in there], tables),
        pa.array([t["attributes"] for t in there], _S),
    ]
    return pa.StructArray.from_arrays(each, ["labels", "anchors", "tables", "attributes"], mask=pa.array([t is None for t in trees]))


def _read(texts: list[str | None]) -> pa.StructArray:
    return columns([None if p is None else tree(p) for p in texts])


def runs(lengths: list[int | None], at_once: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of up to so many pages that end once they hold CHARACTERS."""
    begin = held = 0
    for i, n in enumerate(lengths, 1):
        held += n or 0
        if i - begin == at_once or held >= CHARACTERS or i == len(lengths):
            yield begin, i
            begin, held = i, 0


def portions(pages: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of pages that are held as Python objects at a time."""
    return runs([len(p or "") for p in pages], AT_ONCE)


def _first_marked(tables: pa.ListArray, marker: str) -> pa.ListArray:
    """Of each page the first table whose attributes have the marker."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(tables), 0))
    flat = tables.flatten()
    owner = np.repeat(np.arange(len(tables)), counts)
    marked = np.flatnonzero(np.asarray(pc.match_substring(flat.field("attributes"), marker), bool))
    pages, first = np.unique(owner[marked], return_index=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pages, minlength=len(tables)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(marked[first])))


def _without(of: pa.Array, left_out: tuple[str, ...], at: str = "") -> pa.Array:
    """An array of structs or lists without the fields of these paths."""
    if pa.types.is_list(of.type):
        counts = np.asarray(pc.fill_null(pc.list_value_length(of), 0))
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.ListArray.from_arrays(ends, _without(of.flatten(), left_out, at))
    if not pa.types.is_struct(of.type):
        return of
    names = [f.name for f in of.type if at + f.name not in left_out]
    return pa.StructArray.from_arrays([_without(of.field(n), left_out, f"{at}{n}.") for n in names], names, mask=pc.is_null(of) if of.null_count else None)


def _cut_rows(tables: pa.ListArray, cells: int) -> pa.ListArray:
    """Rows with their first cells, and the number of all as ``n``."""
    flat, ends = tables.flatten(), pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(tables), 0)))]), pa.int32())
    rows = flat.field("rows").flatten()
    cut = pa.StructArray.from_arrays([rows.field("attributes"), pc.list_slice(rows.field("cells"), 0, cells), pc.list_value_length(rows.field("cells"))], ["attributes", "cells", "n"])
    of = pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(flat.field("rows"))))]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([flat.field("attributes"), pa.ListArray.from_arrays(of, cut)], ["attributes", "rows"]))


def tree_type(left_out: tuple[str, ...] = (), cut: bool = False) -> T.StructType:
    def pruned(of: T.DataType, at: str = "") -> T.DataType:
        if isinstance(of, T.ArrayType):
            return T.ArrayType(pruned(of.elementType, at))
        if not isinstance(of, T.StructType):
            return of
        fields = [T.StructField(f.name, pruned(f.dataType, f"{at}{f.name}.")) for f in of if at + f.name not in left_out]
        return T.StructType([*fields, T.StructField("n", T.IntegerType())] if cut and at == "tables.rows." else fields)

    return pruned(T.StructType.fromDDL(f"tree {TREE}")["tree"].dataType)


def with_tree(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] | None = None, name: str = "tree", marker: str = "", without: tuple[str, ...] = (), cells: int | None = None) -> DataFrame:
    """The kept columns (by default all but the page) and the tree of each page; a null page has a null tree.

    With a ``marker`` a page's only table is the first one whose attributes have it. ``without`` names parts that nobody will
    look at, such as 'tables.rows.cells.links'. With ``cells`` rows have their first so many cells, and the number of all as ``n``.
    """
    keep = tuple(c for c in pages.columns if c != html_col) if keep is None else keep
    narrow = pages.select(*keep, html_col)
    ship(pages.sparkSession)

    def run(batches):
        def made(rows, trees):
            if marker or cells is not None:
                parts = {f.name: trees.field(f.name) for f in trees.type}
                if marker:
                    parts["tables"] = _first_marked(parts["tables"], marker)
                if cells is not None:
                    parts["tables"] = _cut_rows(parts["tables"], cells)
                trees = pa.StructArray.from_arrays(list(parts.values()), list(parts), mask=pc.is_null(trees) if trees.null_count else None)
            return pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], _without(trees, without)], names=[*keep, name])

        for b in batches:
            regular = grids.regular(b.column(len(keep)))
            plain = pc.is_valid(regular)
            some, others, html = b.filter(plain), b.filter(pc.invert(plain)), regular.filter(plain)
            for begin, end in runs(pc.binary_length(html).to_pylist(), GRIDS_AT_ONCE):
                yield made(some.slice(begin, end - begin), grids.read(html.slice(begin, end - begin), _read, marker))
            texts = others.column(len(keep)).to_pylist()
            for begin, end in portions(texts):
                yield made(others.slice(begin, end - begin), _read(texts[begin:end]))

    fields = [f for f in narrow.schema if f.name in keep]
    return narrow.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField(name, tree_type(without, cells is not None))]))
