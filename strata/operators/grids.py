"""Pages of one regular grid, read by columns: the same tree as ``tags.tree`` gives, without a Python step for each row or page.

A page is plain if PLAIN matches it whole: beside the one grid it has text, titles, scripts and elements of text, and the grid's
one body holds rows of cells (``td``) with text, at most one element of text in each and before it at most one table whose cells have text alone;
all tags in lower case, attributes with a value, no entities but two. Two further ways to write the same are turned into it (``regular``):
all tags in upper case, and no end tags of cells and rows anywhere.

Different tables inside cells go through ``tags.tree`` itself, each once for all cells that hold an equal one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_S = "[ \\t\\n\\r]"
#: Text with white space that needs no look-up and two entities; an attribute's value.
_CHAR = r"[^<&\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|&amp;|&nbsp;"
_TEXT = f"(?:{_CHAR})*"
_VALUE = r"""(?:"(?:[^"<>&\x00-\x1f]|&amp;)*"|'(?:[^'<>&\x00-\x1f]|&amp;)*'|[A-Za-z0-9_.:;,?#%+/-](?:[A-Za-z0-9_.:;,?#%+/=-]|&amp;)*)"""
_ANY = f"(?:{_S}+[a-zA-Z]+{_S}*={_S}*{_VALUE})*"
#: Attributes of inner tables and in cells: an id would be a label with what is inside.
_SOME = f"(?:{_S}+(?i:href|class|title|target|onclick|style|rel|border|cellspacing|cellpadding|width){_S}*={_S}*{_VALUE})*"
_ELEMENT = "|".join(f"<{t}{_SOME}>{_TEXT}</{t}>" for t in ("a", "b", "i", "span", "strong"))
_INNER = f"<table{_SOME}>{_S}*<tbody>{_S}*(?:<tr>{_S}*(?:<td>{_TEXT}</td>{_S}*)*</tr>{_S}*)*</tbody>{_S}*</table>"
_CELLS = f"(?:<td>{_TEXT}(?:{_INNER}{_TEXT})?(?:(?:{_ELEMENT}){_TEXT})?</td>{_S}*)*"
_OPEN_CELL = f"<td>{_TEXT}(?:(?:{_ELEMENT}){_TEXT})?"
#: No end tag, row or body may stand in a script, so that the first one in a page is the grid's.
_SCRIPT = "<script>(?:[^<]|<[^/<t]|<t[^bdr<])*</script>"
_HEAD = f"(?:{_CHAR}|<!DOCTYPE[^<>]*>|<(?:html|head|body)>|</head>|{_SCRIPT}|<title>{_TEXT}</title>|<span{_ANY}>{_TEXT}</span>|<a{_ANY}>{_TEXT}</a>)*"
_TAIL = rf"</tbody>{_S}*</table>(?:{_CHAR}|</body>|</html>)*\z"
PLAIN = rf"\A{_HEAD}<table{_ANY}>{_S}*<tbody>{_S}*(?:<tr>{_S}*{_CELLS}</tr>{_S}*)*{_TAIL}"
#: The same without end tags of cells and rows.
_OPEN = rf"\A{_HEAD}<table{_ANY}>{_S}*<tbody>{_S}*(?:<tr>{_S}*(?:{_OPEN_CELL})*)*{_TAIL}"
#: A page of the same elements without a grid.
_GRIDLESS = rf"\A{_HEAD}(?:</body>|</html>|{_S})*\z"
_NAMES = ("table", "tbody", "tr", "td", "a", "b", "i", "span", "strong", "script", "html", "head", "body", "title")
_PARTS = "^(?P<before>[^<]*)<(?P<name>[a-z]+)(?P<attributes>[^<>]*)>(?P<inner>[^<]*)</[a-z]+>(?P<after>[^<]*)$"
_TAG = "^(?P<name>[a-z]+)(?P<attributes>[^<>]*)>(?P<text>[^<]*)$"
_PAIR = rf"""{_S}+([a-zA-Z]+){_S}*={_S}*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=][^\s"'<>]*))"""
#: Stands for a table inside a cell; no plain page holds it.
_MARK = "\x01"


def _where(x: pa.Array, pattern: str) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(x, pattern), False)


def _put(x: pa.Array, mask: pa.Array, changed: pa.Array) -> pa.Array:
    return pc.replace_with_mask(x, mask, changed) if len(changed) else x


def regular(pages: pa.Array) -> pa.Array:
    """Each page as PLAIN has it, or null if it can't be written so; a page without a grid stands as it is if its elements are plain."""
    good = _where(pages, PLAIN)
    rest = pc.invert(good)
    some = pages.filter(rest)
    if not pc.any(pc.is_valid(some)).as_py():
        return pc.if_else(good, pages, pa.scalar(None, pages.type))
    upper = pc.fill_null(pc.match_substring_regex(some, "</?[A-Z]"), False)
    lower = some.filter(upper)
    if len(lower):
        for name in _NAMES:
            for start in ("<", "</"):
                lower = pc.replace_substring(lower, start + name.upper(), start + name)
        some = _put(some, upper, lower)
    open_ = _where(some, _OPEN)
    if pc.any(open_).as_py():
        ended = pc.replace_substring_regex(some.filter(open_), r"<td>([^<]*(?:<(?:a|b|i|span|strong)(?:[ \t\r\n][^<>]*)?>[^<]*</(?:a|b|i|span|strong)>[^<]*)?)", r"<td>\1</td>")
        ended = pc.replace_substring_regex(ended, r"<tr>([^<]*(?:<td>[^<]*(?:<(?:a|b|i|span|strong)(?:[ \t\r\n][^<>]*)?>[^<]*</(?:a|b|i|span|strong)>[^<]*)?</td>)*)", r"<tr>\1</tr>")
        some = _put(some, open_, ended)
    fine = pc.or_(_where(some, PLAIN), _where(some, _GRIDLESS))
    return _put(pages, rest, pc.if_else(fine, some, pa.scalar(None, pages.type)))


def plain(pages: pa.Array) -> pa.Array:
    """Whether each page is read by columns; a null page isn't."""
    return pc.is_valid(regular(pages))


def _decoded(x: pa.Array) -> pa.Array:
    """Attributes, which have but one entity."""
    return pc.replace_substring(x, "&amp;", "&")


def _text(x: pa.Array) -> pa.Array:
    """As ``tags.plain``: entities decoded, white space one space, blank null."""
    if pc.any(pc.match_substring(x, "&")).as_py():
        x = pc.replace_substring(pc.replace_substring(x, "&nbsp;", " "), "&amp;", "&")
    x = pc.utf8_trim(x, " \t\n\r")
    if pc.any(pc.match_substring_regex(x, "[\\t\\n\\r]|  ")).as_py():
        x = pc.replace_substring_regex(x, f"{_S}+", " ")
    return pc.if_else(pc.equal(x, ""), pa.scalar(None, pa.string()), x)


def _ended(x: pa.Array, end: str) -> tuple[np.ndarray, pa.Array]:
    """How many parts of each string the mark ends, and these parts."""
    split = pc.split_pattern(x, end)
    counts = np.asarray(pc.list_value_length(split))
    rest = np.cumsum(counts) - 1  # what is behind the last mark
    keep = np.ones(len(split.flatten()), bool)
    keep[rest] = False
    return counts - 1, split.flatten().filter(pa.array(keep))


def _sums(of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of so many elements."""
    total = np.concatenate([[0], np.cumsum(of, dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return total[ends[1:]] - total[ends[:-1]]


def _lists(counts: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)


def _appended(a: pa.ListArray, counts: np.ndarray, flat: pa.Array) -> pa.ListArray:
    """Each list with so many further elements."""
    if not len(flat):
        return a
    if not len(a.flatten()):
        return _lists(counts, flat)
    first = np.asarray(pc.list_value_length(a))
    owner = np.concatenate([np.repeat(np.arange(len(a)), n) for n in (first, counts)])
    return _lists(first + counts, pa.concat_arrays([a.flatten(), flat]).take(pa.array(np.argsort(owner, kind="stable"))))


def _spread(n: int, at: np.ndarray, values: pa.Array) -> pa.Array:
    """So many values, null but at these places."""
    index = np.full(n, -1)
    index[at] = np.arange(len(values))
    return values.take(pa.array(index, mask=index < 0))


def _given(attributes: pa.Array, key: str) -> tuple[np.ndarray, pa.Array]:
    """How many values each tag gives this attribute, and these values."""
    pairs = pc.split_pattern(pc.replace_substring_regex(attributes, _PAIR, "\x01\\1=\\2\\3\\4"), "\x01")
    found = np.asarray(pc.starts_with(pairs.flatten(), f"{key}=", ignore_case=True), bool)
    values = pc.utf8_slice_codeunits(pairs.flatten().filter(pa.array(found)), len(key) + 1)
    return _sums(found, np.asarray(pc.list_value_length(pairs))), _decoded(values)


def _first(n: int, counts: np.ndarray, values: pa.Array, of: np.ndarray) -> pa.Array:
    """The first value of each tag ``of`` so many that has one, else null."""
    has = counts > 0
    return _spread(n, of[has], values.take(pa.array((np.cumsum(counts) - counts)[has])))


class _Frames:
    """What stands around the rows: flat elements of text and the table's own tag."""

    def __init__(self, around: pa.Array):
        if pc.any(pc.match_substring(around, "<script>")).as_py():
            around = pc.replace_substring_regex(around, "<script>(?:[^<]|<[^/])*</script>", "")
        split = pc.split_pattern(around, "<")
        counts = np.asarray(pc.list_value_length(split))
        part = pc.extract_regex(split.flatten(), _TAG)
        owner = np.repeat(np.arange(len(around)), counts)
        tag = np.flatnonzero(np.asarray(pc.is_valid(part)))
        self.owner, part = owner[tag], part.take(pa.array(tag))
        self.names, attributes, text = (part.field(i) for i in range(3))
        filled = np.asarray(pc.not_equal(pc.utf8_trim_whitespace(attributes), ""))
        self.n, at = len(around), np.flatnonzero(filled)
        given = attributes.filter(pa.array(filled))
        self.is_table = np.asarray(pc.equal(self.names, "table"), bool)
        anchors = np.asarray(pc.equal(self.names, "a"), bool)
        ids = _first(len(tag), *_given(given, "id"), at)
        at_a = np.flatnonzero(filled & anchors)
        hrefs = _first(len(tag), *_given(attributes.take(pa.array(at_a)), "href"), at_a)
        self.ids, self.hrefs, self.text = ids, hrefs, _text(text)
        own = _decoded(attributes)
        self.table = own.filter(pa.array(self.is_table))
        self.attributes = pc.binary_join(_lists(np.bincount(self.owner[filled], minlength=self.n), own.filter(pa.array(filled))), " ")

    def anchors(self) -> pa.ListArray:
        there = np.asarray(pc.is_valid(self.hrefs))
        mask = pa.array(there)
        return _lists(np.bincount(self.owner[there], minlength=self.n), pa.StructArray.from_arrays([self.hrefs.filter(mask), self.text.filter(mask)], ["href", "text"]))

    def labels(self, in_table: pa.Array | None) -> pa.ListArray:
        """``in_table``: the text in each table, which is that of a table with an id."""
        there = np.asarray(pc.is_valid(self.ids))
        text = self.text if in_table is None else _put(self.text, pa.array(self.is_table), in_table)
        mask = pa.array(there)
        return _lists(np.bincount(self.owner[there], minlength=self.n), pa.StructArray.from_arrays([self.ids.filter(mask), text.filter(mask), self.hrefs.filter(mask)], ["id", "text", "href"]))

    def labelled_tables(self) -> bool:
        return bool((np.asarray(pc.is_valid(self.ids)) & self.is_table).any())


_CELL = pa.struct([("text", pa.string()), ("links", pa.list_(pa.string())), ("attributes", pa.string())])
_ROW = pa.struct([("attributes", pa.string()), ("cells", pa.list_(_CELL))])
_TABLE = pa.struct([("attributes", pa.string()), ("rows", pa.list_(_ROW))])


def trees(pages: pa.Array, tree_columns) -> pa.StructArray:
    """Trees of plain pages. ``tree_columns`` reads a list of pages of any kind into such an array."""
    return read(regular(pages), tree_columns)


def read(pages: pa.Array, tree_columns, marker: str = "") -> pa.StructArray:
    """Trees of pages that ``regular`` gave; of a page whose grid has the marker no other table."""
    grid = np.asarray(pc.match_substring(pages, "<tbody>"), bool)
    if not grid.all():
        # Pages without a grid first, then those with one, and back into their order.
        order = np.argsort(grid, kind="stable")
        parts = [_gridless(pages.filter(pa.array(~grid))), *([read(pages.filter(pa.array(grid)), tree_columns, marker)] if grid.any() else [])]
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))
    split = pc.split_pattern(pages, "<tbody>", max_splits=1)
    body, head = pc.list_element(split, 1), pc.list_element(split, 0)
    n_inner, inner, body = _cut(body)
    rest = pc.split_pattern(body, "</tbody>", max_splits=1)
    frames = _Frames(pc.binary_join_element_wise(head, pc.list_element(rest, 1), ""))

    n_rows, rows = _ended(pc.list_element(rest, 0), "</tr>")
    n_cells, cells = _ended(rows, "</td>")
    n = len(cells)
    texts = before = pc.split_pattern(cells, "<td>", max_splits=1).flatten().take(pa.array(np.arange(1, 2 * n, 2)))
    with_element = np.flatnonzero(np.asarray(pc.match_substring(before, "<"), bool))
    part = pc.extract_regex(before.take(pa.array(with_element)), _PARTS)
    start, name, attributes, inside, after = (part.field(i) for i in range(5))
    if len(with_element):
        texts = _put(before, pa.array(np.isin(np.arange(n), with_element)), pc.binary_join_element_wise(start, inside, after, " "))
    filled = np.asarray(pc.not_equal(pc.utf8_trim_whitespace(attributes), ""), bool)

    # Links of the anchors with attributes, then of all cells; an anchor is what has a link.
    is_a = filled & np.asarray(pc.equal(name, "a"), bool)
    at_a = with_element[is_a]
    n_given, links = _given(attributes.filter(pa.array(is_a)), "href")
    n_links = np.zeros(n, np.int64)
    n_links[at_a] = n_given
    linked = n_given > 0
    first = links.take(pa.array((np.cumsum(n_given) - n_given)[linked]))
    anchors = pa.StructArray.from_arrays([first, _text(inside.filter(pa.array(is_a)).filter(pa.array(linked)))], ["href", "text"])
    own = _decoded(attributes)
    of_cell = pc.fill_null(_spread(n, with_element[filled], own.filter(pa.array(filled))), "")

    if len(inner):
        marked = np.flatnonzero(np.asarray(pc.match_substring(texts, _MARK), bool))
        coded = inner.dictionary_encode()
        # Each different one as the cell of a page of its own.
        alone = tree_columns([f"<table><tbody><tr><td>{t}</td></tr></tbody></table>" for t in coded.dictionary.to_pylist()])
        every = alone.field("tables").flatten()
        # An inner table has no table in it, so each of these pages has two.
        tables = every.take(pa.array(np.arange(1, len(every), 2))).take(coded.indices)
        outer = every.take(pa.array(np.arange(0, len(every), 2))).field("rows").flatten().field("cells").flatten()
        inner_text, inner_attributes = (pc.fill_null(outer.field(f), "").take(coded.indices) for f in ("text", "attributes"))
        # Their text is decoded already, so what is in it isn't to be decoded again.
        inner_text = pc.replace_substring(inner_text, "&", "&amp;")
        halves = pc.split_pattern(texts.take(pa.array(marked)), _MARK, max_splits=1)
        mask = pa.array(np.isin(np.arange(n), marked))
        texts = _put(texts, mask, pc.binary_join_element_wise(pc.list_element(halves, 0), inner_text, pc.list_element(halves, 1), " "))
        theirs = of_cell.take(pa.array(marked))
        gap = pc.if_else(pc.or_(pc.equal(inner_attributes, ""), pc.equal(theirs, "")), "", " ")
        of_cell = _put(of_cell, mask, pc.binary_join_element_wise(inner_attributes, gap, theirs, ""))
    text = _text(texts)

    of_page = _sums(n_cells, n_rows)  # cells
    some = np.asarray(pc.not_equal(of_cell, ""), bool)
    given = of_cell.filter(pa.array(some))
    by_row = pc.binary_join(_lists(_sums(some, n_cells), given), " ")
    by_page = pc.binary_join(_lists(_sums(some, of_page), given), " ")
    cell = pa.StructArray.from_arrays([text, _lists(n_links, links), of_cell], ["text", "links", "attributes"])
    row = pa.StructArray.from_arrays([by_row, _lists(n_cells, cell)], ["attributes", "cells"])
    table = _lists(np.ones(len(pages), int), pa.StructArray.from_arrays([frames.table, _lists(n_rows, row)], ["attributes", "rows"]))
    if len(inner) and not (marker and pc.all(pc.match_substring(frames.table, marker)).as_py()):
        table = _appended(table, n_inner, tables)
    in_table = None
    if frames.labelled_tables():
        shown = np.asarray(pc.is_valid(text), bool)
        joined = pc.binary_join(_lists(_sums(shown, of_page), text.filter(pa.array(shown))), " ")
        in_table = pc.if_else(pc.equal(joined, ""), pa.scalar(None, pa.string()), joined)
    gap = pc.if_else(pc.or_(pc.equal(frames.attributes, ""), pc.equal(by_page, "")), "", " ")
    all_attributes = pc.binary_join_element_wise(frames.attributes, gap, by_page, "")
    in_page = np.zeros(n, bool)
    in_page[at_a[linked]] = True
    return pa.StructArray.from_arrays([frames.labels(in_table), _appended(frames.anchors(), _sums(in_page, of_page), anchors), table, all_attributes], ["labels", "anchors", "tables", "attributes"])


def _gridless(pages: pa.Array) -> pa.StructArray:
    frames = _Frames(pages)
    none = _lists(np.zeros(len(pages), int), pa.array([], _TABLE))
    return pa.StructArray.from_arrays([frames.labels(None), frames.anchors(), none, frames.attributes], ["labels", "anchors", "tables", "attributes"])


def _cut(body: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """How many tables each body has inside its cells, these tables, and the bodies with a mark for each."""
    if not pc.any(pc.match_substring(body, "<table")).as_py():
        return np.zeros(len(body), np.int64), pa.array([], pa.string()), body
    split = pc.split_pattern(body, "<table")
    counts = np.asarray(pc.list_value_length(split))
    flat = split.flatten()
    first = np.zeros(len(flat), bool)
    first[np.cumsum(counts) - counts] = True
    halves = pc.split_pattern(flat.filter(pa.array(~first)), "</table>", max_splits=1)
    inner = pc.binary_join_element_wise("<table", pc.list_element(halves, 0), "</table>", "")
    flat = _put(flat, pa.array(~first), pc.list_element(halves, 1))
    return counts - 1, inner, pc.binary_join(_lists(counts, flat), _MARK)
