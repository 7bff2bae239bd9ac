"""Records from HTML pages: labelled fields, grids of rows, anchors, roll calls.

A page is read once into a tree of labels, anchors and tables (``tags``), whatever case, quotes or end tags it uses;
everything else picks from that struct with built-in functions, so a malformed page costs its own row at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import url_id
from strata.functions.text import absolute_url, normalised, split_names, split_suffix, unescaped

from .flatten import optional_structs
from .tags import with_tree

#: Roll-call literals known without a person link.
VOTE_LITERALS = ("Aye", "No", "Excused", "Absent")
MIN_CELLS = 11
_NO_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def visible(html: str | Column) -> Column:
    return F.regexp_replace(F.col(html) if isinstance(html, str) else html, _NO_MARKUP, "")


def plain(fragment: Column) -> Column:
    """Text of a fragment: tags become spaces, entities characters, white space one space; blank is null."""
    return normalised(unescaped(F.replace(F.regexp_replace(fragment, r"<[^>]*>", " "), F.lit("&nbsp;"), F.lit(" "))))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def labelled(tree: Column, name: str, what: str = "text") -> Column:
    """Text (or href) of the first element whose id ends with ``name``."""
    return first(F.filter(tree["labels"], lambda x: x["id"].endswith(name)))[what]


def link_of(tree: Column, name: str) -> Column:
    """Link of the first anchor whose id ends with ``name``."""
    return first(F.filter(tree["labels"], lambda x: x["id"].endswith(name) & x["href"].isNotNull()))["href"]


#: What marks the grids of meetings and roll calls, and those of detail pages.
GRID, HISTORY_GRID = "rgMasterTable", "gridLegislation"


def grid(tree: Column, marker: str = GRID) -> Column:
    """The first table whose tag carries the marker (in an id or class); null if there is none."""
    return first(F.filter(tree["tables"], lambda t: t["attributes"].contains(marker)))


def rows(table: Column) -> Column:
    """Array of structs (attributes, cells) of a table's own rows; empty without a table."""
    return F.coalesce(table["rows"], F.array())


def n_cells(row: Column) -> Column:
    return F.size(row["cells"])


def cell(row: Column, i: int) -> Column:
    """The i-th cell, from 0; negative counts from the end."""
    return F.try_element_at(row["cells"], F.lit(i + 1 if i >= 0 else i))


def text_cell(row: Column, i: int) -> Column:
    return cell(row, i)["text"]


def href(at: Column, pattern: str = "") -> Column:
    """The first link of a cell that the pattern is found in."""
    return first(F.filter(at["links"], lambda x: x.rlike(pattern)))


def opened(row: Column) -> Column:
    """Target of a pop-up handler anywhere in a row: radopen('target'...)."""
    return found(row["attributes"], r"""(?i)radopen\(\s*['"]([^'"]*)['"]""")


def clip(at: Column) -> Column:
    return found(at["attributes"], r"ID1=(\d+)")


def calendar_rows(pages: DataFrame, base: str, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per meeting of a calendar grid. Rows with too few cells or without a detail link that has id and guid are skipped."""
    row = F.explode(F.filter(rows(grid(F.col("tree"))), lambda r: n_cells(r) >= MIN_CELLS)).alias("row")
    each = with_tree(pages, html, keep, marker=GRID, without=("labels", "anchors", "attributes", "tables.rows.attributes")).select(*keep, row)
    r = F.col("row")
    detail = href(cell(r, 5), r"MeetingDetail\.aspx")
    place, kind = split_suffix(text_cell(r, 4))
    view = lambda i: absolute_url(href(cell(r, i), r"View\.ashx"), base)
    minutes = text_cell(r, 7)
    return each.select(
        *keep,
        url_id(detail).alias("meeting_id"),
        F.upper(found(detail, r"(?i)[?&]GUID=([A-F0-9-]+)")).alias("event_guid"),
        text_cell(r, 0).alias("body_name"),
        text_cell(r, 1).alias("meeting_date"),
        text_cell(r, 3).alias("meeting_time"),
        place.alias("location"),
        kind.alias("meeting_subtype"),
        view(6).alias("agenda_url"),
        view(7).alias("minutes_url"),
        clip(cell(r, 8)).alias("video_clip_id"),
        F.coalesce(~F.lower(minutes).contains("available"), F.lit(False)).alias("has_minutes"),
    ).where("meeting_id IS NOT NULL AND event_guid IS NOT NULL")


def completed(meetings: DataFrame) -> DataFrame:
    return meetings.where("has_minutes")


def without_drafts(meetings: DataFrame, status: str = "minutes_status") -> DataFrame:
    return meetings.where(F.coalesce(F.lower(F.trim(status)) != "draft", F.lit(True)))


#: The cell of each field of an agenda item that is one's text.
_ITEM_CELLS = {"matter_file": 0, "agenda_number": 2, "matter_name": 3, "matter_type": 4, "matter_status": 5, "title": 6, "action_raw": 7, "action_result": 8}


def _item(r: Column, i: Column, base: str) -> dict[str, Column]:
    target, texts = opened(r), {name: text_cell(r, at) for name, at in _ITEM_CELLS.items()}
    return {
        "item_seq": i.cast("long"),
        "matter_file": texts.pop("matter_file"),
        "matter_url": absolute_url(href(cell(r, 0), r"LegislationDetail\.aspx"), base),
        **texts,
        "history_id": url_id(target),
        "history_url": absolute_url(target, base),
    }


def _header(h: Column, base: str) -> dict[str, Column]:
    place, kind = split_suffix(labelled(h, "lblLocation"))
    link = lambda name: absolute_url(link_of(h, name), base)
    return {
        "body_name": labelled(h, "hypName"),
        "meeting_date": labelled(h, "lblDate"),
        "meeting_time": labelled(h, "lblTime"),
        "location": place,
        "meeting_subtype": kind,
        "agenda_status": labelled(h, "lblAgendaStatus"),
        "minutes_status": labelled(h, "lblMinutesStatus"),
        "agenda_url": link("hypAgenda"),
        "minutes_url": link("hypMinutes"),
        "video_clip_id": clip(h),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


_MEETING_PARTS = ("anchors", "tables.rows.cells.attributes")


def meeting_pages(pages: DataFrame, base: str, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Header fields and agenda_items of meeting pages; item_seq counts all rows of the grid, skipped ones too."""
    h = F.col("tree")
    made = F.transform(rows(grid(h)), lambda r, i: F.struct(*_named(_item(r, i, base)), n_cells(r).alias("n_cells")))
    items = F.filter(made, lambda x: x["n_cells"] >= MIN_CELLS)
    return with_tree(pages, html, keep, marker=GRID, without=_MEETING_PARTS).select(
        *keep,
        *_named(_header(h, base)),
        F.transform(items, lambda x: x.dropFields("n_cells")).alias("agenda_items"),
        F.when(grid(h).isNull(), F.lit("no agenda grid")).alias("error"),
    )


def meeting_items(pages: DataFrame, base: str, html: str = "html", keep: tuple[str, ...] = ("page_id",), only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per agenda item with its page's header fields: what unnesting ``meeting_pages`` gives. Rows become rows first, so no
    field is worked out inside an array. ``only`` names the fields that are wanted, as in ``entity_pages``.
    """
    wanted = lambda columns: {n: c for n, c in columns.items() if only is None or n in only}
    h, r = F.col("tree"), F.col("_row")
    header, item = wanted(_header(h, base)), wanted(_item(r, F.col("_i"), base))
    without = _MEETING_PARTS
    without += () if "video_clip_id" in header else ("attributes",)
    without += () if "matter_url" in item else ("tables.rows.cells.links",)
    without += () if {"history_id", "history_url"} & set(item) else ("tables.rows.attributes",)
    cells = 1 + max((i for name, i in _ITEM_CELLS.items() if name in item), default=0)
    each = with_tree(pages, html, keep, marker=GRID, without=without, cells=cells).select(*keep, *_named(header), rows(grid(h)).alias("_rows"))
    rows_ = each.select(*keep, *header, F.posexplode("_rows").alias("_i", "_row")).where(r["n"] >= MIN_CELLS)
    return rows_.select(*keep, *header, *_named(item))


def meeting_documents(meetings: DataFrame, transcript_base: str) -> DataFrame:
    """Adds documents: one struct each for the agenda, the minutes and the recording's transcript that the meeting has."""

    def document(source: str, title: str, url: Column) -> tuple[Column, Column]:
        return url.isNotNull(), F.struct(F.lit(source).alias("document_source"), F.lit(title).alias("document_title"), url.alias("document_url"), F.lit(None).cast("string").alias("body_text"))

    transcript = F.concat(F.lit(f"{transcript_base.rstrip('/')}/"), F.col("video_clip_id"), F.lit("/captions.vtt"))
    documents = optional_structs(
        document("meeting_agenda", "Agenda", F.col("agenda_url")),
        document("meeting_minutes", "Minutes", F.col("minutes_url")),
        document("transcript", "Transcript (VTT)", transcript),
    )
    return meetings.withColumn("documents", documents)


def roll_call(tree: Column) -> Column:
    """Array of votes: a row counts if it links a person, or else if its last cell is a known literal; the value is the
    last cell, as it stands, and ``known`` says whether it is one of the literals.
    """

    # In steps, since each use of an expression inside a lambda evaluates it again.
    def read(r: Column) -> Column:
        value = text_cell(r, -1)
        return F.struct(text_cell(r, 0).alias("person"), value.alias("value"), value.isin(*VOTE_LITERALS).alias("known"), href(cell(r, 0), r"PersonDetail\.aspx").alias("link"), n_cells(r).alias("n"))

    def counts(x: Column) -> Column:
        return (x["n"] >= 2) & x["value"].isNotNull() & (x["link"].isNotNull() | (x["person"].isNotNull() & x["known"]))

    def vote(x: Column) -> Column:
        return F.struct(url_id(x["link"]).alias("person_id"), F.coalesce(x["person"], F.lit("")).alias("person_name"), x["value"].alias("vote_value"), x["known"].alias("known"))

    return F.transform(F.filter(F.transform(rows(grid(tree)), read), counts), vote)


def roll_call_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """history_id (from the page's URL) and votes."""
    calls = with_tree(pages, html, (url,), marker=GRID, without=("labels", "anchors", "attributes", "tables.rows.attributes", "tables.rows.cells.attributes"))
    # A null page has no votes, not an empty list of them.
    return calls.select(url_id(url).alias("history_id"), F.when(F.col("tree").isNotNull(), roll_call(F.col("tree"))).alias("votes"))


def entity_pages(pages: DataFrame, base: str, html: str = "html", url: str = "url", only: tuple[str, ...] | None = None) -> DataFrame:
    """The nested matter record of each detail page, its actions without votes. A page without grid has no actions and says so.

    ``only`` names the columns that are wanted; parts of the page that none of them needs don't leave the reader.
    """
    h = F.col("tree")
    label = {
        "file_number": "lblFile2", "name": "lblName2", "title": "lblTitle2", "type": "lblType2", "status": "lblStatus2", "introduced": "lblIntroduced2",
        "on_agenda": "lblOnAgenda2", "final_action": "lblPassed2", "enactment_date": "lblEnactmentDate2", "enactment_number": "lblEnactmentNumber2", "in_control": "hypInControlOf2",
    }
    files = F.filter(h["anchors"], lambda a: a["href"].contains("View.ashx?M=F"))
    attachments = F.transform(files, lambda a: F.struct(a["text"].alias("name"), absolute_url(a["href"], base).alias("url")))
    history = grid(h, HISTORY_GRID)

    texts = {"date": 0, "body": 2, "action": 3, "result": 4}

    # In steps, since each use of an expression inside a lambda evaluates it again.
    def read(r: Column) -> Column:
        return F.struct(*(F.coalesce(text_cell(r, i), F.lit("")).alias(k) for k, i in texts.items()), opened(r).alias("target"))

    def action(x: Column) -> Column:
        return F.struct(*(x[k].alias(k) for k in texts), url_id(x["target"]).alias("history_id"), absolute_url(x["target"], base).alias("history_url"))

    def actions() -> Column:
        made = F.transform(F.transform(F.filter(rows(history), lambda r: n_cells(r) >= 5), read), action)
        return F.coalesce(made, F.array().cast("array<struct<date:string,body:string,action:string,result:string,history_id:string,history_url:string>>"))

    wanted = lambda name: only is None or name in only
    without = ("attributes", "tables.rows.cells.attributes", "tables.rows.cells.links")
    without += () if wanted("actions") else ("tables.rows",)
    without += () if wanted("attachments") else ("anchors",)
    columns = [
        F.col(url).alias("detail_url"),
        *(labelled(h, name).alias(column) for column, name in label.items()),
        split_names(labelled(h, "lblSponsors2")).alias("sponsors"),
        split_names(labelled(h, "lblRelatedFiles2")).alias("related_files"),
        *([attachments.alias("attachments")] if wanted("attachments") else []),
        *([actions().alias("actions")] if wanted("actions") else []),
        F.when(labelled(h, "lblFile2").isNull(), F.lit("no file number")).when(history.isNull(), F.lit("no history grid")).alias("error"),
    ]
    records = with_tree(pages, html, (url,), marker=HISTORY_GRID, without=without).select(*columns)
    return records if only is None else records.select(*only)


def attach_votes(records: DataFrame, roll_calls: DataFrame, key: str = "detail_url") -> DataFrame:
    """Each action gets the votes of the page that its history_id names; actions without page get none.

    A record goes along with its first action, so the records, which may come from pages, are worked out once.
    """
    votes = roll_calls.select(F.col("history_id").alias("_id"), F.transform("votes", lambda v: v.dropFields("known")).alias("votes")).where("_id IS NOT NULL").dropDuplicates(["_id"])
    rest = [c for c in records.columns if c not in (key, "actions")]
    flat = records.select(key, F.struct(*rest).alias("_record"), F.posexplode_outer("actions").alias("_pos", "_a"))
    flat = flat.withColumn("_record", F.when(F.coalesce(F.col("_pos"), F.lit(0)) == 0, F.col("_record")))
    joined = flat.join(votes, flat["_a.history_id"] == votes["_id"], "left")
    none = F.array().cast(votes.schema["votes"].dataType)
    action = F.struct(*(F.col(f"_a.{n}").alias(n) for n in ("date", "body", "action", "result", "history_id", "history_url")), F.coalesce("votes", none).alias("votes"))
    # The order of records with one key and of their actions is that of their places and fields.
    item = F.when(F.col("_pos").isNotNull() & F.col(key).isNotNull(), F.struct("_pos", action.alias("_action")))
    nested = joined.groupBy(key).agg(F.collect_list("_record").alias("_records"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_action"]).alias("_actions"))
    out = nested.select(key, "_actions", F.explode("_records").alias("_record"))
    return out.select(*(F.col(key) if c == key else F.col(f"_record.{c}") for c in records.columns if c != "actions"), F.col("_actions").alias("actions"))


def isolate_errors(records: DataFrame, fatal: tuple[str, ...] = ("no file number",)) -> tuple[DataFrame, DataFrame]:
    """(usable records, quarantine): a page that can't be read never stops the others."""
    bad = F.coalesce(F.col("error").isin(*fatal), F.lit(False))
    return records.where(~bad), records.where(bad)


def drift_signal(records: DataFrame, table: str) -> DataFrame:
    """Pages whose expected structure is missing, by kind."""
    return records.where("error IS NOT NULL").groupBy(F.lit(table).alias("table"), "error").agg(F.count(F.lit(1)).alias("n_pages"))


def assert_complete(items: DataFrame, reported: DataFrame, keys: list[str], identity: str, total: str) -> DataFrame:
    """The reported totals with the items found; raises where different items and total disagree."""
    counted = reported.join(items.groupBy(*keys).agg(F.countDistinct(identity).alias("n_found")), keys, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    wrong = F.raise_error(F.concat(F.lit("incomplete: found "), F.col("n_found").cast("string"), F.lit(" of "), F.col(total).cast("string")))
    return counted.withColumn("n_found", F.when(F.col("n_found") == F.col(total), F.col("n_found")).otherwise(wrong.cast("long")))


def anchors(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """pos, href of each anchor in page order."""
    links = F.regexp_extract_all(visible(html), F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), 1)
    return pages.select(*keep, F.posexplode(F.transform(links, lambda x: F.regexp_replace(x, r"^[\"']|[\"']$", ""))).alias("pos", "href"))


@dataclass(frozen=True)
class RecordSpec:
    """Header fields as patterns with one group, and an item pattern whose group is an item's markup."""

    header: dict[str, str] = field(default_factory=dict)
    item: str = r"(?s)<li>(.*?)</li>"


def extract_records(pages: DataFrame, spec: RecordSpec, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A header struct and an array of item texts for any kind of page."""
    h = visible(html)
    items = F.transform(F.regexp_extract_all(h, F.lit(spec.item), 1), plain)
    return pages.select(*keep, F.struct(*(plain(found(h, p)).alias(k) for k, p in spec.header.items())).alias("header"), F.array_compact(items).alias("items"))
