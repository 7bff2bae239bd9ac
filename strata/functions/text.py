"""Text columns: splitting, normalising, unescaping, reading numbers out of labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _col


def normalised(text: str | Column) -> Column:
    """Non-breaking and repeated white space become one space; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(_col(text), r"[\s ]+", " ")), F.lit(""))


def split_names(names: str | Column) -> Column:
    """Parts between ';', ',' and ' and ', trimmed, blanks dropped; none for null."""
    parts = F.transform(F.split(_col(names), r";|,| and "), lambda p: F.trim(p))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


#: Kinds of meeting that may close a location text.
MEETING_KINDS = ("Regular", "Special", "Recessed", "Closed Session", "Joint", "Adjourned", "Recess")


def split_suffix(text: str | Column, words=MEETING_KINDS, noun: str = "Meeting") -> tuple[Column, Column]:
    """('City Hall, Special Meeting') -> ('City Hall', 'Special'); without such a suffix (text, null)."""
    ending = rf"(?i)\s+({'|'.join(words)})\s+{noun}\s*$"
    clean = normalised(text)
    kind = F.nullif(F.regexp_extract(clean, ending, 1), F.lit(""))
    rest = F.nullif(F.trim(F.regexp_replace(clean, ending, ""), F.lit(" ,")), F.lit(""))
    return F.when(kind.isNull(), clean).otherwise(rest), F.initcap(kind)


def unescaped(text: str | Column) -> Column:
    """The five named entities; the ampersand last, so nothing is unescaped twice."""
    text = _col(text)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def absolute_url(href: str | Column, base: str) -> Column:
    """Relative links get the base in front; absolute ones stay; entities are unescaped."""
    front = re.sub(r"([\\$])", r"\\\1", base.rstrip("/") + "/")
    # One pattern, so that the link, which may be costly, is worked out once.
    return F.regexp_replace(unescaped(href), r"^(?![A-Za-z][A-Za-z0-9+.-]*:)/*", front)


def pager(text: str | Column) -> tuple[Column, Column]:
    """'Page 1 of 3, items 1 to 100 of 1,234.' -> (3, 1234); (1, null) where there is none."""
    text = _col(text)
    pages = F.regexp_extract(text, r"Page\s+\d+\s+of\s+(\d+)", 1).try_cast("int")
    items = F.replace(F.regexp_extract(text, r"items\s+[\d,]+\s+to\s+[\d,]+\s+of\s+([\d,]+)", 1), F.lit(",")).try_cast("int")
    return F.coalesce(pages, F.lit(1)), items


def first_filled(*sources: str | Column) -> Column:
    """The first source that isn't null or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(_col(s)), F.lit("")) for s in sources))


def first_matching(items: str | Column, prefix: str, field: str = "name") -> Column:
    """The first struct of an array whose field starts with the prefix, whatever its case; null if none does."""
    return F.try_element_at(F.filter(_col(items), lambda x: F.lower(x[field]).startswith(prefix.lower())), F.lit(1))


def array_count(items: str | Column) -> Column:
    """Number of elements; 0 for null."""
    return F.coalesce(F.size(_col(items)), F.lit(0))
