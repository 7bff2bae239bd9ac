"""Key columns: stable 64-bit keys from natural keys, and ids read from URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sk(*parts: str | Column) -> Column:
    """Key of the parts joined by '|'. A null part is skipped, so the key itself is never null."""
    return F.xxhash64(F.concat_ws("|", *(_col(p).cast("string") for p in parts)))


def sk_strict(*parts: str | Column) -> Column:
    """The same key, but null as soon as one part is null."""
    whole = reduce(lambda a, b: a & b, (_col(p).isNotNull() for p in parts))
    return F.when(whole, sk(*parts))


def coalesced_key(natural: str | Column, *fallback: str | Column) -> Column:
    """Key of the natural id, or where that is null of the fallback parts joined by '|'."""
    return F.xxhash64(F.coalesce(_col(natural).cast("string"), F.concat_ws("|", *(_col(p).cast("string") for p in fallback))))


def url_id(url: str | Column, parameter: str = "ID", compat: bool = False) -> Column:
    """Digits of a URL's parameter; without one null, or '' in compat mode."""
    got = F.regexp_extract(_col(url), rf"[?&]{parameter}=(\d+)", 1)
    return got if compat else F.nullif(got, F.lit(""))
