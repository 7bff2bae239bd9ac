"""Merging a batch into a table without a transactional format: the merged rows with a verdict on each, and a writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.sources.sinks import Snapshots

from .latest import dedup_by_key


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: bool | list[str] = True, order: list | None = None) -> DataFrame:
    """The target's columns and _action: 'inserted', 'updated' or 'unchanged'.

    The source is reduced to one row a key first (by ``order``, default all columns). A matched row is updated only if one
    of the columns to update differs: all of them, the listed ones, or none (insert-only). Null keys never match, so source
    rows with one aren't taken: they would be inserted again by every run.
    """
    columns = target.columns
    values = [c for c in columns if c not in keys]
    changing = values if update is True else [] if update is False else list(update)
    keyed = source.select(*columns).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    one = dedup_by_key(keyed, keys, order or [F.col(c) for c in columns])
    t = target.select(*(F.col(c).alias(f"_t_{c}") for c in columns), F.lit(True).alias("_in_t"))
    s = one.select(*(F.col(c).alias(f"_s_{c}") for c in columns), F.lit(True).alias("_in_s"))
    both = t.join(s, [F.col(f"_t_{k}") == F.col(f"_s_{k}") for k in keys], "full_outer")
    matched, inserted = F.col("_in_t") & F.col("_in_s"), F.col("_in_t").isNull()
    differs = reduce(lambda a, b: a | b, (~F.col(f"_t_{c}").eqNullSafe(F.col(f"_s_{c}")) for c in changing), F.lit(False))
    action = F.when(inserted, "inserted").when(F.coalesce(matched, F.lit(False)) & differs, "updated").otherwise("unchanged")
    from_source = lambda c: F.col("_action").isin("inserted", "updated") if c in changing else F.col("_action") == "inserted"
    judged = both.withColumn("_action", action)
    return judged.select(*(F.when(from_source(c), F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in columns), "_action")


def upsert(table: Snapshots, source: DataFrame, keys: list[str], update: bool | list[str] = True, order: list | None = None) -> dict[str, int]:
    """Writes the merged table as its next version; returns how many rows were inserted, updated and left unchanged."""
    target = table.read()
    if target is None:
        target = source.limit(0)
    merged = merge(target, source, keys, update, order)
    seen = Observation()  # counts come from the write itself
    counts = {a: F.coalesce(F.sum((F.col("_action") == a).cast("long")), F.lit(0)).alias(a) for a in ("inserted", "updated", "unchanged")}
    table.write(merged.observe(seen, *counts.values()).drop("_action"))
    return dict(seen.get)
