"""Nested arrays to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: str, item: str = "item", pos: str | None = None, outer: bool = False, keep: list[str | Column] | None = None) -> DataFrame:
    """One row per element of ``array`` (a column, or a field path such as 'action.votes'), as column ``item``.

    ``pos`` adds the element's 0-based position. Rows whose array is null or empty vanish, or with ``outer`` stay with a
    null item. ``keep`` names the columns to carry; by default all.
    """
    columns = ["*"] if keep is None else keep
    if pos:
        return df.select(*columns, (F.posexplode_outer if outer else F.posexplode)(array).alias(pos, item))
    return df.select(*columns, (F.explode_outer if outer else F.explode)(array).alias(item))


def fields(item: str, **names: str) -> list[Column]:
    """Struct fields as columns: fields('action', action_date_raw='date')."""
    return [F.col(f"{item}.{field}").alias(name) for name, field in names.items()]


def nest(df: DataFrame, keys: list[str], items: list[str | Column], name: str, order: list[str] | None = None) -> DataFrame:
    """Rows to one array of structs per key, in the order of the struct's fields (or of ``order``, which comes first)."""
    struct = F.struct(*(order or []), F.struct(*items).alias("_item"))
    # Not array_sort, whose comparison is a lambda; no struct here is null.
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(struct)).getField("_item").alias(name))


def renest(parents: DataFrame, children: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Parents with their children's rows as an array; an empty one for parents without children."""
    others = [c for c in children.columns if c not in keys]
    nested = nest(children, keys, others, name)
    joined = parents.join(nested, keys, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def optional_structs(*pairs: tuple[Column, Column]) -> Column:
    """Array of the structs whose condition holds: pairs of (condition, struct)."""
    return F.array_compact(F.array(*(F.when(condition, struct) for condition, struct in pairs)))
