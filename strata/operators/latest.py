"""One row per key in a stated order: latest capture wins, its children with it, first seen, not yet landed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = ("ingest_date", "loaded_at", "source_file")


def dedup_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; make the order total for a repeatable result. Only the best row of a key per map task
    is shuffled, since Spark limits the window group before the exchange.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def latest_wins(df: DataFrame, keys: list[str], recency: tuple[str, ...] = RECENT) -> DataFrame:
    """The latest capture of each entity; ties on the first column are broken by the next ones that the table has."""
    return dedup_by_key(df, keys, [F.col(c).desc_nulls_last() for c in recency if c in df.columns])


def latest_narrow(df: DataFrame, keys: list[str], recency: tuple[str, ...]) -> DataFrame:
    """latest_wins as an aggregation with map-side combine: better for narrow rows and few keys."""
    order, rest = [c for c in recency if c in df.columns], [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def keep_latest_children(children: DataFrame, parents: DataFrame, keys: list[str], version: tuple[str, ...] = ("ingest_date", "source_file")) -> DataFrame:
    """Children of the captures that won: same key, same version. Their columns keep their order.

    Merged at every size: a stored table of parents is small in its file and large in memory, so it isn't to be broadcast by its file's size.
    """
    return children.join(parents.select(*keys, *version).hint("merge"), [*keys, *version], "left_semi").select(*children.columns)


def first_seen(df: DataFrame, key: str, order: list[str], keep_order: bool = True) -> DataFrame:
    """Each key where it first occurs; rows without key or with a blank one are left out."""
    some = df.where(F.col(key).isNotNull() & (F.trim(key) != ""))
    first = some.groupBy(key).agg(F.min(F.struct(*order)).alias("_at")).select(key, "_at.*")
    return first.orderBy(*order) if keep_order else first


def target_union(*feeds: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The targets of several feeds in one: feeds in turn, inside a feed by ``order``, each target where it first occurs."""
    numbered = reduce(DataFrame.unionByName, (f.select(key, *order).withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)))
    return first_seen(numbered, key, ["feed", *order], keep_order=False)


def not_landed(candidates: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Candidates whose id isn't landed yet; those without id count as new."""
    return candidates.join(landed.select(key).distinct(), key, "left_anti")


def lowest_parent(links: DataFrame, key: str, parent: str) -> DataFrame:
    """One parent per key, the lowest as text, whatever its type: a lookup that can't fan out."""
    return links.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.col(parent).cast("string")).alias(parent))


def conform(children: DataFrame, name: str, dimension: DataFrame, full_name: str, key: str) -> DataFrame:
    """Adds a dimension's key by name; null where the name is unknown. Names of the dimension must be unique."""
    lookup = dimension.select(F.col(full_name).alias("_name"), F.col(key)).distinct()
    return children.join(lookup, children[name] == F.col("_name"), "left").drop("_name")
