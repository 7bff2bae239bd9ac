"""History: versions with validity, joins as of a date, differences of snapshots, open and latest states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.buckets import meeting


def row_hash(*columns: str) -> Column:
    """Equal for rows with equal values, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def build_scd2(changes: DataFrame, keys: list[str], tracked: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """keys, tracked, effective_from, effective_to, is_current: one row per run of equal tracked values of a key.

    Several changes at one time leave the last by ``tie``; runs without change collapse before validity is cut, so late
    repeats of a version don't split it. A version holds from effective_from up to, but not at, effective_to.
    """
    last = Window.partitionBy(*keys, at).orderBy(*(F.col(c).desc_nulls_last() for c in (tie or tracked)))
    by_key = Window.partitionBy(*keys).orderBy(at)
    one = changes.select(*keys, *tracked, *[c for c in tie or [] if c not in tracked], at).withColumn("_rn", F.row_number().over(last)).where("_rn = 1")
    hashed = one.withColumn("_h", row_hash(*tracked))
    starts = hashed.withColumn("_was", F.lag("_h").over(by_key)).where(~F.col("_was").eqNullSafe(F.col("_h")))
    versions = starts.withColumn("effective_to", F.lead(at).over(by_key))
    return versions.select(*keys, *tracked, F.col(at).alias("effective_from"), "effective_to", F.col("effective_to").isNull().alias("is_current"))


def as_of(facts: DataFrame, versions: DataFrame, keys: list[str], at: str, how: str = "left", slice_rows: int = 100_000) -> DataFrame:
    """Facts with the version valid at their time, by one sorted pass over facts and versions together.

    Versions of a key don't overlap: each holds from effective_from up to, but not at, effective_to (open if null). In the order of
    time a fact takes the last version that began by then, unless that one has ended. So a key with many facts and versions costs
    their sum, where a join on the key with the range as a condition costs their product.

    A window has all rows of its key in one task, so keys with more than ``slice_rows`` rows are cut at quantiles of time into slices of
    about that size; the last version before a slice is carried into it. A null time or key has no version.
    """
    own = [c for c in versions.columns if c not in keys]
    key = F.struct(*(F.col(k) for k in keys))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in [*keys, at]))
    f = facts.select(key.alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_is_fact"), F.struct(*facts.columns).alias("_fact"), F.lit(None).cast(T.StructType([versions.schema[c] for c in own])).alias("_version"), known.alias("_known"))
    v = versions.where("effective_from IS NOT NULL").select(key.alias("_key"), F.col("effective_from").cast(facts.schema[at].dataType).alias("_at"), F.lit(0).alias("_is_fact"), F.lit(None).cast(facts.schema).alias("_fact"), F.struct(*own).alias("_version"))
    rows = f.where("_known").drop("_known").unionByName(v)
    rows = _sliced(rows, slice_rows)
    in_time = Window.partitionBy("_key", "_slice").orderBy("_at", "_is_fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_version", ignorenulls=True).over(in_time)
    found = rows.withColumn("_last", last).where("_is_fact = 1")
    holds = F.col("_last.effective_to").isNull() | (F.col("_at") < F.col("_last.effective_to"))
    found = found.select("_fact", F.when(F.col("_last").isNotNull() & holds, F.col("_last")).alias("_last"))
    found = found.unionByName(f.where("NOT _known").select("_fact", F.col("_version").alias("_last")))
    if how == "inner":
        found = found.where("_last IS NOT NULL")
    elif how != "left":
        raise ValueError(f"how is 'left' or 'inner', not {how!r}")
    return found.select(*(F.col("_fact").getField(c).alias(c) for c in facts.columns), *(F.col("_last").getField(c).alias(c) for c in own))


def _sliced(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Adds _slice, 0 but for keys with many rows. Each slice but a key's first also gets the last version before it."""
    number = F.col("_at").cast("timestamp").cast("double")
    many = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > slice_rows)
    quantiles = rows.join(many, "_key").groupBy("_key").agg(F.max("_n").alias("_n"), F.percentile_approx(number, [i / 64 for i in range(1, 64)], 1000).alias("_cuts"))
    # As many of the 64 quantiles as give slices of the wanted size; equal ones are one cut.
    step = F.greatest(F.lit(1), F.floor(F.lit(64) * slice_rows / F.col("_n"))).cast("int")
    hot = quantiles.withColumn("_step", step).select("_key", F.array_distinct(F.filter("_cuts", lambda x, i: (i + 1) % F.col("_step") == 0)).alias("_cuts"))
    # Hot keys are few: each has over slice_rows rows. Whether they are broadcast is left to their measured size.
    place = F.size(F.filter("_cuts", lambda c: number >= c))
    cut = rows.join(hot, "_key", "left").withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(place))
    latest = cut.where("_is_fact = 0 AND _cuts IS NOT NULL").groupBy("_key", "_slice").agg(F.max_by(F.struct("_at", "_version"), "_at").alias("_v"), F.first("_cuts").alias("_cuts"))
    # What a slice's last version is, goes into the slices after it up to the next one that has a version of its own to carry.
    latest = latest.withColumn("_after", F.lead("_slice").over(Window.partitionBy("_key").orderBy("_slice"))).withColumn("_until", F.coalesce("_after", F.size("_cuts")))
    heads = latest.where("_slice < _until").select("_key", F.explode(F.sequence(F.col("_slice") + 1, F.col("_until"))).alias("_slice"), "_v")
    fact = rows.schema["_fact"].dataType
    carried = heads.select("_key", F.col("_v._at").alias("_at"), F.lit(0).alias("_is_fact"), F.lit(None).cast(fact).alias("_fact"), F.col("_v._version").alias("_version"), "_slice")
    return cut.drop("_cuts").unionByName(carried)


def started(changes: DataFrame, keys: list[str], tracked: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """build_scd2 with the changes of each version kept beside it (_changes), for ``extend_scd2``."""
    return _runs(_last_at(changes, keys, tracked, at, tie), keys, tracked, at)


def extend_scd2(versions: DataFrame, changes: DataFrame, keys: list[str], tracked: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """Versions made by ``started`` or this function, after a batch of further changes, late ones included.

    Only the keys that the batch names are built again, from their versions' changes and the new ones; repeats that made no version are
    among these, since a late change may fall between them. So any split of the changes into batches, in any order, gives what
    all of them at once give.
    """
    one = _last_at(changes, keys, tracked, at, tie)
    named = one.select(*keys).distinct()
    old = meeting(versions, named, "left_semi").select(*keys, F.explode("_changes").alias("_c")).select(*keys, "_c.*")
    merged = _last_at(old.unionByName(one), keys, tracked, at, tie)
    return meeting(versions, named, "left_anti").unionByName(_runs(merged, keys, tracked, at))


def _last_at(changes: DataFrame, keys: list[str], tracked: list[str], at: str, tie: list[str] | None) -> DataFrame:
    ties = tie or tracked
    last = Window.partitionBy(*keys, at).orderBy(*(F.col(c).desc_nulls_last() for c in ties))
    columns = list(dict.fromkeys([*keys, *tracked, *ties, at]))
    return changes.select(*columns).withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def _runs(one: DataFrame, keys: list[str], tracked: list[str], at: str) -> DataFrame:
    """Versions of changes that have one row for each key and time."""
    by_key = Window.partitionBy(*keys).orderBy(at)
    hashed = one.withColumn("_h", row_hash(*tracked)).withColumn("_was", F.lag("_h").over(by_key))
    run = F.sum(F.col("_was").eqNullSafe(F.col("_h")).cast("int") - 1).over(by_key)
    change = F.struct(at, *(c for c in one.columns if c not in (*keys, at)))
    versions = hashed.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(at).alias("effective_from"), F.min_by(F.struct(*tracked), at).alias("_t"), F.array_sort(F.collect_list(change)).alias("_changes"))
    ended = versions.withColumn("effective_to", F.lead("effective_from").over(Window.partitionBy(*keys).orderBy("effective_from")))
    return ended.select(*keys, "_t.*", "effective_from", "effective_to", F.col("effective_to").isNull().alias("is_current"), "_changes")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """keys, change: 'added', 'removed' or 'changed'; unchanged rows are left out."""
    a = old.select(*keys, row_hash(*compare).alias("_old"))
    b = new.select(*keys, row_hash(*compare).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def open_set(df: DataFrame, status: Column, terminal: tuple[str, ...]) -> DataFrame:
    """Current rows whose status isn't terminal; an unknown status is open."""
    return df.where(~F.coalesce(status.isin(*terminal), F.lit(False)))


def latest_status(events: DataFrame, keys: list[str], status: str, at: str, tie: str) -> DataFrame:
    best = F.max_by(F.struct(status, at), F.struct(at, tie))
    return events.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{status}").alias(status), F.col(f"_b.{at}").alias(at))


def text_changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """key, changed: documents of the new snapshot whose text's digest differs from before, or is new."""
    a = old.select(key, F.sha2(text, 256).alias("_old"))
    b = new.select(key, F.sha2(text, 256).alias("_new"))
    return b.join(a, key, "left").select(key, (~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"))


def tenures(memberships: DataFrame, start: str, end: str, horizon: str) -> DataFrame:
    """valid_from, valid_to, is_current: an end beyond the horizon is open."""
    to = F.when(F.col(end) <= F.lit(horizon).cast("date"), F.col(end))
    return memberships.withColumns({"valid_from": F.col(start), "valid_to": to, "is_current": to.isNull()})
