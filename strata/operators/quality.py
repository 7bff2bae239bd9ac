"""Checks as rows (check, table, failing_count, passed), and reconciliation of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _result(failing: DataFrame | Column, check: str, table: str, df: DataFrame | None = None) -> DataFrame:
    """failing: rows that fail, or an aggregate over ``df`` that counts them."""
    counted = failing.agg(F.count(F.lit(1)).alias("n")) if isinstance(failing, DataFrame) else df.agg(F.coalesce(failing, F.lit(0)).cast("long").alias("n"))
    return counted.select(F.lit(check).alias("check"), F.lit(table).alias("table"), F.col("n").alias("failing_count"), (F.col("n") == 0).alias("passed"))


def orphans(facts: DataFrame, key: str, dimension: DataFrame, dim_key: str, table: str) -> DataFrame:
    """Facts whose (non-null) key the dimension lacks."""
    some = facts.where(F.col(key).isNotNull())
    return _result(some.join(dimension.select(F.col(dim_key).alias(key)), key, "left_anti"), f"orphan_{key}", table)


def unmapped(df: DataFrame, column: str, table: str, mark: str = "UNMAPPED") -> DataFrame:
    return _result(F.count_if(F.col(column) == mark), f"unmapped_{column}", table, df)


def unresolved(df: DataFrame, column: str, table: str) -> DataFrame:
    return _result(F.count_if(F.col(column).isNull()), f"unresolved_{column}", table, df)


def collisions(df: DataFrame, name: str, identity: str, table: str) -> DataFrame:
    """Names that more than one identity owns."""
    return _result(df.groupBy(name).agg(F.countDistinct(identity).alias("_owners")).where("_owners > 1"), f"collision_{name}", table)


def fill_rate(df: DataFrame, *columns: str) -> DataFrame:
    """column, filled, total, rate."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(c) for c in columns))
    rows = one.unpivot(["total"], list(columns), "column", "filled")
    return rows.select("column", "filled", "total", F.when(F.col("total") > 0, F.col("filled") / F.col("total")).alias("rate"))


def milestone_fill(df: DataFrame, group: str, *columns: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"n_{c}") for c in columns))


def accepted(df: DataFrame, column: str, values: tuple[str, ...], table: str) -> DataFrame:
    """Non-null values that aren't among the accepted ones."""
    return _result(F.count_if(~F.col(column).isin(*values)), f"accepted_{column}", table, df)


def unique(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Keys that occur more than once."""
    return _result(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), f"unique_{'_'.join(keys)}", table)


def parses(df: DataFrame, raw: str, parsed: str, table: str) -> DataFrame:
    return _result(F.count_if(F.col(raw).isNotNull() & (F.trim(raw) != "") & F.col(parsed).isNull()), f"parses_{raw}", table, df)


def drifted(records: DataFrame, table: str, rest: str = "_rest") -> DataFrame:
    """Records with fields or values that their schema has no place for; a record landed before these were kept has none."""
    return _result(F.count_if(F.coalesce(F.size(rest), F.lit(0)) > 0), "drifted", table, records)


def not_empty(df: DataFrame, table: str) -> DataFrame:
    return _result(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), "not_empty", table, df)


def no_fan_out(view: DataFrame, facts: DataFrame, member: str, table: str) -> DataFrame:
    """The view has exactly the facts' rows, and no fact lacks its member."""
    n = facts.agg(F.count(F.lit(1)).alias("facts")).crossJoin(view.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(member).isNull()).alias("lone")))
    bad = F.abs(F.col("rows") - F.col("facts")) + F.col("lone")
    return n.select(F.lit("no_fan_out").alias("check"), F.lit(table).alias("table"), bad.alias("failing_count"), (bad == 0).alias("passed"))


def tally(df: DataFrame, total: str, parts: list[str], table: str) -> DataFrame:
    """Rows whose parts don't add up to the total."""
    return _result(F.count_if(reduce(lambda a, b: a + b, map(F.col, parts)) != F.col(total)), f"tally_{total}", table, df)


def merged(rows: DataFrame, keys: list[str | Column], table: str, name: str | None = None) -> DataFrame:
    """Rows that share their key with an earlier one, so a table by that key has so many rows less. Null parts count as values."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in keys]
    groups = rows.groupBy(*(c.alias(f"_k{i}") for i, c in enumerate(parts))).agg(F.count(F.lit(1)).alias("_rows"))
    return _result(F.sum(F.col("_rows") - 1), f"merged_{name or '_'.join(map(str, keys))}", table, groups)


def list_length(df: DataFrame, total: str, items: str, table: str) -> DataFrame:
    """Rows whose list hasn't as many items as the total says; a missing list has none."""
    return _result(F.count_if(F.coalesce(F.size(items), F.lit(0)) != F.col(total)), f"list_length_{items}", table, df)


def same_set(df: DataFrame, column: str, expected: list, table: str) -> DataFrame:
    """Values that only one of the column and the stated set has."""
    stated = df.sparkSession.createDataFrame([(v,) for v in expected], df.select(column).schema).withColumn("_side", F.lit(1))
    both = df.select(column).withColumn("_side", F.lit(2)).unionByName(stated).where(F.col(column).isNotNull())
    sides = both.groupBy(column).agg(F.sum_distinct("_side").alias("_sides"))
    return _result(sides.where("_sides != 3"), f"same_set_{column}", table)


def reconcile(left: DataFrame, right: DataFrame, table: str, leave_out: tuple[str, ...] = ("source_file", "ingest_date", "loaded_at")) -> DataFrame:
    """Rows, duplicates counted, that only one side has. One aggregation over both, not two EXCEPT ALL."""
    columns = [c for c in left.columns if c not in leave_out]
    signed = left.select(*columns, F.lit(1).alias("_n")).unionByName(right.select(*columns, F.lit(-1).alias("_n")))
    net = signed.groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return net.agg(
        F.lit(table).alias("table"),
        F.coalesce(F.sum(F.greatest(F.col("_n"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


#: Buckets on each of the two levels of a comparison by checksums.
SUMS = 4096


def _sums(rows: DataFrame, *by: Column) -> DataFrame:
    """Count and order-free sum of row hashes by bucket; a map-side sum leaves a row for each task and bucket."""
    named = [b.alias(f"_b{i}") for i, b in enumerate(by)]
    return rows.groupBy(*named).agg(F.count(F.lit(1)).alias("_count"), F.sum(F.col("_hash").cast("decimal(20,0)")).alias("_sum"))


def differing(left: DataFrame, right: DataFrame, keys: list[str], leave_out: tuple[str, ...] = ("source_file", "ingest_date", "loaded_at"), buckets: int = SUMS) -> DataFrame:
    """Rows, without the columns left out, that one side has more often; _n says by how much (right's are negative).

    Both sides are summed by buckets of their keys, then those that disagree by smaller buckets, and only rows of the small buckets
    that still disagree are compared themselves. So tables that agree shuffle sums alone. Up to ``buckets`` numbers are
    broadcast on each level.
    """
    columns = [c for c in left.columns if c not in leave_out]
    key = F.xxhash64(*(F.col(k) for k in keys))
    part = [F.pmod(key, F.lit(buckets)), F.pmod(F.shiftright(key, 32), F.lit(buckets))]
    sides = [df.select(*columns, F.xxhash64(*columns).alias("_hash")) for df in (left, right)]

    def unequal(rows: list[DataFrame], *by: Column) -> DataFrame:
        names = [f"_b{i}" for i in range(len(by))]
        signed = [_sums(r, *by).select(*names, (F.col("_count") * s).alias("_count"), (F.col("_sum") * s).alias("_sum")) for r, s in zip(rows, (1, -1))]
        net = signed[0].unionByName(signed[1]).groupBy(*names).agg(F.sum("_count").alias("_count"), F.sum("_sum").alias("_sum"))
        return net.where("_count <> 0 OR _sum <> 0").select(*names)

    first = unequal(sides, part[0])
    coarse = [r.withColumns({"_b0": part[0], "_b1": part[1]}).join(F.broadcast(first), "_b0", "left_semi") for r in sides]
    # Where most of the first buckets disagree, the second level is as large as the rows: it is joined, not broadcast.
    second = unequal(coarse, F.col("_b0"), F.col("_b1"))
    fine = [r.join(second, ["_b0", "_b1"], "left_semi") for r in coarse]
    signed = fine[0].select(*columns, F.lit(1).alias("_n")).unionByName(fine[1].select(*columns, F.lit(-1).alias("_n")))
    return signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")


def reconcile_by_sums(left: DataFrame, right: DataFrame, keys: list[str], table: str, **settings) -> DataFrame:
    """The counts of ``reconcile``, from ``differing``."""
    net = differing(left, right, keys, **settings)
    return net.agg(
        F.lit(table).alias("table"),
        F.coalesce(F.sum(F.greatest(F.col("_n"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_n"), F.lit(0))), F.lit(0)).alias("only_right"),
    )


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


class QualityError(RuntimeError):
    pass


def fail_on(checks: DataFrame, *names: str) -> DataFrame:
    """Raises if one of the named checks (default: any) failed. The report is a few rows."""
    failed = [r for r in checks.where("NOT passed").collect() if not names or r["check"] in names]
    if failed:
        raise QualityError("; ".join(f"{r['check']} on {r['table']}: {r['failing_count']}" for r in failed))
    return checks
