"""Code maps: free text to a controlled set, with a tripwire for what the map doesn't know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import _col

UNMAPPED = "UNMAPPED"
#: Status texts by disposition, lower-cased.
DISPOSITIONS = {
    "passed": ("passed", "approved", "adopted", "finally passed", "ordinance enacted", "mayor approved"),
    "filed": ("filed",),
    "killed": ("killed",),
    "in_progress": (
        "30 day rule", "consent agenda", "first reading", "first reading, consent", "mayors office", "new business",
        "pending committee action", "scheduled for committee hearing", "unfinished business-final passage", "pending board action",
        "assigned", "continued", "special order", "in committee",
    ),
}
#: Coarser lifecycle of a disposition.
LIFECYCLES = {"passed": ("passed",), "terminal_other": ("filed", "killed"), "in_progress": ("in_progress",)}
#: Raw vote to tally bucket and label; spelling of negative votes.
VOTES = {"Aye": ("aye", "Aye"), "No": ("nay", "Nay"), "Excused": ("excused", "Excused"), "Absent": ("absent", "Absent")}
VOTE_SPELLING = {"Nay": ("no",)}
#: Coarse buckets of a status as the record producer states them; any other status is "other".
PRODUCER_BUCKETS = {
    "passed": ("passed", "approved", "adopted", "finally passed", "ordinance enacted", "mayor approved"),
    "in_works": (
        "first reading", "in committee", "pending committee action", "new business", "scheduled for committee hearing", "30 day rule",
        "for immediate adoption", "special order", "assigned", "continued", "pending board action",
    ),
}


def code_map(value: str | Column, groups: dict[str, tuple[str, ...]], default: str | None = UNMAPPED, if_null: str | None = None) -> Column:
    """The group whose codes hold the trimmed, lower-cased value; ``if_null`` for null, ``default`` for anything else."""
    plain = F.lower(F.trim(_col(value)))
    out = F.when(plain.isNull(), F.lit(if_null))
    for group, codes in groups.items():
        out = out.when(plain.isin(*codes), F.lit(group))
    return out.otherwise(F.lit(default))


def map_codes(df: DataFrame, column: str, groups: dict[str, tuple[str, ...]], name: str, default: str | None = UNMAPPED, if_null: str | None = None) -> DataFrame:
    """code_map for tables of any size, as a join. A code must belong to one group only."""
    pairs = [(code, group) for group, codes in groups.items() for code in codes]
    twice = sorted({code for code, _ in pairs if sum(c == code for c, _ in pairs) > 1})
    if twice:
        raise ValueError(f"codes of several groups: {', '.join(twice)}")
    lookup = df.sparkSession.createDataFrame(pairs, "_code string, _group string")
    joined = df.join(lookup, F.lower(F.trim(F.col(column))) == F.col("_code"), "left")
    value = F.when(F.col(column).isNull(), F.lit(if_null)).otherwise(F.coalesce("_group", F.lit(default)))
    return joined.withColumn(name, value).drop("_code", "_group")


def disposition(status: str | Column) -> Column:
    return code_map(status, DISPOSITIONS, UNMAPPED, "in_progress")


def lifecycle(disposition_: str | Column) -> Column:
    return code_map(disposition_, LIFECYCLES)


def producer_bucket(status: str | Column) -> Column:
    return F.coalesce(code_map(status, PRODUCER_BUCKETS, "other"), F.lit("other"))


def first_is(position: str | Column, first: str = "primary", rest: str = "co") -> Column:
    return F.when(_col(position) == 0, F.lit(first)).otherwise(F.lit(rest))


def body_scope(body: str | Column) -> Column:
    return F.when(F.lower(_col(body)).contains("committee"), "committee").otherwise("board")


def canonical_vote(value: str | Column) -> Column:
    """One spelling of the negative vote; every other value as it came."""
    return F.when(F.lower(F.trim(_col(value))).isin(*VOTE_SPELLING["Nay"]), F.lit("Nay")).otherwise(_col(value))


def canonical_action(df: DataFrame, column: str, labels: DataFrame, default: str = "OTHER") -> DataFrame:
    """Adds action_code and category from the caller's table (label, action_code, category); the raw label stays."""
    known = labels.select(F.lower(F.trim("label")).alias("_label"), "action_code", "category").dropDuplicates(["_label"])
    joined = df.join(known, F.lower(F.trim(F.col(column))) == F.col("_label"), "left").drop("_label")
    return joined.withColumn("action_code", F.coalesce("action_code", F.lit(default)))
