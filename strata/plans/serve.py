"""Serving: the denormalised vote record, member tallies with their history, and the nested payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.codes import VOTES
from strata.functions.dates import format_date, in_year
from strata.functions.keys import sk

BUCKETS = tuple(bucket for bucket, _ in VOTES.values())


def denormalise(facts: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """Facts with each (dimension, key) joined left; which of them are broadcast is left to their size at run time."""
    for dimension, key in dimensions:
        facts = facts.join(dimension, key, "left")
    return facts


def member_vote_record(gold: dict[str, DataFrame], people: list[str] | None = None, year: int | None = None) -> DataFrame:
    """18 columns, one row per vote: all votes, or those of stated people and of a year, which are picked before they meet the dimensions."""
    facts = gold["fact_vote"]
    if people is not None:
        facts = facts.where(F.col("person_sk").isin(*(sk(F.lit(p)) for p in people)))
    if year is not None:
        facts = facts.where(in_year("vote_date", year))
    person = gold["dim_person"].select("person_sk", "person_id", F.col("full_name").alias("member_name"))
    matter = gold["dim_matter"].select(
        "matter_sk", "matter_file", "matter_name", "matter_title", "matter_type", F.col("status").alias("matter_status"), "lifecycle", "final_disposition"
    )
    meeting = gold["dim_meeting"].select("meeting_sk", "meeting_date")
    # Those that grow with the votes are merged: by the size of their files they would be broadcast. The widest comes last, so that
    # its columns aren't shuffled again.
    large = [(df.hint("merge"), key) for df, key in ((meeting, "meeting_sk"), (person, "person_sk"), (matter, "matter_sk"))]
    wide = denormalise(facts, *large, (gold["dim_committee"], "committee_sk"))
    return wide.select(
        *("vote_sk", "vote_date", "vote_value", "person_id", "member_name", "matter_file", "matter_name", "matter_title", "matter_type", "matter_status"),
        *("lifecycle", "final_disposition", "committee_name", "meeting_date", "matter_sk", "person_sk", "committee_sk", "meeting_sk"),
    )


def mapped_votes(votes: DataFrame, value: str) -> DataFrame:
    """bucket and label of each vote; unknown values drop out."""
    table = F.broadcast(votes.sparkSession.createDataFrame([(raw, *pair) for raw, pair in VOTES.items()], "_raw string, bucket string, label string"))
    return votes.join(table, votes[value] == F.col("_raw")).drop("_raw")


def tally(rows: DataFrame, keys: list[str], bucket: str, buckets: tuple[str, ...]) -> DataFrame:
    """keys, a count for each bucket, total; most first, then by key."""
    counts = [F.count_if(F.col(bucket) == b).alias(b) for b in buckets]
    return rows.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), *keys)


def history(rows: DataFrame, keys: list[str], date: str, entry: list[str | Column], name: str, most: int | None = None) -> DataFrame:
    """Each key's rows as an array, latest first, unknown dates last; ``most`` keeps only so many, which is then the report: the rest
    is left out before the rows of a key come together.
    """
    age = F.when(F.col(date).isNull(), F.lit(1)).otherwise(0)
    sort = F.struct(age.alias("unknown"), (-F.unix_date(F.col(date).cast("date"))).alias("age"), F.struct(*entry).alias("entry"))
    sorted_rows = rows.select(*keys, sort.alias("_sort"))
    if most:
        latest = Window.partitionBy(*keys).orderBy("_sort")
        sorted_rows = sorted_rows.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= most)
    return sorted_rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_sort")), lambda s: s["entry"]).alias(name))


def date_bounds(date: str) -> Column:
    """'first - last' as one text, 'n/a' without dates."""
    return F.coalesce(F.concat(format_date(F.min(date)), F.lit(" – "), format_date(F.max(date))), F.lit("n/a"))


def rep_payload(votes: DataFrame, districts: dict[str, int], year: int, generated: str) -> DataFrame:
    """The dashboard's document over the deduplicated vote record: one row, for a stated set of members, so bounded in size."""
    members = F.broadcast(votes.sparkSession.createDataFrame(list(districts.items()), "person_id string, district int"))
    own = mapped_votes(votes.join(members, "person_id").where(in_year("vote_date", year)), "vote_value")
    entry = F.struct(F.col("matter_file").alias("file"), F.col("matter_name").alias("name"), F.col("matter_type").alias("type"), F.col("matter_status").alias("status"), format_date("vote_date").alias("date"), F.col("committee_name").alias("body"), F.col("label").alias("vote"))
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    sort = F.struct((-F.unix_date("vote_date")).alias("age"), entry.alias("entry"))
    reps = own.groupBy(F.col("person_id").alias("id"), F.col("district")).agg(
        F.max("member_name").alias("name"), *counts, F.count(F.lit(1)).alias("total"), F.transform(F.array_sort(F.collect_list(sort)), lambda s: s["entry"]).alias("votes"),
        F.min("vote_date").alias("first"), F.max("vote_date").alias("last"),
    )
    rep = F.struct((-F.col("total")).alias("rank"), F.struct("id", "name", "district", *BUCKETS, "total", "votes").alias("rep"))
    ordered = F.transform(F.array_sort(F.collect_list(rep)), lambda r: r["rep"]).alias("reps")
    window = F.coalesce(F.concat(format_date(F.min("first")), F.lit(" – "), format_date(F.max("last"))), F.lit("n/a")).alias("window")
    return reps.agg(F.lit(generated).alias("generated"), window, ordered).select(F.to_json(F.struct("generated", "window", "reps")).alias("payload"))
