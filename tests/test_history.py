"""As-of joins in one sorted pass, history from batches, comparison by sums."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.operators import quality, scd

START = datetime(2026, 1, 1)


def by_join(facts, versions, keys, at):
    """The plain way: a join on the key with the range as a condition."""
    v = versions.select(*(F.col(k).alias(f"_{k}") for k in keys), *[c for c in versions.columns if c not in keys])
    on = [facts[k] == F.col(f"_{k}") for k in keys] + [(facts[at] >= F.col("effective_from")) & (F.col("effective_to").isNull() | (facts[at] < F.col("effective_to")))]
    return facts.join(v, on, "left").drop(*(f"_{k}" for k in keys))


@pytest.mark.parametrize("slice_rows", [100_000, 40])
def test_as_of_equals_the_join(spark, slice_rows):
    rng = random.Random(1)
    at = lambda: START + timedelta(seconds=rng.randrange(2000))
    versions = []
    for k in ("hot", "a", "b", None):
        times = sorted({at() for _ in range(120 if k == "hot" else 4)})
        ends = [*times[1:], None]
        for i, (x, y) in enumerate(zip(times, ends)):
            if rng.random() < 0.8:  # gaps between versions
                versions.append((k, 1, f"v{i}", x, y if y is None or rng.random() < 0.8 else x + (y - x) / 2))
    facts = [(i, rng.choice(["hot"] * 6 + ["a", "b", "none", None]), 1, None if rng.random() < 0.05 else at(), "f") for i in range(600)]
    f = spark.createDataFrame(facts, "id int, k string, k2 int, ts timestamp, _at string")
    v = spark.createDataFrame(versions, "k string, k2 int, value string, effective_from timestamp, effective_to timestamp")
    got = scd.as_of(f, v, ["k", "k2"], "ts", slice_rows=slice_rows)
    want = by_join(f, v, ["k", "k2"], "ts")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    inner = scd.as_of(f, v, ["k", "k2"], "ts", how="inner", slice_rows=slice_rows)
    assert inner.count() == want.where("value IS NOT NULL").count()
    assert scd.as_of(f, v.limit(0), ["k", "k2"], "ts").count() == 600 and scd.as_of(f.limit(0), v, ["k", "k2"], "ts").count() == 0
    with pytest.raises(ValueError):
        scd.as_of(f, v, ["k", "k2"], "ts", how="right")


def test_as_of_of_a_hot_key_is_linear(spark):
    """10^5 facts and 10^4 versions of one key: a join would meet 10^9 pairs."""
    at = F.timestamp_seconds(F.col("id"))
    facts = spark.range(100_000).select("id", F.lit("k").alias("k"), at.alias("ts"))
    versions = spark.range(10_000).select(F.lit("k").alias("k"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") * 10).alias("effective_from"), F.timestamp_seconds(F.col("id") * 10 + 10).alias("effective_to"))
    got = scd.as_of(facts, versions, ["k"], "ts", slice_rows=5_000)
    assert got.where("n = floor(id / 10)").count() == 100_000


def test_batches_give_the_history_of_all_changes(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", "z", None]), START + timedelta(hours=rng.randrange(30)), rng.choice(["A", "B", None]), i) for i in range(150)]
    ddl = "k string, at timestamp, state string, seq int"
    settings = dict(keys=["k"], tracked=["state"], at="at", tie=["seq"])
    want = sorted(map(str, scd.build_scd2(spark.createDataFrame(rows, ddl), **settings).collect()))
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        versions = scd.started(spark.createDataFrame(rows[:20], ddl), **settings)
        for a, b in ((20, 21), (21, 100), (100, 150)):
            versions = spark.createDataFrame(scd.extend_scd2(versions, spark.createDataFrame(rows[a:b], ddl), **settings).collect(), versions.schema)
        assert sorted(map(str, versions.drop("_changes").collect())) == want


def test_sums_tell_where_tables_differ(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice(["a", "b", None]), "f") for _ in range(400)]
    other = rows[3:] + [(1, "new", "g"), (1, "new", "g"), (None, None, "g")]
    left, right = (spark.createDataFrame(x, "k int, v string, source_file string") for x in (rows, other))
    for buckets in (1, 4, quality.SUMS):
        got = quality.reconcile_by_sums(left, right, ["k"], "t", buckets=buckets).first()
        assert tuple(got) == tuple(quality.reconcile(left, right, "t").first())
    assert quality.differing(left, left.withColumn("source_file", F.lit("h")), ["k"]).count() == 0
    found = {(r.k, r.v): r._n for r in quality.differing(left, right, ["k"]).collect()}
    assert found[1, "new"] == -2 and found[None, None] == -1
    assert quality.reconcile_by_sums(left.limit(0), right.limit(0), ["k"], "t").first().only_left == 0
