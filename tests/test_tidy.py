"""Shuffle files that go with their write."""

import glob
import os

from pyspark.sql import functions as F

from strata.sources.sinks import stored


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    local = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: {f for f in glob.glob(f"{local}/**/shuffle_*", recursive=True) if os.path.isfile(f)}
    before = files()
    back = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"{tmp_path}/t")
    assert back.count() == 7
    made = files() - before
    stored_at = [f for f in made if f.endswith(".data")]
    assert len(stored_at) <= 1, stored_at  # that of the count above
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
