"""Every query of the catalogue against DuckDB at the smallest size."""

import math

import duckdb
import pytest

from strata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    theirs = [d[0] for d in cursor.description]
    want = sorted(tuple(text(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(theirs) == columns and got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1 and set(e.oracle_sql()) <= set(e.queries())


def test_detail_pages_are_spread_by_a_shuffle(spark, sf_dir):
    """Lines that are small in their file would be broadcast, and the pages read in as few tasks as the orders have files."""
    from strata.plans import catalog

    for query in (catalog.page_quarantine, catalog.page_drift_signal, catalog.entity_page_records):
        plan = query(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        below = plan[plan.index("MapInArrow") :]
        assert "SortMergeJoin" in below and "BroadcastHashJoin [o_orderkey" not in below


def test_star_broadcasts_nothing_as_large_as_the_votes(spark, sf_dir):
    """Of the record's tables only the committees may be broadcast; the orders' and events' own are merged, however small their files."""
    from strata.plans import catalog

    plan = catalog.medallion_vote_record(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    lines = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert all("committee_sk" in x for x in lines), lines
    assert plan.count("SortMergeJoin") >= 5
