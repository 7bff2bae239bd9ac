"""Every registered query of the library with its DuckDB equivalent. Each query applies operators to whole tables.

Roles on the shared tables: orders are entities, lineitem rows their nested children, customers and suppliers members,
events a stream of captures, pages raw HTML. Key hashes never appear in results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import codes, dates, keys, text
from strata.operators import flatten, latest, pages, quality, scd, search
from strata.operators.index import TextIndex
from strata.operators.upsert import merge, upsert
from strata.plans import incremental, serve, staging, star
from strata.sources import drift
from strata.sources.buckets import BucketStore
from strata.sources.ingest import read_documents, split_broken
from strata.sources.schemas import table
from strata.sources.sinks import Layers, Snapshots, as_view, entity_files, overwrite, payload, remove, scratch, stored
from strata.streaming.landing import compact, land, land_all, landed
from strata.streaming.log import BatchLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
#: Order codes as this catalogue maps them; P stays unmapped on purpose.
STATUS = {"passed": ("f",), "in_progress": ("o",)}
CUT = "1998-01-01"
#: Event numbers on one calendar page.
SHEET = 200
#: Lines whose pages one task writes and reads.
LINES_PER_TASK = 500_000
#: Days of capture, and the priority of the orders that are captured on the first of them only.
EARLY, LATE, ONCE = "2024-01-01", "2024-01-08", "4-NOT SPECIFIED"


def _micros(at: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _nested(s, d) -> DataFrame:
    """o_orderkey, lines: the lines of each order in a total order."""
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *LINE_ORDER)
    return flatten.nest(lines, ["o_orderkey"], list(LINE_ORDER), "lines")


@query("""
SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_quantity, l.l_extendedprice, CAST(o.o_orderdate AS DATE) AS order_date,
  c.c_name AS member_name, c.c_mktsegment AS segment, p.p_name AS part_name, p.p_brand AS brand, s.s_name AS supplier_name,
  CASE lower(trim(o.o_orderstatus)) WHEN 'f' THEN 'passed' WHEN 'o' THEN 'in_progress' ELSE 'UNMAPPED' END AS disposition
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
def star_view(s, d):
    orders = codes.map_codes(table(s, d, "orders"), "o_orderstatus", STATUS, "disposition").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"), "disposition")
    customer = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("member_name"), F.col("c_mktsegment").alias("segment"))
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("part_name"), F.col("p_brand").alias("brand"))
    supplier = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier_name"))
    facts = table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return serve.denormalise(facts, (orders, "l_orderkey"), (customer, "o_custkey"), (part, "l_partkey"), (supplier, "l_suppkey")).drop("o_custkey", "l_partkey", "l_suppkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    parsed = F.from_json("props", "k bigint")
    return table(s, d, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k")


@query("SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d/%Y') AS order_raw, CAST(o_orderdate AS DATE) AS order_date, 0::BIGINT AS unread FROM orders")
def stage_dates(s, d):
    raw = table(s, d, "orders").select("o_orderkey", dates.format_date("o_orderdate").alias("raw"))
    both = raw.select("o_orderkey", *dates.raw_and_parsed("raw", "order"))
    return both.withColumn("unread", (F.col("order_raw").isNotNull() & F.col("order_date").isNull()).cast("long"))


@query("""
SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) - 1 AS line_seq,
  CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity FROM lineitem""")
def unnest_pos(s, d):
    flat = flatten.unnest(_nested(s, d), "lines", "line", "line_seq")
    return flat.select("o_orderkey", F.col("line_seq").cast("long"), *flatten.fields("line", l_partkey="l_partkey", l_quantity="l_quantity"), F.col("line.l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT o.o_custkey AS c_custkey, l.l_partkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2")
def unnest_two_level(s, d):
    orders = table(s, d, "orders").join(_nested(s, d), "o_orderkey")
    members = flatten.nest(orders, ["o_custkey"], ["o_orderkey", "lines"], "orders")
    outer = flatten.unnest(members, "orders", "o", "order_seq", keep=[F.col("o_custkey").alias("c_custkey")])
    return flatten.unnest(outer, "o.lines", "line").groupBy("c_custkey", F.col("line.l_partkey").alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def unnest_outer_counts(s, d):
    return table(s, d, "orders").select("o_orderkey").join(_nested(s, d), "o_orderkey", "left").select("o_orderkey", text.array_count("lines").cast("long").alias("n_lines"))


@query("SELECT o.o_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def unnest_outer_rows(s, d):
    orders = table(s, d, "orders").select("o_orderkey").join(_nested(s, d), "o_orderkey", "left")
    return flatten.unnest(orders, "lines", "line", outer=True).select("o_orderkey", F.col("line.l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(s, d):
    return latest.latest_wins(table(s, d, "events"), ["user_id"], ("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_events_narrow(s, d):
    rows = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    return latest.latest_narrow(rows, ["user_id"], ("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("""
WITH last AS (SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM last) GROUP BY 1""")
def latest_orders_children(s, d):
    last = latest.latest_wins(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ("o_orderdate", "o_orderkey"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    kept = latest.keep_latest_children(lines, last, ["o_orderkey"], version=())
    return kept.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) = 1""")
def dedup_line_key(s, d):
    one = latest.dedup_by_key(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], list(LINE_ORDER[1:]))
    return one.select("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey", "l_quantity")


@query("""
SELECT u.user_id, f.first_error FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, CAST(min(ts) AS DATE) AS first_error FROM events WHERE lower(event_type) LIKE '%error%' GROUP BY 1) f ON u.user_id = f.user_id""")
def first_error_date(s, d):
    events = table(s, d, "events")
    first = events.where(F.lower("event_type").like("%error%")).groupBy("user_id").agg(F.min("ts").cast("date").alias("first_error"))
    return events.select("user_id").distinct().join(first, "user_id", "left")


@query("""
SELECT p.p_partkey, m.s AS l_suppkey FROM part p
LEFT JOIN (SELECT l_partkey, min(CAST(l_suppkey AS VARCHAR)) AS s FROM lineitem GROUP BY 1) m ON p.p_partkey = m.l_partkey""")
def key_to_min_parent(s, d):
    links = table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return table(s, d, "part").select("p_partkey").join(latest.lowest_parent(links, "p_partkey", "l_suppkey"), "p_partkey", "left")


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus IS NULL THEN 'in_progress' WHEN lower(trim(o_orderstatus)) = 'f' THEN 'passed'
  WHEN lower(trim(o_orderstatus)) = 'o' THEN 'in_progress' ELSE 'UNMAPPED' END AS disposition FROM orders""")
def status_codes(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", codes.code_map("o_orderstatus", STATUS, if_null="in_progress").alias("disposition"))


@query("""
SELECT CASE WHEN o_orderstatus = 'F' THEN 'passed' WHEN o_orderstatus = 'O' THEN 'in_progress' ELSE 'UNMAPPED' END AS lifecycle, count(*) AS n FROM orders GROUP BY 1""")
def lifecycle(s, d):
    mapped = codes.map_codes(table(s, d, "orders"), "o_orderstatus", STATUS, "disposition")
    return mapped.groupBy(codes.lifecycle("disposition").alias("lifecycle")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer) WHERE name IS NOT NULL")
def union_names_dim(s, d):
    return star.distinct_names((table(s, d, "nation"), "n_name"), (table(s, d, "region"), "r_name"), (table(s, d, "customer"), "c_mktsegment"))


@query("""
WITH urgent AS (SELECT DISTINCT c.c_custkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS full_name, 'vote' AS id_source FROM urgent
UNION ALL SELECT CAST(NULL AS VARCHAR), c_name, 'sponsor_only' FROM (SELECT DISTINCT c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM urgent))""")
def two_population_dim(s, d):
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    urgent = table(s, d, "orders").where((F.col("o_orderpriority") == "1-URGENT") & dates.in_year("o_orderdate", 1997)).join(customers, "o_custkey")
    members = urgent.select(F.col("o_custkey").cast("string").alias("c_custkey"), "c_name")
    return star.two_populations(members, customers.select("c_name"), "c_custkey", "c_name").drop("person_sk")


@query("""
WITH r AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem)
SELECT r.l_orderkey, s.s_name AS supplier_name, CASE WHEN min(pos) = 0 THEN 'primary' ELSE 'co' END AS role FROM r LEFT JOIN supplier s ON r.l_suppkey = s.s_suppkey GROUP BY 1, 2""")
def first_is_primary_bridge(s, d):
    flat = flatten.unnest(_nested(s, d), "lines", "line", "pos").select(F.col("o_orderkey").alias("l_orderkey"), "pos", F.col("line.l_suppkey").alias("s_suppkey"))
    named = flat.join(table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("supplier_name")), "s_suppkey", "left")
    rows = named.select("l_orderkey", "supplier_name", codes.first_is("pos").alias("role"), "pos")
    return latest.dedup_by_key(rows, ["l_orderkey", "supplier_name"], ["pos"]).drop("pos")


@query("""
SELECT count(DISTINCT concat_ws('|', l_orderkey, l_linenumber, l_partkey)) AS natural_keys, count(DISTINCT concat_ws('|', l_orderkey, l_linenumber, l_partkey)) AS surrogate_keys,
  0::BIGINT AS null_keys, count(*) FILTER (WHERE l_quantity > 45) AS strict_nulls FROM lineitem""")
def sk_properties(s, d):
    lines = table(s, d, "lineitem").withColumn("q", F.when(F.col("l_quantity") <= 45, F.col("l_suppkey")))
    natural = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")))
    return lines.agg(
        F.countDistinct(natural).alias("natural_keys"),
        F.countDistinct(keys.sk("l_orderkey", "l_linenumber", "l_partkey")).alias("surrogate_keys"),
        F.count_if(keys.sk("l_orderkey", "q").isNull()).alias("null_keys"),
        F.count_if(keys.sk_strict("l_orderkey", "q").isNull()).alias("strict_nulls"),
    )


@query("""
WITH k AS (SELECT CASE WHEN l_quantity > 45 THEN concat_ws('|', l_orderkey, l_linenumber) ELSE CAST(l_suppkey AS VARCHAR) END AS k, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
SELECT k AS natural_key, CAST(min(l_shipdate) AS DATE) AS first_date FROM k GROUP BY 1""")
def fallback_key_fact(s, d):
    lines = table(s, d, "lineitem").withColumn("history", F.when(F.col("l_quantity") <= 45, F.col("l_suppkey").cast("string")))
    keyed = lines.withColumns({"_sk": keys.coalesced_key("history", "l_orderkey", "l_linenumber"), "natural_key": F.coalesce("history", F.concat_ws("|", "l_orderkey", "l_linenumber"))})
    return latest.dedup_by_key(keyed.select("_sk", "natural_key", "l_shipdate"), ["_sk"], ["l_shipdate", "natural_key"]).select("natural_key", F.col("l_shipdate").cast("date").alias("first_date"))


@query("""
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS aye, count(*) FILTER (WHERE o_orderstatus = 'O') AS nay, count(*) FILTER (WHERE o_orderstatus = 'P') AS excused,
  count(*) AS total FROM orders GROUP BY 1""")
def member_tally(s, d):
    bucket = codes.code_map("o_orderstatus", {"aye": ("f",), "nay": ("o",), "excused": ("p",)}, None)
    return serve.tally(table(s, d, "orders").withColumn("bucket", bucket), ["o_custkey"], "bucket", ("aye", "nay", "excused"))


@query("""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS latest_orders FROM
  (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5) GROUP BY 1""")
def member_history_topk(s, d):
    got = serve.history(table(s, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"], "h", most=5)
    return got.select("o_custkey", F.array_join(F.transform("h", lambda e: e["o_orderkey"].cast("string")), ",").alias("latest_orders"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def oldest_orders_topk(s, d):
    return table(s, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"), "o_totalprice")


@query("SELECT o_orderpriority, strftime(min(o_orderdate), '%-m/%-d/%Y') || ' – ' || strftime(max(o_orderdate), '%-m/%-d/%Y') AS bounds FROM orders GROUP BY 1")
def window_bounds(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(serve.date_bounds("o_orderdate").alias("bounds"))


@query("""
SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS n_final_date, count(CASE WHEN o_totalprice > 300000 THEN o_orderdate END) AS n_large_date FROM orders GROUP BY 1""")
def milestone_fill(s, d):
    orders = table(s, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("final_date"), F.when(F.col("o_totalprice") > 300000, F.col("o_orderdate")).alias("large_date"))
    return quality.milestone_fill(orders, "o_orderpriority", "final_date", "large_date")


@query("""
SELECT 'final_date' AS "column", count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled, count(*) AS total, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*)::DOUBLE, 9) AS rate FROM orders""")
def fk_fill_rate(s, d):
    orders = table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("final_date"))
    return quality.fill_rate(orders, "final_date").withColumn("rate", F.round("rate", 9))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_orderstatus")
def count_by_code_desc(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderstatus")


def _check_sql(name: str, tab: str, n: str) -> str:
    return f"SELECT '{name}' AS \"check\", '{tab}' AS \"table\", CAST(n AS BIGINT) AS failing_count, n = 0 AS passed FROM ({n})"


@query(_check_sql("orphan_l_suppkey", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def dq_orphans(s, d):
    return quality.orphans(table(s, d, "lineitem"), "l_suppkey", table(s, d, "supplier").where("s_acctbal > 0"), "s_suppkey", "lineitem")


@query(_check_sql("unmapped_disposition", "orders", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"))
def dq_unmapped(s, d):
    return quality.unmapped(codes.map_codes(table(s, d, "orders"), "o_orderstatus", STATUS, "disposition"), "disposition", "orders")


@query(_check_sql("collision_p_name", "part", "SELECT count(*) AS n FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1)"))
def dq_collisions(s, d):
    return quality.collisions(table(s, d, "part"), "p_name", "p_partkey", "part")


@query(_check_sql("accepted_o_orderstatus", "orders", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"))
def dq_accepted(s, d):
    return quality.accepted(table(s, d, "orders"), "o_orderstatus", ("F", "O"), "orders")


@query(_check_sql("unique_l_orderkey_l_linenumber", "lineitem", "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"))
def dq_unique(s, d):
    return quality.unique(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


@query(_check_sql("parses_raw", "orders", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'"))
def dq_parse(s, d):
    raw = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("soon")).otherwise(dates.format_date("o_orderdate"))
    orders = table(s, d, "orders").select(raw.alias("raw"))
    return quality.parses(orders.withColumn("parsed", dates.parse_date("raw")), "raw", "parsed", "orders")


@query(_check_sql("not_empty", "events", "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS n FROM events"))
def dq_nonempty(s, d):
    return quality.not_empty(table(s, d, "events"), "events")


@query(_check_sql("no_fan_out", "order_lines", """
  SELECT abs(count(*) - (SELECT count(*) FROM orders)) + count(*) FILTER (WHERE l_orderkey IS NULL) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"""))
def dq_no_fan_out(s, d):
    """A view that does fan out: orders by their lines, some of which have none."""
    orders, lines = table(s, d, "orders"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("member"))
    return quality.no_fan_out(orders.join(lines, F.col("o_orderkey") == F.col("member"), "left"), orders, "member", "order_lines")


@query(_check_sql("tally_total", "member_tally", "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'P'"))
def dq_tally(s, d):
    """One bucket is left out of the parts, so members with such votes fail."""
    return quality.tally(member_tally(s, d), "total", ["aye", "nay"], "member_tally")


@query(_check_sql("list_length_h", "member_history", "SELECT count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 5)"))
def dq_list_length(s, d):
    """Histories cut at five entries beside the whole number of orders."""
    orders = table(s, d, "orders")
    cut = serve.history(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"], "h", most=5)
    return quality.list_length(cut.join(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total")), "o_custkey"), "total", "h", "member_history")


@query(_check_sql("same_set_n_regionkey", "nation", "SELECT count(*) AS n FROM (SELECT DISTINCT n_regionkey AS k FROM nation WHERE n_regionkey NOT IN (1, 2, 3, 77) UNION ALL SELECT k FROM (VALUES (1), (2), (3), (77)) v(k) WHERE k NOT IN (SELECT n_regionkey FROM nation))"))
def dq_same_set(s, d):
    return quality.same_set(table(s, d, "nation"), "n_regionkey", [1, 2, 3, 77], "nation")


@query(_check_sql("merged_l_orderkey_l_linenumber", "lineitem", "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n"))
def dq_merged_keys(s, d):
    return quality.merged(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


@query(_check_sql("unresolved_s_suppkey", "lineitem", "SELECT count(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE s_suppkey IS NULL"))
def dq_unresolved(s, d):
    some = table(s, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_suppkey").cast("string").alias("full_name"))
    lines = table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("sponsor"))
    return quality.unresolved(latest.conform(lines, "sponsor", some, "full_name", "s_suppkey"), "s_suppkey", "lineitem")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 49 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_discount < 0.09)
SELECT 'lineitem' AS "table", (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right""")
def reconcile_two_way(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    altered = lines.where("l_discount < 0.09").withColumn("l_quantity", F.when(F.col("l_quantity") > 49, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return quality.reconcile(lines.drop("l_discount"), altered.drop("l_discount"), "lineitem")


@query(ORACLE_SQL["reconcile_two_way"].replace("'lineitem' AS", "'lines' AS"))
def reconcile_by_sums(s, d):
    """The same comparison by sums of hashes; rows meet only where the sums disagree."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    altered = lines.where("l_discount < 0.09").withColumn("l_quantity", F.when(F.col("l_quantity") > 49, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return quality.reconcile_by_sums(lines.drop("l_discount"), altered.drop("l_discount"), ["l_orderkey"], "lines")


@query("SELECT o_orderkey, o_orderstatus, 1::BIGINT AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'F', -1 FROM orders WHERE o_orderstatus = 'P'")
def differing_rows(s, d):
    """Which rows of two captures of the orders differ: those with status P in the first became F in the second."""
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("2024-01-01").alias("ingest_date"))
    later = orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
    return quality.differing(orders, later, ["o_orderkey"]).withColumnRenamed("_n", "n")


def _upsert_sides(s, d):
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    target = orders.where(F.col("o_orderdate") < "1998-07-01").drop("o_orderdate")
    late = orders.where(F.col("o_orderdate") >= "1998-01-01")
    source = late.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("o_orderdate")
    return target, source


_UPSERT = """
WITH t AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01'), s AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(t.o_orderstatus, s.o_orderstatus) AS o_orderstatus, {price} AS o_totalprice,
  CASE WHEN t.o_orderkey IS NULL THEN 'inserted' WHEN {changed} THEN 'updated' ELSE 'unchanged' END AS action FROM t FULL OUTER JOIN s ON t.o_orderkey = s.o_orderkey"""


@query(_UPSERT.format(price="coalesce(s.p, t.o_totalprice)", changed="s.p <> t.o_totalprice"))
def upsert_update(s, d):
    return merge(*_upsert_sides(s, d), ["o_orderkey"]).withColumnRenamed("_action", "action")


@query(_UPSERT.format(price="coalesce(t.o_totalprice, s.p)", changed="FALSE"))
def upsert_insert_only(s, d):
    return merge(*_upsert_sides(s, d), ["o_orderkey"], update=False).withColumnRenamed("_action", "action")


def _versions(s, d):
    return scd.build_scd2(table(s, d, "events"), ["user_id"], ["event_type"], "ts", tie=["event_id"])


_SCD = """
WITH c AS (SELECT user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events),
v AS (SELECT user_id, event_type, ts AS f, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t FROM c WHERE was IS NULL OR was <> event_type)"""


@query(_SCD + "SELECT user_id, event_type, epoch_us(f) AS from_us, epoch_us(t) AS to_us, t IS NULL AS is_current FROM v")
def scd2_build(s, d):
    v = _versions(s, d)
    return v.select("user_id", "event_type", _micros("effective_from").alias("from_us"), _micros("effective_to").alias("to_us"), "is_current")


@query(_SCD + "SELECT e.event_id, v.event_type AS valid_type, epoch_us(v.f) AS from_us FROM events e LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.f AND (v.t IS NULL OR e.ts < v.t)")
def asof_join(s, d):
    facts = table(s, d, "events").select("event_id", "user_id", "ts")
    return scd.as_of(facts, _versions(s, d), ["user_id"], "ts").select("event_id", F.col("event_type").alias("valid_type"), _micros("effective_from").alias("from_us"))


@query(_SCD + "SELECT user_id, event_type, epoch_us(f) AS from_us, epoch_us(t) AS to_us, t IS NULL AS is_current FROM v")
def scd2_batches(s, d):
    """The same history from three batches that overlap in time: each brings late changes to the versions stored before."""
    root, settings = scratch(s, "history"), dict(keys=["user_id"], tracked=["event_type"], at="ts", tie=["event_id"])
    kinds = [("view", "signup"), ("click",), ("purchase", "error")]
    versions = None
    for i, kind in enumerate(kinds):
        batch = table(s, d, "events").where(F.col("event_type").isin(*kind))
        versions = stored(scd.started(batch, **settings) if versions is None else scd.extend_scd2(versions, batch, **settings), f"{root}/{i}")
    return versions.select("user_id", "event_type", _micros("effective_from").alias("from_us"), _micros("effective_to").alias("to_us"), "is_current")


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey WHERE a.n IS NULL OR b.n IS NULL OR a.n <> b.n""")
def snapshot_diff(s, d):
    orders, date = table(s, d, "orders"), F.col("o_orderdate")
    count = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return scd.snapshot_diff(count(orders.where(date < "1996-01-01")), count(orders.where((date >= "1995-07-01") & (date < "1996-07-01"))), ["o_custkey"], ["n"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def open_set(s, d):
    mapped = codes.map_codes(table(s, d, "orders"), "o_orderstatus", STATUS, "disposition")
    return scd.open_set(mapped, codes.lifecycle("disposition"), ("passed", "terminal_other")).select("o_orderkey")


@query("SELECT user_id, event_type, epoch_us(ts) AS at_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(s, d):
    return scd.latest_status(table(s, d, "events"), ["user_id"], "event_type", "ts", "event_id").select("user_id", "event_type", _micros("ts").alias("at_us"))


@query("""
SELECT 'both' AS bounds, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-03-31'
UNION ALL SELECT 'from', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-02-01' UNION ALL SELECT 'to', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-03-31'
UNION ALL SELECT 'none', count(*) FROM orders""")
def date_window(s, d):
    day, a, b = F.col("o_orderdate").cast("date"), "1996-02-01", "1996-03-31"
    named = {"both": (a, b), "from": (a, None), "to": (None, b), "none": (None, None)}
    counts = table(s, d, "orders").agg(*(F.count_if(dates.in_window(day, *w)).alias(k) for k, w in named.items()))
    return counts.unpivot([], list(named), "bounds", "n")


@query("""
WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders),
w AS (SELECT CAST(o_orderdate AS DATE) AS d, s, e FROM orders, b)
SELECT s + CAST(floor((d - s) / 7) * 7 AS INTEGER) AS slice_start, least(s + CAST(floor((d - s) / 7) * 7 AS INTEGER) + 6, e) AS slice_end, count(*) AS n FROM w GROUP BY 1, 2""")
def weekly_slices(s, d):
    days = table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    weeks = dates.weekly_slices(days.agg(F.min("day").alias("start"), F.max("day").alias("end")))
    each = weeks.select("slice_start", "slice_end", F.explode(F.sequence("slice_start", "slice_end")).alias("day"))
    return each.join(days, "day").groupBy("slice_start", "slice_end").agg(F.sum("n").alias("n"))


@query("""
SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS valid_from, CASE WHEN CAST(max(o_orderdate) AS DATE) <= DATE '2001-01-01' THEN CAST(max(o_orderdate) AS DATE) END AS valid_to,
  CAST(max(o_orderdate) AS DATE) > DATE '2001-01-01' AS is_current FROM orders GROUP BY 1""")
def tenure_open_end(s, d):
    spans = table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    return scd.tenures(spans, "start", "end", "2001-01-01").drop("start", "end")


@query("""
SELECT p_partkey, trim(split_part(p_name, ' ', 1)) || '|' || p_type || '|' || p_brand AS names, 3::BIGINT AS n FROM part""")
def split_names(s, d):
    raw = F.concat(F.split("p_name", " ")[0], F.lit("; "), F.col("p_type"), F.lit(", , and "), F.col("p_brand"), F.lit(";"))
    got = table(s, d, "part").select("p_partkey", text.split_names(raw).alias("x"))
    return got.select("p_partkey", F.array_join("x", "|").alias("names"), F.size("x").cast("long").alias("n"))


@query("SELECT s_suppkey, s_name AS location, CASE s_suppkey % 3 WHEN 0 THEN 'Recessed' WHEN 1 THEN 'Closed Session' END AS subtype FROM supplier")
def suffix_split(s, d):
    ending = F.element_at(F.array(F.lit(", RECESSED Meeting"), F.lit("  closed session meeting "), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    place, kind = text.split_suffix(F.concat("s_name", ending))
    return table(s, d, "supplier").select("s_suppkey", place.alias("location"), kind.alias("subtype"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_name END AS name FROM part")
def text_norm(s, d):
    raw = F.when(F.col("p_size") > 40, F.lit("  \n ")).otherwise(F.concat(F.lit(" \t"), F.replace("p_name", F.lit(" "), F.lit("   \n")), F.lit(" ")))
    return table(s, d, "part").select("p_partkey", text.normalised(raw).alias("name"))


@query("SELECT event_id, CAST(event_id % 50 + 1 AS BIGINT) AS pages, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id * 1000 END AS items FROM events")
def pager_numbers(s, d):
    n = F.col("event_id") % 50
    label = F.when(n == 0, F.lit("no pager")).otherwise(F.concat(F.lit("Page 1 of "), (n + 1).cast("string"), F.lit(", items 1 to 100 of "), F.format_number(F.col("user_id") * 1000, 0), F.lit(".")))
    total, items = text.pager(label)
    return table(s, d, "events").select("event_id", total.cast("long").alias("pages"), items.cast("long").alias("items"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '[?&]page=([0-9]+)', 1) = '' THEN NULL ELSE regexp_extract(url, '[?&]page=([0-9]+)', 1) END AS id FROM pages")
def url_id(s, d):
    return table(s, d, "pages").select("page_id", keys.url_id("url", "page").alias("id"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def url_first_seen(s, d):
    hosts = table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id")
    return latest.first_seen(hosts, "host", ["page_id"], keep_order=False)


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '/([0-9]+)', 1) NOT IN (SELECT regexp_extract(url, '/([0-9]+)', 1) FROM pages WHERE url LIKE 'https:%')")
def resume_anti(s, d):
    found = table(s, d, "pages").select("page_id", "url", F.regexp_extract("url", "/([0-9]+)", 1).alias("id"))
    return latest.not_landed(found, found.where(F.col("url").startswith("https:")), "id").select("page_id", "url")


_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<!--.*?-->', '', 'g')"


@query(f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, a[i] AS href FROM (SELECT page_id, regexp_extract_all({_VISIBLE}, '<a [^>]*href="([^"]*)"', 1) AS a FROM pages) t, (SELECT unnest(range(1, 400)) AS i) r WHERE i <= len(a)""")
def page_links(s, d):
    return pages.anchors(table(s, d, "pages")).select("page_id", F.col("pos").cast("long"), "href")


@query(f"SELECT page_id, regexp_extract({_VISIBLE}, '(?s)<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all({_VISIBLE}, '<h[1-6]>')) AS BIGINT) AS n_headings FROM pages")
def page_headings(s, d):
    h = pages.visible("html")
    return table(s, d, "pages").select("page_id", F.regexp_extract(h, r"(?s)<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit("<h[1-6]>")).cast("long").alias("n_headings"))


@query(rf"""
SELECT page_id, regexp_extract({_VISIBLE}, '<html lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all({_VISIBLE}, '(?s)<li>(.*?)</li>', 1)) AS BIGINT) AS n_items,
  regexp_replace(regexp_extract({_VISIBLE}, '(?s)<li>(.*?)</li>', 1), '<[^>]*>', '', 'g') AS first_item FROM pages""")
def page_sections(s, d):
    spec = pages.RecordSpec({"lang": '<html lang="([^"]*)"'})
    got = pages.extract_records(table(s, d, "pages"), spec)
    return got.select("page_id", F.col("header.lang").alias("lang"), F.size("items").cast("long").alias("n_items"), F.try_element_at("items", F.lit(1)).alias("first_item"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""
SELECT doc_id, 'function' AS tag FROM documents WHERE list_contains({_TOKENS}, 'the') OR list_contains({_TOKENS}, 'les')
UNION ALL SELECT doc_id, 'insult' FROM documents WHERE list_contains({_TOKENS}, 'idiot') OR list_contains({_TOKENS}, 'loser') OR list_contains({_TOKENS}, 'worthless')""")
def keyword_tags(s, d):
    return search.keyword_tags(table(s, d, "documents"), "doc_id", "text", {"function": ("the", "les"), "insult": ("idiot", "loser", "worthless")})


@query(f"""
WITH b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
p AS (SELECT DISTINCT 'opening' AS tag, array_to_string(w[1:2], ' ') AS phrase, len(w[1:2]) AS n FROM b WHERE len(w) > 0
  UNION SELECT DISTINCT 'sentence', array_to_string(w[1:5], ' '), len(w[1:5]) FROM b WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT r, doc_id, i - 1 AS i, w[i:i+4] AS w FROM t),
m AS (SELECT s.r, s.doc_id, s.i, p.tag, p.n FROM s, (VALUES (1), (2), (3), (4), (5)) v(n), p WHERE p.n = v.n AND len(s.w) >= v.n AND array_to_string(s.w[1:v.n], ' ') = p.phrase)
SELECT doc_id, tag, CAST(count(*) AS BIGINT) AS n, min(i) AS first FROM (SELECT *, rank() OVER (PARTITION BY r, i ORDER BY n DESC) AS k FROM m) WHERE k = 1 GROUP BY doc_id, tag""")
def phrase_tags(s, d):
    """Where documents take up the first two words of a benchmark item, and where the first five: phrases from a table, the longest one at a word."""
    words = search.tokens(F.col("text"))
    first = lambda tag, n: table(s, d, "benchmark").select(F.lit(tag).alias("tag"), F.concat_ws(" ", F.slice(words, 1, n)).alias("phrase"))
    return search.phrase_tags(table(s, d, "documents"), "doc_id", "text", first("opening", 2).unionByName(first("sentence", 5)))


@query(f"""
SELECT doc_id, CAST(len(list_filter({_TOKENS}, lambda x: x = 'license' OR x = 'licensed')) AS BIGINT) AS score FROM documents
WHERE len(list_filter({_TOKENS}, lambda x: x = 'license' OR x = 'licensed')) > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def keyword_search(s, d):
    return search.keyword_search(table(s, d, "documents"), "doc_id", "text", ["license", "licensed"], 25)


@query(f"""
WITH w AS (SELECT doc_id AS id, coalesce({_TOKENS}, []) AS words FROM documents),
d AS (SELECT id, len(words) AS dl, len(list_filter(words, lambda x: x = 'license')) AS a, len(list_filter(words, lambda x: x = 'the')) AS b FROM w),
s AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM d),
r AS (SELECT id, coalesce(CASE WHEN a > 0 THEN ln(1 + (n - na + 0.5) / (na + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) END, 0) + coalesce(CASE WHEN b > 0 THEN ln(1 + (n - nb + 0.5) / (nb + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean)) END, 0) AS score FROM d, s WHERE a + b > 0)
SELECT id, round(score, 6) AS score FROM r ORDER BY round(score, 9) DESC, id LIMIT 20""")
def search_bm25(s, d):
    """The twenty best documents for two words, from an index of two segments."""
    found = TextIndex(s, scratch(s, "index"))
    docs = table(s, d, "documents").select("doc_id", "text", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("english"))
    for english in (True, False):
        found.add(docs.where(F.col("english") == english), "doc_id", "text")
    return found.search(["License", "the"], 20).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, sha256(text) <> sha256(CASE WHEN lang = 'fr' THEN text || ' ' ELSE text END) AS changed FROM documents")
def text_change(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    new = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return scd.text_changes(docs.drop("lang"), new.drop("lang"), "doc_id", "text")


@query("SELECT c_custkey, coalesce(CASE WHEN s.s_acctbal > 5000 THEN s.s_name END, c_name) AS name FROM customer LEFT JOIN supplier s ON c_custkey = s_suppkey")
def precedence_fill(s, d):
    header = table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).otherwise(F.lit(" ")).alias("header"))
    return table(s, d, "customer").join(header, "c_custkey", "left").select("c_custkey", text.first_filled("header", "c_name").alias("name"))


@query("""
SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name IN ('ASIA', 'EUROPE') GROUP BY 1""")
def membership_filter(s, d):
    members = table(s, d, "nation").join(table(s, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(s, d, "customer").join(members, "c_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o.o_orderkey, min(e.event_id) AS event_id FROM orders o JOIN events e ON o.o_custkey = e.user_id AND CAST(e.props->>'k' AS BIGINT) = o.o_orderkey % 100 GROUP BY 1""")
def cross_slice_link(s, d):
    events = table(s, d, "events").select(F.col("user_id").alias("o_custkey"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("k"))
    return orders.join(events, ["o_custkey", "k"]).groupBy("o_orderkey").agg(F.min("event_id").alias("event_id"))


def _captures(rows: DataFrame, again: Column) -> DataFrame:
    """Each row as an early capture, and as a late one where ``again`` holds; one pass over the rows makes both."""
    both = F.when(again, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return rows.withColumn("late", F.explode(both)).withColumn("day", F.when(F.col("late"), LATE).otherwise(EARLY))


def _captured() -> list[Column]:
    return [F.concat("day", F.lit(".json")).alias("source_file"), F.col("day").cast("date").alias("ingest_date"), F.col("day").cast("timestamp_ntz").alias("loaded_at")]


def _matters(s, d) -> DataFrame:
    """Bronze records out of orders and all their lines: an early capture, and a later one for all but those of one priority. The early
    ones have a body and votes of their own, so children of a capture that lost would show.
    """
    us = lambda c: dates.format_date(c)
    lines = table(s, d, "lineitem").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    vote = F.when(F.col("l_returnflag") == "R", "No").when(F.col("l_returnflag") == "A", "Aye").otherwise("Absent")
    lines = lines.select("l_orderkey", *LINE_ORDER, us("l_shipdate").alias("date"), F.concat(F.lit("Committee "), "l_returnflag").alias("body"), F.col("l_linestatus").alias("action"), "s_name", vote.alias("vote"))
    fields = ["date", "body", "action", "l_suppkey", "s_name", "vote", "l_quantity"]
    nested = flatten.nest(lines, ["l_orderkey"], fields, "lines", order=list(LINE_ORDER)).withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name").hint("merge"), "o_custkey", "left").join(nested.hint("merge"), "o_orderkey", "left")

    late = F.col("late")

    def action(line, i):
        history = F.when(line["l_quantity"] <= 45, F.concat_ws("-", "o_orderkey", i))
        value = F.when(late, line["vote"]).otherwise("Excused")
        votes = F.array(F.struct(line["l_suppkey"].cast("string").alias("person_id"), line["s_name"].alias("person_name"), value.alias("vote_value")))
        body = F.when(late, line["body"]).otherwise("Early Committee")
        return F.struct(line["date"].alias("date"), body.alias("body"), line["action"].alias("action"), F.lit("Pass").alias("result"), history.alias("history_id"), F.lit(None).cast("string").alias("history_url"), votes.alias("votes"))

    status = F.when(~late, "New Business").when(F.col("o_orderstatus") == "F", " Passed").when(F.col("o_orderstatus") == "O", "30 Day Rule").otherwise("Odd")
    base = [F.col("o_orderkey").cast("string").alias("file_number"), F.concat(F.lit("https://records.example/Detail.aspx?ID="), "o_orderkey").alias("detail_url"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), F.lit("t").alias("title"), F.col("o_orderpriority").alias("type")]
    rest = [us("o_orderdate").alias("introduced"), *(F.lit(None).cast("string").alias(c) for c in ("on_agenda", "final_action", "enactment_date", "enactment_number")), F.lit("Board").alias("in_control"), F.array("c_name", F.lit("Mayor")).alias("sponsors"), F.array().cast("array<string>").alias("related_files"), F.array(F.struct(F.lit("Leg Ver1").alias("name"), F.concat(F.lit("https://records.example/View.ashx?ID="), F.col("o_orderkey") % 100).alias("url"))).alias("attachments")]
    captures = _captures(orders, F.col("o_orderpriority") != ONCE)
    return captures.select(*base, status.alias("status"), *rest, F.transform("lines", action).alias("actions"), *_captured())


def _meetings(s, d) -> DataFrame:
    """Bronze meetings out of all events: an early capture that links the second action of the order that has the event's number, and
    for all but errors a later one that links the first. Each has a document.
    """
    captures, none, late = _captures(table(s, d, "events"), F.col("event_type") != "error"), F.lit(None).cast("string"), F.col("late")
    number, link = F.col("event_id").cast("string"), F.concat(F.col("event_id").cast("string"), F.when(late, "-0").otherwise("-1"))
    item = F.struct(F.lit(0).cast("long").alias("item_seq"), number.alias("matter_file"), none.alias("matter_url"), *(none.alias(c) for c in ("agenda_number", "matter_name", "matter_type", "matter_status", "title", "action_raw", "action_result")), link.alias("history_id"), none.alias("history_url"))
    file = F.col("event_id") % 150 + F.when(late, 0).otherwise(200)
    document = F.struct(F.lit("meeting_agenda").alias("document_source"), F.lit("Agenda").alias("document_title"), F.concat(F.lit("https://records.example/View.ashx?ID="), file).alias("document_url"), none.alias("body_text"))
    return captures.select(number.alias("meeting_id"), none.alias("event_guid"), F.lit("Committee R").alias("body_name"), dates.format_date("ts").alias("meeting_date"), *(none.alias(c) for c in ("meeting_time", "location", "meeting_subtype", "agenda_status", "minutes_status", "agenda_url", "minutes_url", "video_clip_id")), F.array(document).alias("documents"), F.array(item).alias("agenda_items"), *_captured())


def _bronze(s, d, root: str) -> dict[str, DataFrame]:
    return {"matters": stored(_matters(s, d), f"{root}/matters"), "meetings": stored(_meetings(s, d), f"{root}/meetings")}


def _gold(s, d):
    """The latest records are written once; all tables of the latest captures are read from them as they are needed."""
    root = scratch(s, "medallion")
    bronze = {"matters": _matters(s, d), "meetings": _meetings(s, d)}
    return star.build_gold(star.of_records(star.latest_records(bronze, store=lambda name, df: stored(df, f"{root}/{name}"))))


_RECORDS = """
WITH act AS (SELECT l_orderkey, l_suppkey, l_linestatus, CAST(l_shipdate AS DATE) AS day, l_quantity, o_orderpriority = '4-NOT SPECIFIED' AS early, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) - 1 AS seq,
    CAST(l_orderkey AS VARCHAR) AS matter_file, CASE WHEN l_quantity <= 45 THEN l_orderkey || '-' || seq END AS history_id, CASE WHEN early THEN 'Early Committee' ELSE 'Committee ' || l_returnflag END AS body,
    CASE WHEN early THEN 'Excused' WHEN l_returnflag = 'R' THEN 'No' WHEN l_returnflag = 'A' THEN 'Aye' ELSE 'Absent' END AS vote_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
meet AS (SELECT event_id || CASE WHEN event_type = 'error' THEN '-1' ELSE '-0' END AS history_id, CAST(ts AS DATE) AS meeting_date, event_id % 150 + CASE WHEN event_type = 'error' THEN 200 ELSE 0 END AS document FROM events),
vote AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY concat_ws('|', history_id, l_suppkey) ORDER BY day, matter_file, seq) = 1),
state AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'New Business' WHEN o_orderstatus = 'F' THEN ' Passed' WHEN o_orderstatus = 'O' THEN '30 Day Rule' ELSE 'Odd' END AS status FROM orders)
"""


_VOTE_RECORD = _RECORDS + """
SELECT v.day AS vote_date, v.vote_value, CAST(v.l_suppkey AS VARCHAR) AS person_id, s.s_name AS member_name, v.matter_file, 'Order ' || v.matter_file AS matter_name, 't' AS matter_title, o.o_orderpriority AS matter_type,
  o.status AS matter_status, CASE o.status WHEN ' Passed' THEN 'passed' WHEN 'Odd' THEN 'UNMAPPED' ELSE 'in_progress' END AS lifecycle,
  CASE o.status WHEN ' Passed' THEN 'passed' WHEN 'Odd' THEN 'UNMAPPED' ELSE 'in_progress' END AS final_disposition, v.body AS committee_name, m.meeting_date
FROM vote v LEFT JOIN supplier s ON v.l_suppkey = s.s_suppkey LEFT JOIN state o ON v.l_orderkey = o.o_orderkey LEFT JOIN meet m ON v.history_id = m.history_id"""


@query(_VOTE_RECORD)
def medallion_vote_record(s, d):
    return serve.member_vote_record(_gold(s, d)).drop("vote_sk", "matter_sk", "person_sk", "committee_sk", "meeting_sk")


@query(_VOTE_RECORD)
def incremental_vote_record(s, d):
    """The star after two weeks, each of which reads its own records and the latest ones of the week before."""
    root = scratch(s, "weeks")
    bronze, records = _bronze(s, d, root), None
    for week in (EARLY, LATE):
        new = {zone: df.where(F.col("ingest_date") == week) for zone, df in bronze.items()}
        records = star.latest_records(new, records, lambda name, df: stored(df, f"{root}/{week}/{name}"))  # noqa: B023
    return serve.member_vote_record(star.build_gold(star.of_records(records))).drop("vote_sk", "matter_sk", "person_sk", "committee_sk", "meeting_sk")


#: Of the three weeks of changes: orders of this priority have their first capture come in last, those of this status and events of this
#: type are withdrawn last.
OVERDUE, WITHDRAWN_STATUS, WITHDRAWN_EVENT = "5-LOW", "P", "signup"

_WEEKS = _RECORDS.replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')").replace("AS document FROM events)", "AS document, CAST(event_id AS VARCHAR) AS meeting_id FROM events WHERE event_type <> 'signup')").replace("AS status FROM orders)", "AS status, CAST(o_orderkey AS VARCHAR) AS matter_file, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')")


@query(_WEEKS + """,
action AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY coalesce(history_id, concat_ws('|', matter_file, day, l_linestatus)) ORDER BY day, matter_file, seq) = 1),
url AS (SELECT o_orderkey % 100 AS n, 'Leg Ver1' AS title FROM state UNION ALL SELECT document, 'Agenda' FROM meet)
SELECT 'matter' AS kind, matter_file AS a, status AS b, CASE status WHEN ' Passed' THEN 'passed' WHEN 'Odd' THEN 'UNMAPPED' ELSE 'in_progress' END AS c, (SELECT CAST(min(day) AS VARCHAR) FROM act WHERE act.l_orderkey = state.o_orderkey) AS d, NULL AS e, count(*) AS n FROM state GROUP BY ALL
UNION ALL SELECT 'committee', name, NULL, NULL, NULL, NULL, 1 FROM (SELECT body AS name FROM act UNION SELECT 'Committee R' FROM meet UNION SELECT 'Board' FROM state)
UNION ALL SELECT 'person', CAST(l_suppkey AS VARCHAR), max(s_name), 'vote', NULL, NULL, 1 FROM act LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey
UNION ALL SELECT 'person', NULL, name, 'sponsor_only', NULL, NULL, 1 FROM (SELECT c_name AS name FROM state UNION SELECT 'Mayor' FROM state) WHERE name IS NOT NULL
UNION ALL SELECT 'document', CAST(n AS VARCHAR), max(title), NULL, NULL, NULL, 1 FROM url GROUP BY n
UNION ALL SELECT 'meeting', meeting_id, 'Committee R', CAST(meeting_date AS VARCHAR), NULL, NULL, 1 FROM meet
UNION ALL SELECT 'action', coalesce(x.history_id, ''), x.matter_file || '/' || x.l_linestatus, CAST(x.day AS VARCHAR), x.body, m.meeting_id, count(*) FROM action x LEFT JOIN meet m ON x.history_id = m.history_id GROUP BY ALL
UNION ALL SELECT 'vote', coalesce(v.history_id, ''), v.matter_file || '/' || v.l_suppkey || '/' || v.vote_value, CAST(v.day AS VARCHAR), v.body, m.meeting_id, count(*) FROM vote v LEFT JOIN meet m ON v.history_id = m.history_id GROUP BY ALL
UNION ALL SELECT 'sponsor', matter_file, c_name, 'primary', NULL, NULL, 1 FROM state UNION ALL SELECT 'sponsor', matter_file, 'Mayor', 'co', NULL, NULL, 1 FROM state
UNION ALL SELECT 'matter file', matter_file, CAST(o_orderkey % 100 AS VARCHAR), NULL, NULL, NULL, 1 FROM state
UNION ALL SELECT 'meeting file', meeting_id, CAST(document AS VARCHAR), NULL, NULL, NULL, 1 FROM meet""")
def incremental_gold(s, d):
    """All gold tables after three weeks of changes, natural keys instead of hashes: new and changed captures, first captures that come
    after later ones, and withdrawals, some of them before the withdrawn record's first capture comes in.
    """
    root = scratch(s, "changes")
    bronze, store = _bronze(s, d, root), BucketStore(s, f"{root}/star", 32)
    overdue = lambda df: F.col("type") == OVERDUE if "type" in df.columns else F.col("body_name").isNull()
    lineage = [F.lit("withdrawn").alias("source_file"), F.lit("2024-01-15").cast("date").alias("ingest_date"), F.lit("2024-01-15").cast("timestamp_ntz").alias("loaded_at")]
    gone = {
        "stg_matters": table(s, d, "orders").where(F.col("o_orderstatus") == WITHDRAWN_STATUS).select(F.col("o_orderkey").cast("string").alias("matter_file"), *lineage),
        "stg_meetings": table(s, d, "events").where(F.col("event_type") == WITHDRAWN_EVENT).select(F.col("event_id").cast("string").alias("meeting_id"), *lineage),
    }
    for week in range(3):
        arrived = lambda df: df.where(F.when(F.col("ingest_date") == LATE, 1).when(overdue(df), 2).otherwise(0) == week)  # noqa: B023, E731
        silver = {name: build(arrived(bronze[source])) for name, (source, build) in staging.SILVER.items()}
        # The week's withdrawals come with it, some weeks before the first capture of what they withdraw.
        incremental.Changes(store, lambda name, df: stored(df, f"{root}/week{week}/{name}")).apply(silver, gone if week == 1 else None)  # noqa: B023
        store.commit()
        remove(s, f"{root}/week{week}")
        store.vacuum()
    g = incremental.gold(store)
    people, committees = g["dim_person"].select("person_sk", "person_id", "full_name").hint("merge"), g["dim_committee"]
    meetings, matters = g["dim_meeting"].select("meeting_sk", "meeting_id").hint("merge"), g["dim_matter"].select("matter_sk", "matter_file").hint("merge")
    documents = g["dim_document"].select("document_sk", "document_id")
    none, text_of = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    facts = lambda name: g[name].join(matters, "matter_sk", "left").join(committees, "committee_sk", "left").join(meetings, "meeting_sk", "left")
    parts = {
        "matter": (g["dim_matter"], "matter_file", "status", "lifecycle", text_of("first_committee_date"), none),
        "committee": (committees, "committee_name", none, none, none, none),
        "person": (g["dim_person"], "person_id", "full_name", "id_source", none, none),
        "document": (g["dim_document"], "document_id", "document_title", none, none, none),
        "meeting": (g["dim_meeting"], "meeting_id", "body_name", text_of("meeting_date"), none, none),
        "action": (facts("fact_matter_action"), F.coalesce("history_id", F.lit("")), F.concat_ws("/", "matter_file", "action_type_code"), text_of("action_date"), "committee_name", "meeting_id"),
        "vote": (facts("fact_vote").join(people, "person_sk", "left"), F.coalesce("history_id", F.lit("")), F.concat_ws("/", "matter_file", "person_id", "vote_value"), text_of("vote_date"), "committee_name", "meeting_id"),
        "sponsor": (g["bridge_matter_sponsor"].join(matters, "matter_sk", "left").join(people, "person_sk", "left"), "matter_file", "full_name", "sponsor_type", none, none),
        "matter file": (g["bridge_matter_document"].join(matters, "matter_sk", "left").join(documents, "document_sk", "left"), "matter_file", "document_id", none, none, none),
        "meeting file": (g["bridge_meeting_document"].join(meetings, "meeting_sk", "left").join(documents, "document_sk", "left"), "meeting_id", "document_id", none, none, none),
    }
    columns = lambda values: [(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in zip("abcde", values)]
    rows = [df.select(F.lit(kind).alias("kind"), *columns(values)) for kind, (df, *values) in parts.items()]
    return quality.report(*rows).groupBy("kind", *"abcde").agg(F.count(F.lit(1)).alias("n"))


@query(_RECORDS + """
SELECT 'dim_matter' AS name, count(*) AS n FROM orders UNION ALL SELECT 'dim_committee', count(*) FROM (SELECT DISTINCT body FROM act UNION SELECT 'Committee R' FROM meet UNION SELECT 'Board' FROM orders)
UNION ALL SELECT 'dim_person', (SELECT count(DISTINCT l_suppkey) FROM act) + (SELECT count(DISTINCT c_name) FROM orders JOIN customer ON o_custkey = c_custkey) + 1
UNION ALL SELECT 'dim_document', count(*) FROM (SELECT o_orderkey % 100 FROM orders UNION SELECT document FROM meet) UNION ALL SELECT 'dim_meeting', count(*) FROM meet
UNION ALL SELECT 'fact_matter_action', count(DISTINCT coalesce(history_id, concat_ws('|', matter_file, day, l_linestatus))) FROM act
UNION ALL SELECT 'fact_vote', count(*) FROM vote UNION ALL SELECT 'bridge_matter_sponsor', 2 * count(*) FROM orders UNION ALL SELECT 'bridge_matter_document', count(*) FROM orders UNION ALL SELECT 'bridge_meeting_document', count(*) FROM meet""")
def medallion_gold_counts(s, d):
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in _gold(s, d).items()]
    return quality.report(*counts)


@query(_RECORDS + """
SELECT CAST(v.l_suppkey AS VARCHAR) AS id, CAST(v.l_suppkey AS BIGINT) AS district, count(*) FILTER (WHERE vote_value = 'Aye') AS aye, count(*) FILTER (WHERE vote_value = 'No') AS nay,
  count(*) FILTER (WHERE vote_value = 'Absent') AS absent, count(*) AS total, count(*) AS n_votes, strftime(max(day), '%-m/%-d/%Y') AS latest
FROM vote v WHERE l_suppkey < 11 AND day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY 1, 2""")
def rep_tally(s, d):
    """The dashboard's document, read back and counted."""
    districts = {str(i): i for i in range(11)}
    payload = serve.rep_payload(serve.member_vote_record(_gold(s, d), list(districts), 1997), districts, 1997, "2024-01-08")
    reps = F.from_json("payload", "reps array<struct<id:string,district:bigint,aye:bigint,nay:bigint,absent:bigint,total:bigint,votes:array<struct<date:string>>>>")
    rep = payload.select(F.explode(reps["reps"]).alias("r")).select("r.*")
    return rep.select("id", "district", "aye", "nay", "absent", "total", F.size("votes").cast("long").alias("n_votes"), F.col("votes")[0]["date"].alias("latest"))


@query("SELECT CAST(ts AS DATE) AS ingest_date, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_land_counts(s, d):
    """Events as files of a landing zone, drained by the stream twice: the second time brings nothing more."""
    root = scratch(s, "landing")
    events = table(s, d, "events").withColumn("ingest_date", F.col("ts").cast("date"))
    events.select("event_id", "value", "ingest_date").write.partitionBy("ingest_date").json(f"{root}/raw")
    for _ in range(2):
        land(s, f"{root}/raw", "event_id long, value double", "event_id", f"{root}/bronze", f"{root}/checkpoint", multi_line=False)
    return landed(s, f"{root}/bronze", "event_id long, value double").groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_type AS file, count(*) AS n, count(DISTINCT event_id) AS different, round(sum(value), 2) AS total FROM events GROUP BY 1")
def landing_after_failure(s, d):
    """Events in files by type. Some land; a batch of a second query dies after its write, as its rows without log entry show; a third
    query with a new checkpoint lands what the log doesn't have. Then all small folders are packed, twice. Each event is there once.
    """
    root, ddl = scratch(s, "failure"), "event_id long, event_type string, value double"
    events = table(s, d, "events").select("event_id", "event_type", "value")
    # Straight into the one day's folder: a write by a column would sort all rows of a type in one task's memory.
    part = lambda *kinds: events.where(F.col("event_type").isin(*kinds)).repartition("event_type").write.mode("append").json(f"{root}/raw/ingest_date=2024-01-08")
    settings = {"source": f"{root}/raw", "ddl": ddl, "key": "event_id", "target": f"{root}/bronze", "multi_line": False}
    part("view")
    land(s, **settings, checkpoint=f"{root}/c1")
    part("click", "error")
    died = read_documents(s, f"{root}/raw", ddl, multi_line=False)
    split_broken(died.where("event_type <> 'view'"), "event_id")[0].write.partitionBy("ingest_date").parquet(f"{root}/bronze/batch=died-0")
    land(s, **settings, checkpoint=f"{root}/c3")
    part("purchase", "signup")
    land(s, **settings, checkpoint=f"{root}/c3", files_per_batch=1)
    for _ in range(2):
        compact(s, f"{root}/bronze", ddl)
        BatchLog(s, f"{root}/bronze").vacuum()
    rows = landed(s, f"{root}/bronze", ddl)
    return rows.groupBy(F.col("event_type").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("different"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def upsert_snapshots(s, d):
    """The same merge through the table writer, run twice; the second run changes nothing."""
    target, source = _upsert_sides(s, d)
    snapshots = Snapshots(s, scratch(s, "snapshots"))
    snapshots.write(target)
    for _ in range(2):
        upsert(snapshots, source, ["o_orderkey"])
    return snapshots.read()


@query("""
SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'READ' WHEN 'click' THEN 'READ' WHEN 'purchase' THEN 'BUY' ELSE 'OTHER' END AS action_code,
  CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'visit' WHEN 'purchase' THEN 'sale' END AS category FROM events""")
def canonical_actions(s, d):
    labels = s.createDataFrame([("VIEW", "READ", "visit"), (" click", "READ", "visit"), ("Purchase", "BUY", "sale")], "label string, action_code string, category string")
    return codes.canonical_action(table(s, d, "events").select("event_id", "event_type"), "event_type", labels)


@query("""
SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN 'Nay' ELSE l_returnflag END AS vote, CASE WHEN l_linestatus = 'O' THEN 'committee' ELSE 'board' END AS scope, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def vote_spelling_and_scope(s, d):
    raw = F.when(F.col("l_returnflag") == "N", F.lit("no")).otherwise(F.col("l_returnflag"))
    body = F.concat(F.col("l_linestatus"), F.when(F.col("l_linestatus") == "O", F.lit(" Rules COMMITTEE")).otherwise(F.lit(" Board")))
    rows = table(s, d, "lineitem").select("l_orderkey", codes.canonical_vote(raw).alias("vote"), codes.body_scope(body).alias("scope"))
    return rows.groupBy("l_orderkey", "vote", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT e.event_id, m.meeting_sk FROM (SELECT event_id, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS c, CAST(ts AS DATE) - 9000 AS d FROM events) e
LEFT JOIN (SELECT c_name AS c, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS meeting_sk FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) m ON e.c = m.c AND e.d = m.d""")
def meeting_by_committee_and_date(s, d):
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("body_name"))
    meetings = table(s, d, "orders").join(customers, "o_custkey").select("body_name", F.col("o_orderdate").cast("date").alias("meeting_date"), F.col("o_orderkey").alias("meeting_sk"))
    facts = table(s, d, "events").select("event_id", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("c"), F.date_sub(F.col("ts").cast("date"), 9000).alias("d"))
    # A user whose name no customer with orders has is no meeting's committee; the event stays, as in SQL.
    return star.meeting_resolver(facts, meetings, "c", "d", strict=False).select("event_id", "meeting_sk")


@query("""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS document_url, max(url) AS document_title, CAST(NULL AS VARCHAR) AS document_id FROM pages GROUP BY 1""")
def document_dim(s, d):
    files = table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("attachment_url"), F.col("url").alias("attachment_name"))
    return star.dim_document(files.where("attachment_name LIKE 'http:%'"), files.where("attachment_name NOT LIKE 'http:%'").select(F.col("attachment_url").alias("document_url"), F.col("attachment_name").alias("document_title"))).drop("document_sk")


@query("""
SELECT CAST(e.event_id AS VARCHAR) AS meeting_id, e.event_id % 150 AS document, x.source FROM events e,
  (SELECT unnest(['meeting_agenda', 'meeting_minutes', 'transcript']) AS source) x
WHERE (x.source = 'meeting_agenda' AND event_type <> 'error') OR (x.source = 'meeting_minutes' AND event_type = 'view') OR (x.source = 'transcript' AND user_id % 2 = 0)""")
def document_bridge(s, d):
    """Events as meetings with up to three documents, through silver into the bridge."""
    url = F.concat(F.lit("https://records.example/"), (F.col("event_id") % 150).cast("string"))
    meetings = table(s, d, "events").select(
        F.col("event_id").cast("string").alias("meeting_id"), "event_id", F.when(F.col("event_type") != "error", url).alias("agenda_url"), F.when(F.col("event_type") == "view", url).alias("minutes_url"),
        F.when(F.col("user_id") % 2 == 0, (F.col("event_id") % 150).cast("string")).alias("video_clip_id"), F.lit("f").alias("source_file"), F.lit("2024-01-08").cast("date").alias("ingest_date"), F.col("ts").alias("loaded_at"),
    )
    silver = staging.stg_meeting_documents(pages.meeting_documents(meetings, "https://records.example"))
    bridge = star.bridge_meeting_document(silver).select("document_sk", "meeting_sk", F.col("document_source").alias("source"))
    numbers = silver.select(keys.sk("meeting_id").alias("meeting_sk"), keys.sk("document_url").alias("document_sk"), "meeting_id", F.regexp_extract("document_url", "[0-9]+", 0).cast("long").alias("document")).distinct()
    return bridge.join(numbers, ["meeting_sk", "document_sk"]).select("meeting_id", "document", "source")


def _grid(rows_html) -> Column:
    return F.concat(F.lit("<html><script>'<table>'</script><table class='a rgMasterTable'><tbody>"), rows_html, F.lit("</tbody></table></html>"))


def _cells(*values) -> Column:
    """A grid row of eleven cells."""
    texts = [v if isinstance(v, Column) else F.lit(v) for v in values] + [F.lit("")] * (11 - len(values))
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td> "), t, F.lit("</td>")) for t in texts), F.lit("</tr>"))


def _shaped(html: Column, kind: Column) -> Column:
    """A page as different writers would write it: 0 as it is, 1 upper case, 2 the other quotes, 3 no quotes and no end tags, 4 a table in each cell."""
    upper = html
    for tag in ("table", "tbody", "tr", "td", "a", "span", "script"):
        for was in (f"<{tag}>", f"<{tag} ", f"</{tag}>"):
            upper = F.replace(upper, F.lit(was), F.lit(was.upper()))
    for name in ("class", "id", "href", "onclick"):
        upper = F.replace(upper, F.lit(f" {name}="), F.lit(f" {name.upper()} = "))
    bare = F.regexp_replace(F.regexp_replace(html, r"""(\w)=(["'])([^"'\s>]+)\2""", "$1=$3"), "</t[dr]>", "")
    inner = F.replace(html, F.lit("<td>"), F.lit("<td><table class='x'><tbody><tr><td></td><td></td></tr></tbody></table>"))
    return F.when(kind == 1, upper).when(kind == 2, F.translate(html, "\"'", "'\"")).when(kind == 3, bare).when(kind == 4, inner).otherwise(html)


_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) - 1 AS seq FROM lineitem"


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS history_id, CAST(l_suppkey AS VARCHAR) AS person_id, CASE l_returnflag WHEN 'N' THEN 'No' WHEN 'A' THEN 'Aye' ELSE 'Recused' END AS vote_value, l_returnflag <> 'R' AS known, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4""")
def roll_call_votes(s, d):
    """Orders as roll-call pages, read back; one row of each page has no link and no known value, so it is no vote."""

    def row(line):
        value = F.when(line["flag"] == "N", "No").when(line["flag"] == "A", "Aye").otherwise("Recused")
        return F.concat(F.lit("<tr><td><a href='#' href=\"PersonDetail.aspx?ID="), line["l_suppkey"].cast("string"), F.lit("\">Member</a></td><td></td><td><b>"), value, F.lit("</b></td></tr>"))

    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.col("l_returnflag").alias("flag"))
    # Dealt by rows: by their bytes, which are few, some tasks would get millions.
    lines = lines.repartition(max(s.sparkContext.defaultParallelism, -(-lines.count() // LINES_PER_TASK)), "o_orderkey")
    nested = flatten.nest(lines, ["o_orderkey"], ["l_suppkey", "flag"], "lines")
    html = _grid(F.concat(F.array_join(F.transform("lines", row), ""), F.lit("<tr><td>Total</td><td>9</td></tr>")))
    calls = pages.roll_call_pages(nested.select(F.concat(F.lit("HistoryDetail.aspx?ID="), F.col("o_orderkey").cast("string")).alias("url"), html.alias("html")))
    # Outer, or Spark would work out all votes a second time for a filter on their number.
    votes = flatten.unnest(calls, "votes", "v", outer=True).where("v IS NOT NULL").select("history_id", *flatten.fields("v", person_id="person_id", vote_value="vote_value", known="known"))
    return votes.groupBy("history_id", "person_id", "vote_value", "known").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT l_orderkey AS page_id, 'Board & ' || l_orderkey AS body_name, seq + 1 AS item_seq, CAST(l_partkey AS VARCHAR) AS matter_file, CAST(l_suppkey AS VARCHAR) AS history_id FROM ({_LINES})""")
def meeting_page_items(s, d):
    """Orders as meeting pages, read back; the first row of each grid is too short and only counts for the sequence. Orders of
    different priority are written in different shapes.
    """
    shape = table(s, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("shape"))
    nested = _nested(s, d).join(shape, "o_orderkey", "left")

    def row(line):
        popup = F.concat(F.lit("<a onclick=\"radopen('HistoryDetail.aspx?ID="), line["l_suppkey"].cast("string"), F.lit("&amp;GUID=A-1', 'x')\">d</a>"))
        return _cells(line["l_partkey"].cast("string"), "", "1", "n", "t", "s", "title", "", popup)

    items = F.concat(F.lit("<tr><td>short</td></tr>"), F.array_join(F.transform("lines", row), ""))
    label = F.concat(F.lit('<span id="x_hypName">Board &amp; '), F.col("o_orderkey").cast("string"), F.lit("</span>"))
    html = _shaped(F.concat(label, _grid(items)), F.col("shape") - 1)
    return pages.meeting_items(nested.select(F.col("o_orderkey").alias("page_id"), html.alias("html")), "https://records.example", only=("body_name", "item_seq", "matter_file", "history_id"))


@query("""
SELECT CAST(event_id AS VARCHAR) AS meeting_id, 'AB-' || event_id AS event_guid, event_type AS body_name, 'Room ' || user_id AS location, 'Special' AS meeting_subtype, event_type = 'view' AS has_minutes
FROM events WHERE event_type <> 'error'""")
def calendar_page_rows(s, d):
    """Days as calendar pages of up to SHEET numbers each, read back, so that a busy day is more pages and not a longer one. Error events
    have no detail link, so they are no meetings. A page's number picks its shape.
    """
    link = F.when(F.col("event_type") != "error", F.concat(F.lit('<a href="MeetingDetail.aspx?ID='), F.col("event_id").cast("string"), F.lit("&amp;GUID=ab-"), F.col("event_id").cast("string"), F.lit('">d</a>'))).otherwise(F.lit("none"))
    minutes = F.when(F.col("event_type") == "view", F.lit('<a href="View.ashx?M=M">Minutes</a>')).otherwise(F.lit("Not&nbsp;available"))
    rows = table(s, d, "events").select(F.col("ts").cast("date").alias("day"), F.floor(F.col("event_id") / SHEET).alias("sheet"), _cells(F.col("event_type"), "1/1/2024", "", "", F.concat(F.lit("Room "), F.col("user_id").cast("string"), F.lit(" special  Meeting")), link, "", minutes).alias("r"))
    sheets = rows.groupBy(F.col("day").alias("page_id"), "sheet").agg(_grid(F.array_join(F.collect_list("r"), "")).alias("html"))
    sheets = sheets.withColumn("html", _shaped(F.col("html"), F.pmod("sheet", F.lit(5))))
    return pages.calendar_rows(sheets, "https://records.example").select("meeting_id", "event_guid", "body_name", "location", "meeting_subtype", "has_minutes")


@query("SELECT o.o_orderkey, coalesce(n, 0) AS total, coalesce(n, 0) AS n_found FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def completeness(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    reported = table(s, d, "orders").select("o_orderkey").join(lines.groupBy("o_orderkey").agg(F.countDistinct("l_partkey").alias("total")), "o_orderkey", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return pages.assert_complete(lines, reported, ["o_orderkey"], "l_partkey", "total")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ingest_date, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def entity_file_roundtrip(s, d):
    """Orders as entity files, those without key left out, read back with lineage from their paths."""
    root = scratch(s, "entities")
    orders = table(s, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("k"), "o_totalprice", F.trunc("o_orderdate", "month").alias("ingest_date"))
    entity_files(orders.repartition("ingest_date"), root, "k")
    back = read_documents(s, root, "k long, o_totalprice double", multi_line=False)
    return split_broken(back, "k")[0].groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM orders GROUP BY 1")
def partition_overwrite(s, d):
    """One partition is replaced, the others stay."""
    root = scratch(s, "partitions")
    orders = table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.lit(0).cast("long").alias("version"))
    overwrite(orders, root, ("o_orderpriority",))
    overwrite(orders.where("o_orderpriority = '1-URGENT'").withColumn("version", F.lit(1).cast("long")), root, ("o_orderpriority",))
    return s.read.parquet(root).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("replaced"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def payload_roundtrip(s, d):
    """Nations as one JSON document, read back."""
    named = table(s, d, "nation").join(table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name")
    document = payload(named, "items", generated=F.lit("now"))
    items = document.select(F.explode(F.from_json("payload", "items array<struct<n_name:string,r_name:string>>")["items"]).alias("i")).select("i.*")
    return items.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"), F.count(F.lit(1)).alias("n"))


def _detail_pages(s, d) -> DataFrame:
    """Orders as detail pages with their lines as history: those with status P carry no file number, those without lines no grid."""
    # Merged, so that pages lie in as many tasks as the shuffle makes: broadcast lines left them in the orders' few files.
    nested = table(s, d, "orders").join(_nested(s, d).hint("merge"), "o_orderkey", "left")

    def row(line):
        link = F.concat(F.lit("<a onclick=\"radopen('HistoryDetail.aspx?ID="), F.col("o_orderkey").cast("string"), F.lit("-"), line["l_suppkey"].cast("string"), F.lit("', 'x')\">Details</a>"))
        return F.concat(F.lit("<tr><td>1/2/2024</td><td>1</td><td>Board &amp; "), line["l_partkey"].cast("string"), F.lit("</td><td>"), line["l_linenumber"].cast("string"), F.lit("</td><td>Pass</td><td>"), link, F.lit("</td></tr>"))

    number = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit('<span id="c_lblFile2">'), F.col("o_orderkey").cast("string"), F.lit("</span>"))).otherwise(F.lit(""))
    files = F.concat(F.lit('<span id="c_lblSponsors2">Ann, Bob and Cy</span><a href="View.ashx?M=F&amp;ID='), F.col("o_orderkey").cast("string"), F.lit('">Leg Ver1</a>'))
    history = F.when(F.size("lines") > 0, F.concat(F.lit('<table id="c_gridLegislation_ctl00"><tbody><tr><td>short</td></tr>'), F.array_join(F.transform("lines", row), ""), F.lit("</tbody></table>"))).otherwise(F.lit(""))
    url = F.concat(F.lit("https://records.example/LegislationDetail.aspx?ID="), F.col("o_orderkey").cast("string"))
    return nested.select("o_orderkey", url.alias("url"), F.concat(F.lit("<html>"), number, files, history, F.lit("</html>")).alias("html"))


@query(f"""
WITH line AS ({_LINES})
SELECT CAST(o.o_orderkey AS VARCHAR) AS file_number, 3::BIGINT AS n_sponsors, 'https://records.example/View.ashx?M=F&ID=' || o.o_orderkey AS attachment, count(l.l_orderkey) AS n_actions,
  coalesce(string_agg('Board & ' || l.l_partkey || '/' || l.l_linenumber || '/' || CASE WHEN l.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 2 ELSE 0 END, ',' ORDER BY l.seq), '') AS actions
FROM orders o LEFT JOIN line l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus <> 'P' GROUP BY o.o_orderkey""")
def entity_page_records(s, d):
    """Detail pages read back, with the votes of the roll calls that exist (suppliers in credit) put into their actions."""
    fields = ("detail_url", "file_number", "sponsors", "attachments", "actions", "error")
    records, _ = pages.isolate_errors(pages.entity_pages(_detail_pages(s, d), "https://records.example", only=fields))
    # The pages' history ids are numbers with a dash here, so they are read from the links again.
    with_ids = records.withColumn("actions", F.transform("actions", lambda a: a.withField("history_id", F.regexp_extract(a["history_url"], "ID=([0-9-]+)", 1))))
    calls = table(s, d, "lineitem").join(table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select(F.concat_ws("-", "l_orderkey", "l_suppkey").alias("history_id")).distinct()
    vote = lambda p: F.struct(F.lit(p).alias("person_id"), F.lit(p).alias("person_name"), F.lit("Aye").alias("vote_value"), F.lit(True).alias("known"))
    whole = pages.attach_votes(with_ids, calls.withColumn("votes", F.array(vote("a"), vote("b"))))
    action = lambda a: F.concat(a["body"], F.lit("/"), a["action"], F.lit("/"), F.size(a["votes"]).cast("string"))
    return whole.select("file_number", F.size("sponsors").cast("long").alias("n_sponsors"), F.col("attachments")[0]["url"].alias("attachment"), F.size("actions").cast("long").alias("n_actions"), F.array_join(F.transform("actions", action), ",").alias("actions"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders)
SELECT 'orders' AS "table", CASE WHEN o_orderstatus = 'P' THEN 'no file number' ELSE 'no history grid' END AS error, count(*) AS n_pages FROM o WHERE o_orderstatus = 'P' OR NOT has_lines GROUP BY 1, 2""")
def page_drift_signal(s, d):
    return pages.drift_signal(pages.entity_pages(_detail_pages(s, d), "https://records.example", only=("error",)), "orders")


@query("SELECT 'https://records.example/LegislationDetail.aspx?ID=' || o_orderkey AS detail_url, 'no file number' AS error FROM orders WHERE o_orderstatus = 'P'")
def page_quarantine(s, d):
    return pages.isolate_errors(pages.entity_pages(_detail_pages(s, d), "https://records.example", only=("detail_url", "error")))[1]


@query("""
SELECT user_id, event_id AS meeting, 'Final' AS minutes_status FROM events e WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def draft_then_final(s, d):
    """Captures of a user's meeting: drafts (errors) give way to the latest final one, drafts alone leave nothing."""
    status = F.when(F.col("event_type") == "error", F.lit(" DRAFT ")).otherwise(F.lit("Final"))
    captures = table(s, d, "events").select("user_id", F.col("event_id").alias("meeting"), "ts", "event_id", status.alias("minutes_status"))
    return latest.latest_wins(pages.without_drafts(captures), ["user_id"], ("ts", "event_id")).select("user_id", "meeting", "minutes_status")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click')")
def completed_only(s, d):
    """Completed meetings: those whose minutes are said to be there."""
    rows = table(s, d, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), True).when(F.col("event_type") == "error", False).alias("has_minutes"))
    return pages.completed(rows).select("event_id")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'passed' WHEN o_orderstatus = 'O' THEN 'in_works' ELSE 'other' END AS bucket FROM orders""")
def producer_bucket(s, d):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(" Finally PASSED ")).when(F.col("o_orderstatus") == "O", F.lit("In Committee")).when(F.col("o_custkey") % 2 == 0, F.lit("Filed"))
    return table(s, d, "orders").select("o_orderkey", codes.producer_bucket(raw).alias("bucket"))


@query("""
SELECT c.o_custkey, u.o_orderkey AS order_key FROM (SELECT DISTINCT o_custkey FROM orders) c
LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) u ON c.o_custkey = u.o_custkey""")
def first_urgent_order(s, d):
    """The first element of each customer's orders whose priority starts with '1-u', whatever its case."""
    nested = flatten.nest(table(s, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderpriority"], "orders", order=["o_orderdate", "o_orderkey"])
    return nested.select("o_custkey", text.first_matching("orders", "1-U", "o_orderpriority")["o_orderkey"].alias("order_key"))


@query("""
SELECT url, min(feed) AS feed FROM (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS url, 0 AS feed FROM pages WHERE url LIKE 'https:%' UNION ALL SELECT regexp_extract(url, '^https?://([^/]+)', 1), 1 FROM pages) WHERE url <> '' GROUP BY 1""")
def target_union(s, d):
    """Hosts of two feeds, each with the feed that names it first."""
    hosts = table(s, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url", "page_id")
    found = latest.target_union(hosts.where(F.col("url").startswith("https:")).drop("url"), hosts.drop("url"), key="host", order=["page_id"])
    return found.select(F.col("host").alias("url"), "feed")


@query("SELECT event_type <> 'error' AS good, count(*) AS n FROM events GROUP BY 1")
def tolerant_reread(s, d):
    """Events as record files in which errors don't parse, read back: nothing stops, broken records are apart."""
    root = scratch(s, "tolerant")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "value")))
    table(s, d, "events").select(line.alias("line")).write.text(f"{root}/ingest_date=2024-01-08")
    good, broken = split_broken(read_documents(s, root, "event_id long, value double", "*.txt", multi_line=False), "event_id")
    return quality.report(*(df.agg(F.lit(ok).alias("good"), F.count(F.lit(1)).alias("n")) for ok, df in ((True, good), (False, broken))))


DRIFTING = "event_id long, value double, items array<struct<name string>>"
_DRIFT_PATH = "CASE event_type WHEN 'view' THEN 'items[].rank' WHEN 'click' THEN 'clicked_by' WHEN 'error' THEN 'value' WHEN 'purchase' THEN 'items' END"
_DRIFT_PROBLEM = "CASE WHEN event_type IN ('view', 'click') THEN 'unknown' WHEN event_type IN ('error', 'purchase') THEN 'retyped' END"


def _drifting(s, d) -> DataFrame:
    """line, ingest_date: events as records of a source whose fields have changed since its schema was written, each kind in its own way."""
    kind, user = F.col("event_type"), F.col("user_id")
    value = F.when(kind == "error", F.format_string('"broken-%d"', "event_id")).otherwise(F.to_json(F.struct("value")).substr(F.lit(10), F.length(F.to_json(F.struct("value"))) - 10))
    items = F.when(kind == "purchase", F.lit('"none"')).when(kind == "view", F.format_string('[{"name": "%s", "rank": %d}]', kind, user)).otherwise(F.format_string('[{"name": "%s"}]', kind))
    more = F.when(kind == "click", F.format_string(', "clicked_by": %d', user)).otherwise(F.lit(""))
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "value": '), value, F.lit(', "items": '), items, more, F.lit("}"))
    return table(s, d, "events").select(line.alias("line"), F.col("ts").cast("date").alias("ingest_date"))


@query(f"""
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type <> 'purchase' THEN event_type END AS name, {_DRIFT_PATH} AS path, {_DRIFT_PROBLEM} AS problem,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(user_id AS VARCHAR) WHEN event_type = 'error' THEN 'broken-' || event_id WHEN event_type = 'purchase' THEN 'none' END AS kept FROM events""")
def drift_rows(s, d):
    """Every record with what its schema holds, and beside it what the schema has no place for."""
    root = scratch(s, "drift")
    _drifting(s, d).select("line").write.text(f"{root}/ingest_date=2024-01-08")
    good = split_broken(drift.read_with_rest(s, root, DRIFTING, "*.txt", multi_line=False), "event_id")[0]
    rest = good.select("event_id", "value", F.try_element_at("items", F.lit(1))["name"].alias("name"), F.explode_outer(drift.REST).alias("_e"))
    return rest.select("event_id", "value", "name", "_e.path", "_e.problem", F.col("_e.value").cast("string").alias("kept"))


@query(f"""
SELECT CAST(ts AS DATE) AS ingest_date, {_DRIFT_PATH} AS path, {_DRIFT_PROBLEM} AS problem, count(*) AS n_records, count(*) AS n_values FROM events
WHERE event_type <> 'signup' GROUP BY 1, 2, 3""")
def drift_landed(s, d):
    """The same records landed by the stream with their rest, packed, and what drifted counted by day of capture."""
    root, bronze = scratch(s, "drift-landing"), f"{DRIFTING}, {drift.REST} {drift.REST_TYPE}"
    lines = _drifting(s, d).select(F.col("line").alias("value"), "ingest_date")
    lines.write.partitionBy("ingest_date").option("compression", "none").text(f"{root}/text")
    land(s, f"{root}/text", DRIFTING, "event_id", f"{root}/bronze", f"{root}/checkpoint", multi_line=False, keep_rest=True, pattern="[!_]*.txt")
    compact(s, f"{root}/bronze", bronze)
    return drift.drift_report(landed(s, f"{root}/bronze", bronze), "ingest_date")


@query("SELECT event_type <> 'view' AS late, count(*) AS n FROM events GROUP BY 1")
def streams_in_turn(s, d):
    """Two landing zones drained one after the other; the second zone's new checkpoint on a target that holds data adds to it."""
    root, ddl = scratch(s, "streams"), "event_id long, late boolean"
    for kind, late in (("view", False), ("rest", True)):
        table(s, d, "events").where((F.col("event_type") != "view") == late).select("event_id", F.lit(late).alias("late"), F.lit("2024-01-08").alias("ingest_date")).write.partitionBy("ingest_date").json(f"{root}/{kind}")
    streams = {k: {"source": f"{root}/{k}", "ddl": ddl, "key": "event_id", "target": f"{root}/bronze", "checkpoint": f"{root}/c-{k}", "multi_line": False} for k in ("view", "rest")}
    land_all(s, streams)
    return landed(s, f"{root}/bronze", ddl).groupBy("late").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', (SELECT count(*) FROM region) UNION ALL SELECT 'whole', (SELECT count(*) FROM supplier) UNION ALL SELECT 'view', (SELECT count(*) FROM nation WHERE n_regionkey = 1)")
def layer_tables(s, d):
    """Tables of a layer written twice, inspected, seen through a view and dropped with their layer; a path replaced as a whole."""
    root, layers = scratch(s, "layers"), Layers(s, f"strata_{uuid.uuid4().hex[:12]}_")
    for _ in range(2):
        nation = layers.materialise(table(s, d, "nation"), "gold", "nation", ("n_regionkey",))
        layers.materialise(table(s, d, "region"), "gold", "region")
    for rows in (table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))):
        overwrite(rows.withColumn("part", F.pmod("k", F.lit(3))), root, ("part",), whole=True)
    found = layers.inspect("gold")
    found.append(("view", as_view(nation.where("n_regionkey = 1"), f"strata_{uuid.uuid4().hex}").count()))
    layers.reset("gold")
    return s.createDataFrame([*found, ("whole", s.read.parquet(root).count())], "name string, n long")
