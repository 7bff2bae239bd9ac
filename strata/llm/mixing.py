"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Each source gets a target number of words: the weights share the words of all sources, no target passes ``cap`` times
its source, and what a capped source can't take is shared among the others by weight (water filling). Within a source
every document has the same expected number of copies, target / source size. Documents are put in an order by size
(then by a hash of their id and text); the running sum of expected copies plus one random offset crosses integers, and a document
is taken once per integer crossed. Ordering by size makes the words taken follow the target closely.

The running sum never needs a source in one task: rows are ranked inside small cells (source, size class, hash bin) and
the cells' counts, at most ``bins`` times the number of size classes per source, are summed on the side. The number of bins
follows the number of rows, so a cell doesn't grow even where a whole table is of one source and size.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an empty table gives no rows;
a repeated row is another document; a source without words has target 0; ties of the order are between rows of one id and
text, so reruns agree; other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 64
#: One bin for so many rows of the table, so a cell (source, size class, bin) has at most about this number.
BIN_ROWS = 1_000_000
SEED = "strata-mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the columns as a struct, so that no name clashes), source, size, and hash, which tells rows apart by id and text."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.struct(*columns).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)).alias("hash"))


def _cells(sized: DataFrame, bins: int) -> DataFrame:
    """Adds _key (source, nulls apart), _class (32 size classes an octave) and _bin."""
    return sized.withColumns(
        {
            "_key": F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")),
            "_class": F.floor(F.log2(F.col("size") + F.lit(1)) * 32).cast("int"),
            "_bin": F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), F.lit(bins)).cast("int"),
        }
    )


def source_targets(cells: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source_size and target. Works on the table of cells, so its windows see sources only."""
    per = cells.groupBy("_key").agg(F.sum("_words").alias("source_size"), F.min("source").alias("_source"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("_w", w).withColumn("_most", F.col("source_size") * cap)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_most") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    spent, used = F.coalesce(F.sum("_most").over(before), F.lit(0)), F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - spent) / (F.sum("_w").over(everything) - used)
    # The level rises while sources are capped and falls after: its maximum is where filling ends.
    per = per.withColumn("_level", level.cast("double"))
    per = per.withColumn("_level", F.max("_level").over(everything))
    return per.select("_key", "source_size", F.least(F.col("_most").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def _taken(sized: DataFrame, weights, cap: int, seed: str, bins: int | None) -> DataFrame:
    """row, size, source_size, target, copies."""
    bins = bins or max(BINS, -(-sized.count() // BIN_ROWS))
    rows = _cells(sized, bins)
    cells = cut(rows.groupBy("_key", "_class", "_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"), F.min("source").alias("source")))
    targets = source_targets(cells, weights, cap)
    order = Window.partitionBy("_key").orderBy("_class", "_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select("_key", "_class", "_bin", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")).join(targets, "_key")
    inside = Window.partitionBy("_key", "_class", "_bin").orderBy("hash")
    ranked = rows.join(placed, ["_key", "_class", "_bin"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(seed), F.col("_key")))
    crossed = F.floor(offset + each * F.col("_rank")) - F.floor(offset + each * (F.col("_rank") - 1))
    return ranked.select("row", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, bins: int | None = None) -> DataFrame:
    """All columns of ``docs`` with _size, _source_size, _target and _copies (0 to ``cap``), which take the place of columns so named.
    Without ``bins`` there are one for each BIN_ROWS rows of the table, but at least BINS.
    """
    own = ("_size", "_source_size", "_target", "_copies")
    found = _taken(_sized(docs, docs.columns), weights, cap, seed, bins)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return found.select(*kept, *(F.col(c[1:]).alias(c) for c in own))


def sampled(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, bins: int | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken."""
    found = _taken(_sized(docs, docs.columns), weights, cap, seed, bins).where("copies > 0")
    each = found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE 's:' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
per AS (SELECT k, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
          / (CAST(sum(w) OVER () AS DOUBLE)
             - CAST(coalesce(sum(w) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) AS lev
  FROM weighted),
targets AS (SELECT k, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT max(lev) FROM levels) * w) AS target FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.k,
         row_number() OVER (PARTITION BY s.k ORDER BY CAST(floor(log2(s.size + 1) * 32) AS BIGINT),
                            CAST('0x' || substr(s.h, 1, 8) AS BIGINT) % (SELECT greatest(64, (count(*) + 999999) // 1000000) FROM documents), s.h) AS r
  FROM sized s JOIN targets t ON s.k = t.k),
placed AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS c,
         CAST(CAST('0x' || substr(md5('strata-mix-1' || k), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(u + c * r) - floor(u + c * (r - 1)), 3) AS BIGINT) AS taken,
       CAST(least(floor(u + c * r) - floor(u + c * (r - 1)), 3) AS BIGINT) AS copies
FROM placed
"""


def op7_mix_systematic(spark, sf_dir):
    """The texts are read once: their sizes and hashes are kept, and both passes are over these."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = _taken(cut(_sized(docs, ["doc_id"])), WEIGHTS, CAP, SEED, None)
    return found.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
