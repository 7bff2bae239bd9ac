"""Full-text search by an inverted index: postings in blocks with maxima, BM25, segments for new documents.

A posting is a document's id, how often it has the term, and its length. Postings lie by the bucket their term hashes to and, within
a task's share of it, by falling frequency, in blocks of up to ``BLOCK``; each block says the highest frequency and the
shortest document in it, which bounds the score of all its postings. A search reads the partitions of its terms alone. Blocks
with the highest bounds give k documents with at least some score first; then only blocks are opened
whose bound, with the best that the other terms could add, reaches that score. What is skipped can't be among
the k best, so the result is exact.

A segment counts from when its line of statistics is written; scores use the statistics of all segments together.

Defined cases: a null text has no words; an id stands for a document once only (index an id again in another segment and both
count); an unknown term adds nothing; without any known term the result is empty; ties go to the smaller id.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.shipping import ship

TOKEN = re.compile("[a-z0-9]+")
#: In place of a term: the postings of this one are the documents with their lengths, from which the statistics are summed.
WHOLE = ""
BUCKETS = 64
BLOCK = 1024
#: Shares of a bucket, so that a term which many documents have is gathered by several tasks.
SHARES = 8
K1, B = 1.2, 0.75
_POSTING = "term string, id long, tf int, dl int"
_BLOCK = "_bucket int, term string, n int, max_tf int, min_dl int, postings array<struct<id:long,tf:int,dl:int>>"
_STATS = "segment string, n_docs long, n_words long"


def _postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each word of a document, and one of no word for the document itself."""
    names = [f.split()[0] for f in _POSTING.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                terms, tfs, sizes, lengths = [], [], [], []
                for t in part.column(1).to_pylist():
                    words = TOKEN.findall(t.lower()) if t else []
                    counts = Counter(words)
                    terms.append(WHOLE)
                    terms.extend(counts)
                    tfs.append(len(words))
                    tfs.extend(counts.values())
                    sizes.append(len(counts) + 1)
                    lengths.append(len(words))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), ids, pa.array(tfs, pa.int32()), pa.array(np.repeat(np.array(lengths, np.int32), sizes))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _POSTING)


def _blocks(sorted_postings: DataFrame) -> DataFrame:
    """Postings that come by term and mostly by falling frequency, in blocks. What a batch leaves open goes on with the next one."""
    names = [f.split()[0] for f in _BLOCK.split(", ")]
    most = BLOCK

    def blocks(columns: list[pa.Array], starts: np.ndarray, end: int) -> pa.RecordBatch:
        bucket, term, i, tf, dl = (c.slice(0, end) for c in columns)
        at = pa.array(starts)
        postings = pa.ListArray.from_arrays(pa.array(np.append(starts, end), pa.int32()), pa.StructArray.from_arrays([i, tf, dl], ["id", "tf", "dl"]))
        lengths = pa.array(np.diff(np.append(starts, end)).astype(np.int32))
        return pa.RecordBatch.from_arrays([bucket.take(at), term.take(at), lengths, pa.array(np.maximum.reduceat(np.asarray(tf), starts)), pa.array(np.minimum.reduceat(np.asarray(dl), starts)), postings], names=names)

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = b.columns if held is None else [pa.concat_arrays(c) for c in zip(held, b.columns)]
            n = len(columns[1])
            new = np.append(True, np.asarray(pc.not_equal(columns[1].slice(1), columns[1].slice(0, n - 1))))
            first = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            starts = np.flatnonzero(place % most == 0)
            if len(starts) > 1:
                yield blocks(columns, starts[:-1], int(starts[-1]))
            held = [c.slice(int(starts[-1])) for c in columns]
        if held is not None:
            yield blocks(held, np.array([0]), len(held[1]))

    return sorted_postings.mapInArrow(run, _BLOCK)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _place(self) -> Column:
        """Term, falling frequency and length as one number, which Spark sorts without comparing rows: 32 bits of the term's hash, 12 of
        the frequency and 20 of the length, capped. Terms that share the 32 bits, and what lies beyond the caps, only make looser blocks.
        """
        rare = F.shiftleft((F.lit(4095) - F.least(F.col("tf"), F.lit(4095))).cast("long"), 20)
        return F.xxhash64("term").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(rare).bitwiseOR(F.least(F.col("dl"), F.lit((1 << 20) - 1)).cast("long"))

    def add(self, docs: DataFrame, id_col: str, text: str) -> str:
        """Indexes further documents as a segment; what is there isn't touched."""
        ship(self.spark)
        segment = uuid.uuid4().hex
        at = f"{self.path}/postings/segment={segment}"
        dealt = _postings(docs, id_col, text).withColumn("_bucket", self._bucket("term"))
        share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
        ordered = dealt.repartition(F.col("_bucket"), share).sortWithinPartitions(self._place()).select("_bucket", "term", "id", "tf", "dl")
        _blocks(ordered).write.partitionBy("_bucket").parquet(at)
        whole = self._stored(at).where((F.col("_bucket") == self._bucket(F.lit(WHOLE))) & (F.col("term") == WHOLE)).select(F.inline("postings"))
        stats = whole.agg(F.lit(segment).alias("segment"), F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_words"))
        stats.coalesce(1).write.mode("append").parquet(f"{self.path}/segments/{segment}")
        return segment

    def _stored(self, *paths: str) -> DataFrame:
        schema = _BLOCK.split(", ", 1)[1] + ", segment string, _bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*paths)

    def segments(self) -> DataFrame:
        """One row for each segment that is whole."""
        return self.spark.read.schema(_STATS).option("recursiveFileLookup", True).parquet(f"{self.path}/segments")

    def blocks(self, terms: list[str]) -> DataFrame:
        """The terms' blocks: a filter on their partitions and on the term."""
        numbers = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket("term")).collect()})
        whole = [r["segment"] for r in self.segments().select("segment").collect()]
        rows = self._stored(*(f"{self.path}/postings/segment={s}" for s in whole))
        return rows.where(F.col("_bucket").isin(numbers) & F.col("term").isin(terms))

    def search(self, query: list[str], k: int, opened: list | None = None) -> DataFrame:
        """id, score of the k best documents by BM25. ``opened`` gets the numbers of blocks read and there."""
        terms = sorted({w for q in query for w in TOKEN.findall(q.lower())})
        nothing = self.spark.createDataFrame([], "id long, score double")
        if not terms:
            return nothing
        n_docs, n_words = self.segments().agg(F.sum("n_docs"), F.sum("n_words")).first()
        blocks = self.blocks(terms)
        heads = blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.max("max_tf").alias("tf"), F.min("min_dl").alias("dl")).collect()  # a row for each term of the query
        if not heads:
            return nothing
        mean = n_words / n_docs
        idf = {r["term"]: F.log1p((F.lit(float(n_docs)) - r["df"] + 0.5) / (r["df"] + 0.5)) for r in heads}

        def weight(tf: Column, dl: Column) -> Column:
            by_term = F.coalesce(*(F.when(F.col("term") == t, v) for t, v in idf.items()))
            return by_term * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))

        best = self.spark.createDataFrame([(r["term"], r["tf"], r["dl"]) for r in heads], "term string, tf int, dl int").select("term", weight(F.col("tf"), F.col("dl")).alias("w"))
        most = {r["term"]: r["w"] for r in best.collect()}
        others = F.coalesce(*(F.when(F.col("term") == t, F.lit(sum(most.values()) - w)) for t, w in most.items()))
        bounded = blocks.withColumn("_bound", weight(F.col("max_tf"), F.col("min_dl")))

        def scores(of: DataFrame) -> DataFrame:
            each = of.select("term", F.inline("postings")).select("id", weight(F.col("tf"), F.col("dl")).alias("w"))
            return each.groupBy("id").agg(F.round(F.sum("w"), 9).alias("score"))

        # Blocks that hold enough postings between them: the highest bounds first. Their documents' scores so far are a floor.
        enough = bounded.select("_bound", "n").orderBy(F.desc("_bound")).limit(2 * k + len(terms)).agg(F.min("_bound")).first()[0]
        top = scores(bounded.where(F.col("_bound") >= enough)).orderBy(F.desc("score")).limit(k).collect()
        floor = min(r["score"] for r in top) if len(top) == k else 0.0
        # Rounding may lift or lower a score by half a unit of the ninth place.
        kept = bounded.where(F.col("_bound") + others >= floor - 1e-8)
        if opened is not None:
            opened += [kept.count(), bounded.count()]
        return scores(kept).orderBy(F.desc("score"), "id").limit(k)
