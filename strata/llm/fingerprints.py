"""Threshold-scaled sketches: a document keeps every shingle hash below a fixed fraction of the hash range.

The sketch of a union is the union of sketches, so sketches of parts merge, and the share of one sketch found in another
estimates containment even where one document is far longer. Shingles are five consecutive words (a shorter text is one
shingle of all its words). The fingerprint is the sorted hashes, in base64 of 64-bit little-endian numbers.

Likeness of two sketches is the share of the smaller one found in the larger. Two empty sketches (no words, or so few that
no hash fell below the threshold) are like 1 if they stem from equal texts, else 0.

Neighbours: the next document by falling doc_id is needed for the edited text. Documents are dealt into ranges of ids whose
bounds come from approximate percentiles; only the head of each range (one row) is also dealt to the range before, so
no window spans the table. Equal ids follow each other by their text's hash; null ids come last.

Defined cases: a null text is empty (n_chars 0, empty fingerprint); in a table of one row the next document is itself; an empty
table gives no rows; very long texts are streamed through the same code.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, documents, id_and_text, map_texts, ship, slices

SHINGLE = 5
FRACTION = 4  # one of so many hashes stays: of texts of 12 words (8 shingles) a tenth keeps none, of 20 words a hundredth
RANGE_ROWS = 1024
MOST_RANGES = 20_000
_LIMIT = np.uint64((1 << 64) // FRACTION)


def sketch(text: str) -> np.ndarray:
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[:-1])]
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((digest(view[a:b]) for a, b in zip(begins[:n], ends[min(SHINGLE, len(words)) - 1 :])), np.uint64, n)
    return np.unique(h[h < _LIMIT])


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of all the documents together."""
    return np.unique(np.concatenate(sketches)) if sketches else np.zeros(0, np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    if equal:
        return 1.0
    small, large = sorted((a, b), key=len)
    return containment(small, large)


def encoded(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint: the sketch alone, without neighbours."""
    return map_texts(docs, lambda t: (len(t), encoded(sketch(t))), "n_chars long, fingerprint string")


def with_heads(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, range, head, in order inside each partition: the rows of a range by falling id, then copies (head 1)
    of the first row that follows the range, which for the last range is the first row of all.
    """
    rows = id_and_text(docs)
    ranges = min(MOST_RANGES, max(1, rows.count() // range_rows))
    at = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("doc_id", at, 10 * ranges)).first()[0] if at else []
    bounds = sorted(set(map(float, found or [0])))
    split = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_id", outputCol="_bucket")
    rows = split.transform(rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))))
    rows = rows.select("doc_id", "text", (F.lit(len(bounds)) - F.col("_bucket")).cast("int").alias("range"))
    # One row per range, at most MOST_RANGES in all: its largest id, which is where it starts.
    tops = sorted((r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    heads = [(r, top, tops[i - 1][0]) for i, (r, top) in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(heads, "h_range int, h_top long, before int")
    first = (F.col("range") == F.col("h_range")) & F.col("doc_id").eqNullSafe(F.col("h_top"))
    placed = rows.join(F.broadcast(heads), first, "left").select(
        "doc_id",
        "text",
        F.explode(F.array_compact(F.array(F.struct("range", F.lit(0).alias("head")), F.when(F.col("h_range").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(1).alias("head")))))).alias("p"),
    )
    placed = placed.select("doc_id", "text", "p.range", "p.head")
    return placed.repartition("range").sortWithinPartitions("range", "head", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def neighbour_likeness(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its last third replaced by the start of the next document) and the next document's."""
    ship(docs.sparkSession)
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_edited double, containment_next double"
    schema = arrow_schema(ddl)

    def one(doc, after):
        doc_id, text, own = doc
        _, next_text, next_own = after
        cut_off = len(text) // 3
        edited = text[: len(text) - cut_off] + next_text[:cut_off]
        other = sketch(edited)
        return (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            encoded(own),
            encoded(other),
            likeness(own, other, text == edited),
            likeness(own, next_own, text == next_text),
            containment(own, other),
            containment(own, next_own),
        )

    def run(batches):
        held, place = None, None
        for b in slices(batches):
            out = []
            for doc_id, text, where, head in zip(*(c.to_pylist() for c in b.columns)):
                row = (doc_id, text or "", sketch(text or "")) if held or not head else None
                if held and where == place:
                    out.append(one(held, row))
                held, place = (None if head else row), where
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return with_heads(docs, range_rows).mapInArrow(run, ddl)


def op5_scaled_sketch(spark, sf_dir):
    return neighbour_likeness(documents(spark, sf_dir))
