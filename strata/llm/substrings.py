"""Exact removal of repeated passages: difference-cover anchors find them, extension to whole windows decides.

A window is ``window`` consecutive words. Anchors are shorter runs of ``window - PERIOD + 1`` words that start where the
word number modulo PERIOD lies in a difference cover. For any two places there is a shift below PERIOD that brings both
onto the cover, so two equal windows always share an anchor at one offset; a window none of whose anchors occurs twice
is unique. Hence:

1. Documents are put into chunks (about ``CHUNK_CHARS`` characters, compressed) in a table in the shared folder.
2. Each chunk sends the hashes of its anchors, dealt by hash into buckets, and gets back one bit per anchor: seen twice.
3. Extension: a window that holds an anchor seen twice may be a repeat. Each chunk sends the 128-bit hashes of such
   windows with their place; the bucket keeps the earliest place of each and answers with one bit per window.
4. Each chunk drops the words under windows that aren't the earliest of their kind.

Groups of copies never meet as pairs: a bucket sorts hashes, so thousands of copies of a passage cost as many rows.
A bucket gets the number of hashes that ``BUCKET_HASHES`` says, however many there are in all; a hash that is itself very
frequent is first reduced inside each chunk, to one row for each chunk (anchors) or to its earliest place (windows).

Order of places: smaller doc_id, then earlier start; rows with equal ids are ordered by chunk and row (nulls come last).
Defined cases: null or empty text has no words, n_words 0 and the hash of the empty string; texts shorter than a window
stay whole; an empty table gives no rows; repeated rows are documents that repeat each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, documents, id_and_text, keep, ship, slices

WINDOW = 20
PERIOD = 13
#: Every difference modulo 13 is the difference of two of these.
COVER = (0, 1, 3, 9)
CHUNK_CHARS = 2_000_000
BUCKET_HASHES = 400_000
LAST_ID = (1 << 63) - 1


def chunked(docs: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """chunk, n_words, blob: runs of whole documents as compressed Arrow batches."""
    ship(docs.sparkSession)
    from pyspark import TaskContext

    ddl = "chunk long, n_words long, blob binary"
    schema = arrow_schema(ddl)

    def packed(parts, number):
        table = pa.Table.from_batches(parts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        words = sum(len(t.encode().split()) for t in table.column(1).to_pylist() if t)
        blob = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.array([words]), pa.array([blob], pa.binary())], schema=schema)

    def run(batches):
        parts, held, number = [], 0, 0
        for b in slices(batches, 64):
            parts.append(b)
            held += b.column(1).nbytes
            if held >= chars:
                yield packed(parts, number)
                parts, held, number = [], 0, number + 1
        if parts:
            yield packed(parts, number)

    return id_and_text(docs).mapInArrow(run, ddl)


class Chunk:
    """The documents of a chunk as one stream of words with the places where each word and document starts."""

    def __init__(self, blob: bytes):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
        self.ids = table.column(0).to_pylist()
        words = [t.encode().split() if t else [] for t in table.column(1).to_pylist()]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.words = [w for doc in words for w in doc]
        self.joined = b" ".join(self.words)
        ends = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32) if self.words else np.zeros(0, np.int64)
        self.begin = np.concatenate(([0], ends + 1)).tolist()
        self.end = np.append(ends, len(self.joined)).tolist()
        self.doc = np.repeat(np.arange(len(words)), self.counts)
        #: Number of each word in its document, and how many words follow it there, itself included.
        self.place = np.arange(len(self.words)) - self.first[self.doc] if self.words else np.zeros(0, np.int64)
        self.left = self.counts[self.doc] - self.place if self.words else np.zeros(0, np.int64)

    def anchors(self, window: int) -> np.ndarray:
        return np.flatnonzero((self.left >= window - PERIOD + 1) & np.isin(self.place % PERIOD, COVER))

    def hash64(self, at: np.ndarray, n: int) -> np.ndarray:
        text, begin, end, h = memoryview(self.joined), self.begin, self.end, xxhash.xxh3_64_intdigest
        return np.fromiter((h(text[begin[i] : end[i + n - 1]]) for i in at.tolist()), np.uint64, len(at))

    def hash128(self, at: np.ndarray, n: int) -> np.ndarray:
        """Two columns of 64 bits."""
        text, begin, end, h = memoryview(self.joined), self.begin, self.end, xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([h(text[begin[i] : end[i + n - 1]]) for i in at.tolist()]), "<u8").reshape(-1, 2)

    def candidates(self, window: int, anchors: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """Windows that hold an anchor which occurs twice."""
        starts = np.flatnonzero(self.left >= window)
        seen = np.zeros(len(self.words) + 1, np.int64)
        seen[anchors[twice] + 1] = 1
        seen = np.cumsum(seen)
        return starts[seen[starts + PERIOD] > seen[starts]]


def _dealt(hashes: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Item numbers by bucket, in order, of the buckets that have any: the work depends on the hashes, not on the buckets."""
    b = (hashes >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    own, first = np.unique(b[order], return_index=True)
    return dict(zip(own.tolist(), np.split(order, first[1:])))


def _ask_anchors(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """chunk, bucket, hashes: the different anchors of each chunk, in order of their hash."""
    ddl = "chunk long, bucket int, hashes binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(2)):
                c = Chunk(blob.as_py())
                h = np.unique(c.hash64(c.anchors(window), window - PERIOD + 1))
                rows = [(chunk, k, h[at].tobytes()) for k, at in _dealt(h, buckets).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return chunks.mapInArrow(run, ddl)


def _answer_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bit per hash, in the order asked: another chunk has it too."""
    parts = [np.frombuffer(x, "<u8") for x in pdf["hashes"]]
    _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared, at = counts[inverse] > 1, np.cumsum([len(x) for x in parts])[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "mask": [np.packbits(x).tobytes() for x in np.split(shared, at)]})


def _later(h: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Marks each row that has an earlier row with the same 128-bit hash."""
    order = np.lexsort((*reversed(place), h[:, 1], h[:, 0]))
    later = np.zeros(len(h), bool)
    s = h[order]
    later[order[1:]] = (s[1:] == s[:-1]).all(axis=1)
    return later


def _ask_windows(chunks: pd.DataFrame, masks: pd.DataFrame, window: int, buckets: int) -> pd.DataFrame:
    """Windows that may repeat. Those repeated inside the chunk are settled here and pass on as rows below bucket 0."""
    rows = []
    for chunk, blob in zip(chunks["chunk"], chunks["blob"]):
        c = Chunk(blob)
        anchors = c.anchors(window)
        different, inverse, counts = np.unique(c.hash64(anchors, window - PERIOD + 1), return_inverse=True, return_counts=True)
        twice, asked = counts > 1, _dealt(different, buckets)
        for bucket, mask in zip(masks["bucket"], masks["mask"]):
            twice[asked[bucket]] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=len(asked[bucket])).astype(bool)
        at = c.candidates(window, anchors, twice[inverse])
        if not len(at):
            continue
        h, ids = c.hash128(at, window), np.array([LAST_ID if i is None else i for i in c.ids], np.int64)
        doc_id, start = ids[c.doc[at]], c.place[at]
        later = _later(h, doc_id, start, at)
        rows.append((chunk, -1 - int(chunk) % buckets, b"", at[later].astype("<i8").tobytes()))
        h, place = h[~later], np.stack([doc_id, start, at])[:, ~later]
        for k, own in _dealt(h[:, 0], buckets).items():
            delta = np.diff(place[:, own], axis=1, prepend=0).astype("<i8").tobytes()
            rows.append((chunk, k, h[own].tobytes(), zstandard.ZstdCompressor(level=1).compress(delta)))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "hashes", "places"])


def _answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """chunk, starts: word numbers in the chunk where a window starts that isn't the earliest with its words."""
    if pdf["bucket"].iloc[0] < 0:
        return pd.DataFrame({"chunk": pdf["chunk"], "starts": pdf["places"]})
    hashes = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in pdf["hashes"]]
    sizes = [len(x) for x in hashes]
    d = zstandard.ZstdDecompressor()
    place = np.concatenate([np.cumsum(np.frombuffer(d.decompress(x), "<i8").reshape(3, -1), axis=1) for x in pdf["places"]], axis=1)
    later = _later(np.concatenate(hashes), place[0], place[1], np.repeat(pdf["chunk"].to_numpy(), sizes), place[2])
    cuts = np.cumsum(sizes)[:-1]
    return pd.DataFrame({"chunk": pdf["chunk"], "starts": [a[m].astype("<i8").tobytes() for a, m in zip(np.split(place[2], cuts), np.split(later, cuts))]})


def _without(chunks: pd.DataFrame, removed: pd.DataFrame, window: int) -> pd.DataFrame:
    rows = []
    for blob in chunks["blob"]:
        c = Chunk(blob)
        edges = np.zeros(len(c.words) + 1, np.int64)
        for starts in removed["starts"]:
            starts = np.frombuffer(starts, "<i8")
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
        gone = np.cumsum(edges)[:-1] > 0
        for i, doc_id in enumerate(c.ids):
            a, b = int(c.first[i]), int(c.first[i + 1])
            out = gone[a:b]
            words = c.words[a:b] if not out.any() else [c.words[a + k] for k in np.flatnonzero(~out).tolist()]
            rows.append((doc_id, b - a, b - a - len(words), b" ".join(words).decode()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])
    return out.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    chunks = keep(chunked(docs), "chunks")
    words = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, round(words * len(COVER) / PERIOD / BUCKET_HASHES))
    asked = _ask_anchors(chunks, window, buckets)
    masks = asked.groupBy("bucket").applyInPandas(_answer_anchors, "chunk long, bucket int, mask binary")
    by_chunk = chunks.select("chunk", "blob").groupBy("chunk")
    may = by_chunk.cogroup(masks.groupBy("chunk")).applyInPandas(lambda a, b: _ask_windows(a, b, window, buckets), "chunk long, bucket int, hashes binary, places binary")
    removed = may.groupBy("bucket").applyInPandas(_answer_windows, "chunk long, starts binary")
    return by_chunk.cogroup(removed.groupBy("chunk")).applyInPandas(lambda a, b: _without(a, b, window), "doc_id long, n_words long, n_removed long, kept string")


def op9_repeats_difference_cover(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
