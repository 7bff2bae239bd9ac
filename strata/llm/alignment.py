"""Alignment of two tokenizers over the same bytes: divide and conquer at places where tokens of both end.

An interval of a text that holds the tokens of both vocabularies is cut at a common end near its middle: bisection finds
the end of a token of the first vocabulary next to the middle, and further ones on both sides in turn, until bisection
in the second one finds it there too; both halves go on alike, and an interval without such an end is a leaf group. The
last tokens of both in a group end together, which links them.

Both vocabularies end a token before a single space after a visible character, whatever stands around (no piece of the second one has
a space after another character). Those cuts are taken first, so each different stretch between them is tokenised and divided
once in a chunk of documents, all stretches as one text. Then:

1. One pass puts documents into chunks of about ``CHUNK_CHARS`` characters: what is known of each document, which
   stretches it has, which links each stretch has, and how often each different link occurs in the chunk.
2. Links are counted over all chunks, and the most frequent ones of each id of the second vocabulary are marked, by
   aggregations and a window over different links (at most the first vocabulary's size for one id).
3. Each chunk is joined with the counts of its different links, and sums them by stretch, then by document.

A link shared by all documents is one row a chunk, and the skew of that join is left to adaptive execution.

Defined cases: a text that is null, empty, or whose tokens of either kind don't give back its bytes (for instance since
it has the second vocabulary's space mark itself) has no tokens: zeros and an empty hash, and no part in the counts.
Strings of special tokens are plain text. Repeated rows count as often as they occur, null ids stay null, an empty table gives no
rows, and other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, keep, ship, slices

FIRST = "byte_bpe_50k.json"
FIRST_RANKS = "byte_bpe_50k.tiktoken"
SECOND = "piece_bpe_32k.model"
CHUNK_CHARS = 2_000_000
#: Stretches that the second tokenizer gets at once.
BLOCK = 500
#: A link is the first vocabulary's id times this plus the second one's.
SHIFT = 32
_UNEVEN = re.compile(r"\s | \Z|\A ")
_LONG_RUN = re.compile(r"\s{64}|\S{2000}")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
_state: dict = {}


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256, 257, ... in order."""
    own = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, first: str = FIRST, ranks: str = FIRST_RANKS, second: str = SECOND):
        import public_tokenizers as P
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(P.path(first))
        self.first.encode_special_tokens = True
        by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(ranks), "rb"))}
        self.ranks = tiktoken.Encoding(first, pat_str=P.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=P.path(second))
        byte = byte_characters()
        vocabulary = self.first.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else b""
        pieces = map(self.second.id_to_piece, range(self.second.get_piece_size()))
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.match(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for parts that are one text with a space between any two: of a space and the text by the first, of each part by
        the second, which adds the space itself (and is slow for long texts).

        The first vocabulary's ranks give the ids of its file, and faster; long runs of one kind, which their pattern can't take, go through the file.
        """
        text = "".join([f" {p}" for p in parts])
        a = self.first.encode(text, add_special_tokens=False).ids if _LONG_RUN.search(text) else self.ranks.encode_ordinary(text)
        return np.array(a, np.int64), np.array(list(chain.from_iterable(self.second.encode(parts, num_threads=1))), np.int64)

    def aligned(self, *parts: str) -> Aligned | None:
        """The groups of a whole text, or of one in parts between which both end a token; nothing where the bytes differ."""
        a, b = self.ids(list(parts))
        whole = "".join([f" {p}" for p in parts]).encode()
        if not all(parts) or any(b"".join(map(of.__getitem__, x.tolist())) != whole for of, x in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        after_a, after_b = common_ends(ends_a, ends_b)
        links = (a[after_a - 1] << SHIFT) + b[after_b - 1]
        names_a, names_b = ([self.names[i] for i in x.tolist()] for x in (a, b))
        groups, i, k = [], 0, 0
        for j, m in zip(after_a.tolist(), after_b.tolist()):
            groups.append(f"{names_a[i]}|{names_b[k]}" if j - i == m - k == 1 else f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}")
            i, k = j, m
        return Aligned(ends_a[after_a - 1], after_a, after_b, groups, links)

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[np.ndarray]]:
        """n_a, n_b, groups as text and links of each stretch; n_a is 0 where the bytes differ.

        Stretches that begin and end visibly are one text between single spaces, cut again where they end.
        """
        n_a, n_b, groups, links = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and t[0] != " " and not t[-1].isspace() and "▁" not in t and not (len(t) >= 64 and _LONG_RUN.search(t))]
        blocks = [" ".join([texts[i] for i in plain[at : at + BLOCK]]) for at in range(0, len(plain), BLOCK)]
        whole = self.aligned(*blocks) if plain else None
        if whole is not None:
            ends = np.cumsum([len(texts[i].encode()) + 1 for i in plain])
            last = np.searchsorted(whole.ends, ends)
            assert (whole.ends[last] == ends).all(), "both vocabularies end a token where a stretch ends"
            bounds = np.concatenate(([0], last + 1))
            own = np.array(plain)
            n_a[own], n_b[own] = (np.diff(np.concatenate(([0], x[last]))) for x in (whole.after_a, whole.after_b))
            for i, x, y in zip(plain, bounds.tolist(), bounds[1:].tolist()):
                groups[i], links[i] = ";".join(whole.groups[x:y]), whole.links[x:y]
        done = set(plain) if whole is not None else set()
        for i, t in enumerate(texts):
            if i not in done and (one := self.aligned(t)) is not None:
                n_a[i], n_b[i], groups[i], links[i] = one.after_a[-1], one.after_b[-1], ";".join(one.groups), one.links
        return n_a, n_b, groups, links


class Aligned(NamedTuple):
    """Of each group: where it ends in bytes, how many tokens of both lie up to there, its text, its link."""

    ends: np.ndarray
    after_a: np.ndarray
    after_b: np.ndarray
    groups: list[str]
    links: np.ndarray


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of both lie before each common end, in order; both rise and have their last end in common.

    All intervals of one depth are divided at once. An interval is its token numbers [i, j) and [k, m); their last ends are its
    own end.
    """
    i, j, k, m = (np.array([x]) for x in (0, len(a), 0, len(b)))
    after_a, after_b = [], []
    while len(i):
        x, y = _near_middle(a, b, i, j, k, m)
        leaf = x < 0
        after_a.append(j[leaf])
        after_b.append(m[leaf])
        i, j, k, m, x, y = (v[~leaf] for v in (i, j, k, m, x, y))
        i, j, k, m = np.concatenate((i, x)), np.concatenate((x, j)), np.concatenate((k, y)), np.concatenate((y, m))
    return np.sort(np.concatenate(after_a)), np.sort(np.concatenate(after_b))


def _near_middle(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers after the common end nearest the middle of each interval, its own end left out; -1 where there is none."""
    x, y = np.full(len(i), -1), np.full(len(i), -1)
    start = np.where(i > 0, a[i - 1], 0)
    middle = np.clip(np.searchsorted(a, (start + a[j - 1]) // 2), i, j - 1)
    left, away = np.flatnonzero((j - i > 1) & (m - k > 1)), 0
    while len(left):
        for at in (middle[left] + away, middle[left] - 1 - away):
            inside = (at >= i[left]) & (at < j[left] - 1) & (x[left] < 0)
            own, end = left[inside], a[at[inside]]
            there = np.searchsorted(b, end)
            both = b[there] == end
            x[own[both]], y[own[both]] = at[inside][both] + 1, there[both] + 1
        away += 1
        left = left[(x[left] < 0) & ((middle[left] + away < j[left] - 1) | (middle[left] - 1 - away >= i[left]))]
    return x, y


def vocabularies() -> Vocabularies:
    if "both" not in _state:
        _state["both"] = Vocabularies()
    return _state["both"]


def stretches(text: str) -> list[str]:
    """A text cut at its single spaces between visible characters."""
    parts = text.split(" ")
    if parts == text.split() or not _UNEVEN.search(text):
        return parts
    out = [[parts[0]]]
    for before, part in zip(parts, parts[1:]):
        if before and not before[-1].isspace() and part:
            out.append([part])
        else:
            out[-1].append(part)
    return [" ".join(x) for x in out]


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("stretches", pa.list_(pa.int32()))])
STRETCH = pa.schema([("links", pa.list_(pa.int32()))])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def chunk_of(ids: list, texts: list[str | None], both: Vocabularies) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Documents and stretches as Arrow streams, different links and how often the chunk has each."""
    cuts = [stretches(t) if t else [] for t in texts]
    number = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(cuts)))}
    n_a, n_b, groups, links = both.stretches(list(number))
    own = np.fromiter(map(number.__getitem__, chain.from_iterable(cuts)), np.int32)
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int32)
    many = np.array([len(x) for x in links], np.int64)
    total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values[own])))[bounds])
    sound = (total((n_a == 0).astype(np.int64)) == 0) & (np.diff(bounds) > 0)
    own = own[np.repeat(sound, np.diff(bounds))]
    bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) * sound))).astype(np.int32)
    names, at = own.tolist(), bounds.tolist()
    digests = [hashlib.sha256(";".join([groups[i] for i in names[x:y]]).encode()).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]
    different, which = np.unique(np.concatenate([*links, np.zeros(0, np.int64)]), return_inverse=True)
    counts = np.bincount(which, np.repeat(np.bincount(own, minlength=len(many)), many), len(different)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(many)))
    by_stretch = pa.table([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(which, pa.int32()))], schema=STRETCH)
    columns = [pa.array(ids, pa.int64()), *(pa.array(total(x)) for x in (n_a, n_b, many, many)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(own))]
    return _stored(pa.table(columns, schema=DOCUMENT)), _stored(by_stretch), different, counts


def chunked(docs: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """chunk, documents, stretches, links, counts; links are in rising order."""
    ship(docs.sparkSession)
    from pyspark import TaskContext

    ddl = "chunk long, documents binary, stretches binary, links array<long>, counts array<long>"
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(batches):
        ids, texts, held, number = [], [], 0, 0

        def row():
            documents, stretches, links, counts = chunk_of(ids, texts, vocabularies())
            values = [[(TaskContext.get().partitionId() << 32) + number], [documents], [stretches], [links], [counts]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds)], names=names)

        for b in slices(batches, 64):
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            held += b.column(1).nbytes
            if held >= chars:
                yield row()
                ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    return id_and_text(docs).mapInArrow(run, ddl)


def link_counts(chunks: DataFrame) -> DataFrame:
    """link, count over all chunks, best: no link of the same second id has a higher one."""
    pairs = chunks.select(F.inline(F.arrays_zip(F.col("links").alias("link"), F.col("counts").alias("n")))).where("n > 0")
    counted = pairs.groupBy("link").agg(F.sum("n").alias("count"))
    second = F.col("link").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(second)))


def _scored(chunks: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
    out = []
    counted = counted.sort_values("link")
    for documents, stretches, links in zip(chunks["documents"], chunks["stretches"], chunks["links"]):
        docs, by_stretch = _read(documents), _read(stretches).column("links").combine_chunks()
        # A link of no valid document has no count and isn't asked for.
        count, best = np.zeros((2, len(links)), np.int64)
        at = np.searchsorted(links, counted["link"].to_numpy())
        count[at], best[at] = counted["count"].to_numpy(), counted["best"].to_numpy()
        by_stretch = [_sums(by_stretch, x) for x in (best, count)]
        own = docs.column("stretches").combine_chunks()
        table = docs.drop_columns("stretches").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        table["n_best"], table["count_sum"] = (_sums(own, x) for x in by_stretch)
        out.append(table)
    columns = [f.split()[0] for f in RESULT.split(", ")]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def _sums(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """The sum of values at the places of each list."""
    ends = np.concatenate(([0], np.cumsum(values[lists.values.to_numpy()])))
    offsets = lists.offsets.to_numpy()
    return ends[offsets[1:]] - ends[offsets[:-1]]


def align(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = keep(chunked(docs), "aligned")
    asked = chunks.select(F.col("chunk").alias("asker"), F.inline(F.arrays_zip(F.col("links").alias("link"), F.col("counts").alias("n")))).where("n > 0").drop("n")
    answers = asked.join(link_counts(chunks), "link")
    by_chunk = chunks.select("chunk", "documents", "stretches", "links").groupBy("chunk")
    return by_chunk.cogroup(answers.groupBy("asker")).applyInPandas(_scored, RESULT)


def op13_align_tokenizers(spark, sf_dir):
    return align(documents(spark, sf_dir))
