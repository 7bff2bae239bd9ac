"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, per randomised group.

A document's ids are those of the byte-level BPE vocabulary, then one end id. They are cut at multiples of the sequence
length, so full pieces fill a sequence alone and each document has at most one shorter piece left. Those remainders are
dealt by a hash of their id into groups of about ``group_rows`` and each group is packed alone: pieces by falling length
go to the first open sequence with room, found by descending a tournament tree whose inner nodes hold the largest room
below them. Groups hold so many pieces that the room left open at their ends doesn't matter.

Only lengths and checksums are shuffled: the CRC of each piece is taken where its text is tokenised.

Defined cases: a null or empty text is the end id alone; a repeated row is packed as another document; an empty table
gives no rows; the ids of one text are held by the task that tokenises it, four bytes each, whatever its length.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, documents, id_and_text, ship, slices

LENGTH = 1024
END_ID = 0
GROUP_ROWS = 4096
VOCABULARY = "byte_bpe_50k"
_END_OF_TEXT = "<|endoftext|>"
#: Runs of white space of this length or more exhaust the stack of the rank encoder's pattern matcher when they grow further.
_LONG_SPACE = re.compile(r"\s{10000}")
_state: dict = {}


def _ranks(name: str):
    if name not in _state:
        import public_tokenizers as P
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(f"{name}.tiktoken"), "rb"))}
        _state[name] = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _state[name]


def _tokenizer(name: str):
    if (name, "file") not in _state:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        _state[name, "file"] = Tokenizer.from_file(P.path(f"{name}.json"))
    return _state[name, "file"]


def token_bytes(text: str, name: str = VOCABULARY) -> bytes:
    """All ids of a text as little-endian 32-bit numbers.

    The same vocabulary as ranks gives the same ids about six times as fast (tests hold both against each other); a
    text with the special string, which only the tokenizer's file knows, or with a very long run of white space, which
    the ranks' pattern can't take, goes through that file.
    """
    if _END_OF_TEXT in text or _LONG_SPACE.search(text):
        ids = _tokenizer(name).encode(text, add_special_tokens=False).ids
    else:
        ids = _ranks(name).encode_ordinary(text)
    return np.array(ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, length: int = LENGTH, name: str = VOCABULARY) -> DataFrame:
    """One row per piece of at most ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    schema = arrow_schema(ddl)
    end = np.array([END_ID], "<u4").tobytes()
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = memoryview(token_bytes(text or "", name) + end)
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. The tree has a leaf for each bin that may be opened, all with their whole room."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces. A group's number fills the upper bits of its sequences' ids."""
    left = pieces.where(F.col("length") < length)
    groups = F.greatest(F.lit(1), F.ceil(left.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(group_rows))).cast("long")
    spread = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    ddl = ", ".join(f"{f.name} long" for f in pieces.schema) + ", sequence_id long, offset long"

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=pdf["_group"] * (1 << 32) + bins, offset=offsets).drop(columns="_group")

    packed = left.withColumn("_group", F.pmod(spread, groups) * 2).groupBy("_group").applyInPandas(per_group, ddl)
    # Odd group numbers are those of full pieces: one sequence each, numbered within the task that holds them.
    task, row = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = F.shiftleft(task * F.lit(2) + 1, 32) + row
    full = pieces.where(F.col("length") == length).withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})
    return packed.select(*full.columns).unionByName(full)


def pack_documents(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tokenised once; the narrow pieces are kept in the shared folder and packed from there."""
    return pack(cut(token_pieces(docs, length)), length, group_rows)


def op6_pack_ffd(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
