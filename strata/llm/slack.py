"""Packing by minimum bin slack: the fullest combination of the lengths at hand, found by a bitset, taken out, again.

A document's ids are those of the tokenizer's file, then one end id. Only documents longer than a sequence are cut.
Pieces of one length are alike, so a corpus is its histogram: at most ``LENGTH`` numbers, whatever its size, and that
is all the driver gets. It forms sequences one kind at a time: the longest length left must go in (so that long pieces
don't stay for the end); a subset-sum dynamic program over the lengths left, longest first, finds the fullest
combination that fits beside it. The sums reached are the bits of one number, and one shift adds a length. The
combination is taken as often as its lengths last, which leaves it the fullest one all the while, so there are some
thousand kinds at most, not one search for each sequence.

The tasks then place the pieces: the rank of a piece among those of its length says to which copy of which kind it
belongs. Ranks are row numbers in small cells of one length (``CELL_ROWS``) plus the sizes of the cells before, so a
length that a third of all pieces have isn't gathered in one task.

Ids are those of the tokenizer's file. Its vocabulary serves as ranks of a faster encoder of the same kind, with the end of a
word as a byte of its own; tests hold both equal. Texts beyond Latin letters, with the strings of special tokens or with very
long words go through the tokenizer itself.

Defined cases: a null or empty text is the end id alone; a repeated row is packed as another document; a null doc_id
stays null; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import byte_characters
from .common import arrow_schema, cut, documents, id_and_text, ship, slices

LENGTH = 4096
END_ID = 1
CELL_ROWS = 512
VOCABULARY = "word_bpe_49k"
#: Texts with these go through the tokenizer itself: outside of Latin letters and marks its own rules for case, white space and
#: composition decide, special tokens begin so, and the first character marks the ends of words here.
_OTHER = re.compile(r"[^\x01-\x1b\x20-\u024f\u2010-\u2027]|<\|")
#: Words of this length aren't prose, and the rank encoder needs much time for longer ones.
_LONG_WORD = re.compile(r"\S{2000}")
#: The tokenizer's words that aren't letters, in lower case, and what the last token of each word ends with.
_NO_LETTERS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_WORD_END = "</w>"
_MARK = b"\x00"
_RANKS = 40
_state: dict = {}


class Encoder:
    """Ids of whole texts: the vocabulary of a tokenizer's file as ranks, its words told apart as its pattern does."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(P.path(f"{name}.json"))
        byte = byte_characters()
        ranks = {}
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            core = token.removesuffix(_WORD_END)
            ranks[bytes(byte[c] for c in core) + (_MARK if core != token else b"")] = i
        self.ranks = tiktoken.Encoding(name, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [np.array(self.ids(t), "<u4").tobytes() for t in texts]

    def ids(self, text: str) -> list[int]:
        if _OTHER.search(text) or _LONG_WORD.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        words = _NO_LETTERS.sub(r" \g<0> ", text.lower()).split()
        return self.ranks.encode_ordinary("\0".join([*words, ""]))


def encoder(name: str = VOCABULARY) -> Encoder:
    if name not in _state:
        _state[name] = Encoder(name)
    return _state[name]


def token_pieces(docs: DataFrame, length: int = LENGTH, name: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and _spread, which tells even equal rows apart."""
    from pyspark import TaskContext

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, _spread long"
    schema = arrow_schema(ddl)
    end = np.array([END_ID], "<u4").tobytes()
    ship(docs.sparkSession)

    def run(batches):
        task, row = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(name)([t or "" for t in b.column(1).to_pylist()])):
                ids = memoryview(ids + end)
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), xxhash.xxh3_64_intdigest(b"%d:%d" % (task, row)) >> 1))
                    row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> Counter:
    """How often to take each length so that the sum is the largest one up to ``room``. Lengths come in rising order."""
    reached, full, mask = 1, 1 << room, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        if reached & full:
            break
        n, times = lengths[i], 1
        left = min(counts[n], room // n)
        while left > 0:
            times = min(times, left)
            more = (reached | reached << n * times) & mask
            if more != reached:
                steps.append((n, times, reached))
                reached = more
            left -= times
            times *= 2
    total, taken = reached.bit_length() - 1, Counter()
    for n, times, before in reversed(steps):
        if not before >> total & 1:  # this sum wasn't reached before the step, so the step is part of it
            taken[n] += times
            total -= n * times
    return taken


def kinds(counts: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """Sequences for all pieces: how many copies of each combination of lengths."""
    left, counts, out = sorted(n for n, c in counts.items() if c), dict(counts), []
    while left:
        longest = left[-1]
        counts[longest] -= 1
        taken = fullest(left, counts, capacity - longest)
        counts[longest] += 1
        taken[longest] += 1
        copies = min(counts[n] // times for n, times in taken.items())
        for n, times in taken.items():
            counts[n] -= copies * times
            if not counts[n]:
                left.remove(n)
        out.append((copies, taken))
    return out


class Places:
    """Where the pieces of each length lie, by their rank among those of that length."""

    def __init__(self, sequences: list[tuple[int, Counter]]):
        rows, ranks, first = [], Counter(), 0
        for copies, taken in sequences:
            offset = 0
            for n, times in sorted(taken.items(), reverse=True):
                rows.append(((n << _RANKS) + ranks[n], times, first, offset))
                ranks[n] += copies * times
                offset += n * times
            first += copies
        self.begins, self.times, self.first, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset."""
        keys = (lengths << _RANKS) + ranks
        at = np.searchsorted(self.begins, keys, "right") - 1
        copy, slot = np.divmod(keys - self.begins[at], self.times[at])
        return self.first[at] + copy, self.offset[at] + slot * lengths


def ranked(pieces: DataFrame, counts: dict[int, int], length: int) -> DataFrame:
    """Adds _rank: numbers from 0 among the pieces of one length, by cells whose number follows the length's count."""
    cells = F.lit([max(1, -(-counts.get(n, 0) // CELL_ROWS)) for n in range(length + 1)])
    dealt = pieces.withColumn("_cell", F.pmod("_spread", F.get(cells, F.col("length").cast("int"))))
    sizes = dealt.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_cell", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("_spread"))
    return dealt.withColumn("_row", row).join(before, ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces that are kept in the shared folder."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(kinds(counts, length))
    columns = [c for c in pieces.columns if c != "_spread"]
    ddl = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString().replace('bigint', 'long')}" for c in columns) + ", sequence_id long, offset long"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            sequence, offset = places(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked(pieces, counts, length).select(*columns, "_rank").mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, length: int = LENGTH, name: str = VOCABULARY) -> DataFrame:
    """Tokenised once; the narrow pieces are kept in the shared folder and packed from there."""
    return pack(cut(token_pieces(docs, length, name)), length)


def op11_pack_min_slack(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
