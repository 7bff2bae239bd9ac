"""Keyword tags, tags from a table of phrases, and keyword search over a text column."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.shipping import ship

TOKEN = "[a-z0-9]+"
#: Phrases that a trie in each Python worker may hold (some 100 MB at five words each); larger tables are joined.
TRIE_PHRASES = 100_000


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def keyword_tags(docs: DataFrame, id_col: str, text: str, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """id, tag: a tag for each document with one of its keywords. Stated keywords are tested in place, without a join."""
    words = F.array_distinct(tokens(F.col(text)))
    tags = F.array_compact(F.array(*(F.when(F.arrays_overlap("_w", F.array(*map(F.lit, ks))), F.lit(tag)) for tag, ks in keywords.items())))
    return docs.select(id_col, words.alias("_w")).select(id_col, F.explode(tags).alias("tag"))


def phrase_tags(docs: DataFrame, id_col: str, text: str, phrases: DataFrame, at_once: int = TRIE_PHRASES) -> DataFrame:
    """id, tag, n, first: how often a phrase of the tag is the longest one that begins at a token, and at which token first.

    phrases: (tag, phrase), split into tokens as the texts are. Where phrases overlap each begins at its own token, so all count; of those
    that begin at one token only the longest does, for all its tags. Up to ``at_once`` phrases are a trie that walks the texts in one
    pass; more are joined with the texts' runs of tokens of the lengths that phrases have.

    Defined cases: a phrase without tokens, a null tag and a null text match nothing; repeated phrases count once; rows that share an id add up,
    and their first is the least.
    """
    known = phrases.select(F.col("tag").cast("string").alias("tag"), tokens(F.col("phrase")).alias("_p")).where("tag IS NOT NULL AND size(_p) > 0").distinct()
    some = known.limit(at_once + 1).collect()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL")
    found = _walked(rows, [(r["tag"], r["_p"]) for r in some]) if len(some) <= at_once else _joined(rows, known)
    return found.groupBy("id", "tag").agg(F.sum("n").alias("n"), F.min("first").alias("first")).withColumnRenamed("id", id_col)


def _walked(rows: DataFrame, phrases: list[tuple[str, list[str]]]) -> DataFrame:
    """id, tag, n, first for each row, by a trie of tokens; a node is a dictionary, its tags are under the key None."""
    trie: dict = {}
    for tag, words in phrases:
        node = trie
        for w in words:
            node = node.setdefault(w, {})
        node.setdefault(None, []).append(tag)
    ship(rows.sparkSession)
    shared, split = rows.sparkSession.sparkContext.broadcast(trie), re.compile(TOKEN)

    def hits(text: str) -> dict[str, list[int]]:
        words, out = split.findall(text.lower()), {}
        for at, w in enumerate(words):
            node, tags, i = shared.value.get(w), (), at
            while node is not None:
                tags, i = node.get(None, tags), i + 1
                node = node.get(words[i]) if i < len(words) else None
            for tag in tags:
                out.setdefault(tag, [0, at])[0] += 1
        return out

    def run(batches):
        for b in batches:
            each = [(i, tag, n, first) for i, text in enumerate(b.column(1).to_pylist()) for tag, (n, first) in hits(text).items()]
            columns = [pa.array([e[k] for e in each], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(columns[0]), *columns[1:]], names=["id", "tag", "n", "first"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tag string, n long, first long")


def _joined(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """The same by a join. Equal rows are counted before it, and a run of tokens goes with its place, not with its text."""
    lengths = sorted(r[0] for r in phrases.select(F.size("_p")).distinct().collect())
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice("_w", at, n)).alias("run")))
    none = F.array().cast("array<struct<at int, n int, run string>>")
    each = rows.select("id", F.md5("_text").alias("_text"), tokens("_text").alias("_w"))
    each = each.select("id", "_text", F.inline(F.concat(*(F.when(F.size("_w") >= n, runs(n)).otherwise(none) for n in lengths))))
    met = each.join(phrases.select("tag", F.concat_ws(" ", "_p").alias("run")), "run")
    met = met.groupBy("id", "_text", "at", "n", "tag").agg(F.count(F.lit(1)).alias("_copies"))
    longest = met.withColumn("_rank", F.rank().over(Window.partitionBy("id", "_text", "at").orderBy(F.desc("n")))).where("_rank = 1")
    return longest.select("id", "tag", F.col("_copies").alias("n"), (F.col("at") - 1).cast("long").alias("first"))


def keyword_search(docs: DataFrame, id_col: str, text: str, query: list[str], k: int) -> DataFrame:
    """id, score: the k documents in which the query's words occur most often; ties by id."""
    hits = F.size(F.filter(tokens(F.col(text)), lambda w: w.isin(*(q.lower() for q in query))))
    return docs.select(id_col, hits.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)
