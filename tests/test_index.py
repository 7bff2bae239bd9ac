"""Search by the index against BM25 over all texts."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strata.operators import index
from strata.operators.index import TextIndex


def bm25(docs, query, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    terms = sorted({w for q in query for w in re.findall("[a-z0-9]+", q.lower())})
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    scores = {}
    for i, w in words.items():
        c = Counter(w)
        s = sum(math.log1p((len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if c[t])
        if any(c[t] for t in terms):
            scores[i] = round(s, 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def check(got, want):
    assert [r.id for r in got] == [i for i, _ in want] and all(abs(r.score - s) < 1e-7 for r, (_, s) in zip(got, want))


def test_search_equals_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rng = random.Random(6)
    vocabulary = [f"w{n}" for n in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (n + 1) for n in range(60)], k=rng.randrange(1, 60)))) for i in range(300)] + [(300, None), (301, ""), (302, "Zoning, ZONING zoning!")]
    idx = TextIndex(spark, f"{tmp_path}/i", 8)
    idx.add(spark.createDataFrame(docs[:200], "id long, body string"), "id", "body")
    idx.add(spark.createDataFrame(docs[200:], "id long, body string"), "id", "body")
    for query, k in ((["w0"], 5), (["w40", "w3"], 10), (["w1 w59"], 3), (["Zoning"], 5), (["w0", "w1", "w2"], 400)):
        check(idx.search(query, k).collect(), bm25(docs, query, k))
    assert idx.search(["nowhere"], 3).count() == 0 and idx.search(["?!"], 3).count() == 0
    opened = []
    check(idx.search(["w0", "w59"], 3, opened).collect(), bm25(docs, ["w0", "w59"], 3))
    assert opened[0] < opened[1]


def test_a_search_reads_its_terms_partitions(spark, tmp_path):
    idx = TextIndex(spark, f"{tmp_path}/i", 32)
    idx.add(spark.createDataFrame([(i, f"common word{i}") for i in range(100)], "id long, body string"), "id", "body")
    blocks = idx.blocks(["word7"])
    assert len({f.split("_bucket=")[1].split("/")[0] for f in blocks.inputFiles()}) > 1  # the table has more
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "EqualTo(term,word7)" in plan
    assert blocks.count() == 1


def test_a_segment_reads_its_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(t):
        seen.add(1)
        return t

    docs = spark.createDataFrame([(1, "One two, one"), (2, None), (3, ""), (4, "three")], "id long, body string").withColumn("body", F.udf(read, "string")("body"))
    idx = TextIndex(spark, f"{tmp_path}/i", 4)
    idx.add(docs, "id", "body")
    assert seen.value == 4
    assert [(r.n_docs, r.n_words) for r in idx.segments().collect()] == [(4, 4)]
    idx.add(docs.limit(0), "id", "body")
    assert sorted((r.n_docs, r.n_words) for r in idx.segments().collect()) == [(0, 0), (4, 4)]
    assert [r.id for r in idx.search(["one", "three"], 5).collect()] == [4, 1]


def test_blocks_go_on_over_batches(spark, tmp_path, monkeypatch):
    """Postings of a term come in full blocks, whatever batches they arrive in."""
    monkeypatch.setattr(index, "BLOCK", 8)
    monkeypatch.setattr(index, "SHARES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        idx = TextIndex(spark, f"{tmp_path}/i", 2)
        idx.add(spark.createDataFrame([(i, "a " * (i % 7) + f"b c{i % 3}") for i in range(50)], "id long, body string"), "id", "body")
        got = idx.blocks(["a", "b", "c0", "c1", "c2"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = {t: sorted(r.n for r in got if r.term == t) for t in ("a", "b", "c0")}
    assert sizes == {"a": [2, *[8] * 5], "b": [2, *[8] * 6], "c0": [1, 8, 8]}
    for r in got:
        tfs = [p.tf for p in r.postings]
        assert len(tfs) == r.n and r.max_tf == max(tfs) == tfs[0] and tfs == sorted(tfs, reverse=True) and r.min_dl == min(p.dl for p in r.postings)
    assert sorted(p.id for r in got if r.term == "b" for p in r.postings) == list(range(50))
