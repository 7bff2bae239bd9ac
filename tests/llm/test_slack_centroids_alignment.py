"""Minimum bin slack, filtered k-means and tokenizer alignment against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import alignment, centroids, queries, slack

ODD_TEXTS = ["", "a  b\n\n c", "it's 12 ½ ²x", "<|endoftext|> a <|startoftext|>b", "x́ 1́\x85 \x1c y\x1fz", "日本 語\n x", "▁a b", "a\x00b c", " lead", "trail ", "  two  spaces  ", "\t tab \n", "İstanbul ΑΣ ΑΣ.", "e ́x", "a b  c　", "don't we'll I'M", "a​ zero", "😀😀 a", "word" * 2000, " " * 3000, "a " * 500 + " ", "<0x41> x", "</w> </s> <s> <unk>"]


def texts_of(spark, sf_dir):
    return [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def table(spark, path, rows, ddl, name="documents"):
    spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
    return str(path)


# --- minimum bin slack


def test_ids_equal_whole_texts(spark, sf_dir):
    texts = [*texts_of(spark, sf_dir), *ODD_TEXTS]
    whole = Tokenizer.from_file(public_tokenizers.path(f"{slack.VOCABULARY}.json"))
    for t, ids in zip(texts, slack.Encoder()(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:50]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 60))
def test_fullest_against_all_subsets(sizes, room):
    counts = collections.Counter(sizes)
    taken = slack.fullest(sorted(counts), counts, room)
    assert all(taken[n] <= counts[n] for n in taken)
    assert sum(n * k for n, k in taken.items()) == max(s for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if (s := sum(c)) <= room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=15))
def test_kinds_and_places_hold_each_piece_once(counts):
    sequences = slack.kinds(counts, 40)
    used = collections.Counter()
    for copies, taken in sequences:
        assert copies > 0 and sum(n * k for n, k in taken.items()) <= 40
        used += collections.Counter({n: copies * k for n, k in taken.items()})
    assert used == collections.Counter(counts)
    place, filled = slack.Places(sequences), collections.defaultdict(list)
    for n, c in counts.items():
        for s, o in zip(*place(np.full(c, n), np.arange(c))):
            filled[s].append((o, n))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 40
    assert len(filled) == sum(c for c, _ in sequences)


def checked(rows, texts):
    encoder = slack.Encoder()
    want = collections.Counter()
    for doc_id, t in texts:
        ids = encoder([t or ""])[0] + np.array([1], "<u4").tobytes()
        for piece, a in enumerate(range(0, len(ids), 4 * 4096)):
            want[doc_id, piece, a // 4, len(ids[a : a + 4 * 4096]) // 4, zlib.crc32(ids[a : a + 4 * 4096])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 4096
    return len(by_sequence)


def test_op11_over_the_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op11_pack_min_slack"](spark, sf_dir).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert checked(rows, texts) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_op11_odd_rows_many_cells_and_no_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slack, "CELL_ROWS", 7)
    rows = [(1, None, 1, 2), (1, "", 1, 2), (None, "x y z", 1, 2), (2, "word " * 30_000, 1, 2), *[(3, "same text here", 1, 2)] * 100]
    ddl = "doc_id long, text string, piece long, _rank long"
    got = queries.QUERIES["op11_pack_min_slack"](spark, table(spark, tmp_path / "a", rows, ddl)).collect()
    assert checked(got, [r[:2] for r in rows]) == -(-sum(r.length for r in got) // 4096)
    assert queries.QUERIES["op11_pack_min_slack"](spark, table(spark, tmp_path / "b", [], ddl)).collect() == []


# --- filtered k-means


def brute_force(rows, clusters=8, rounds=10):
    kept = [(i, tuple(int(np.floor(1024 * np.float64(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:clusters]
    vectors, means = np.array([v for _, v in kept], object), [list(v) for _, v in start]
    for turn in range(rounds + 1):
        d = [[int(((v - np.array(m, object)) ** 2).sum()) for m in means] for v in vectors]
        cluster = [x.index(min(x)) for x in d]
        if turn < rounds:
            for c in range(len(means)):
                own = [v for v, k in zip(vectors, cluster) if k == c]
                if own:
                    means[c] = [int(x) // len(own) for x in np.sum(own, axis=0)]
    distance = [x[c] for x, c in zip(d, cluster)]
    inertia = [sum(x for x, k in zip(distance, cluster) if k == c) for c in range(len(means))]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return collections.Counter((i, c, x, inertia[c], sum(inertia), names[c]) for (i, _), c, x in zip(kept, cluster, distance))


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_op12_over_the_embeddings(spark, sf_dir):
    got = queries.QUERIES["op12_pca_filtered_kmeans"](spark, sf_dir).select(*COLUMNS).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert collections.Counter(map(tuple, got)) == brute_force(rows)
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    assert collections.Counter(map(tuple, got)) == collections.Counter(duckdb.sql(f"SELECT {','.join(COLUMNS)} FROM ({centroids.ORACLE_SQL})").fetchall())


def test_op12_odd_vectors(spark, tmp_path):
    rng = random.Random(4)
    vector = lambda scale=1.0: [rng.choice([-1, 0, 0.5, 1]) * scale for _ in range(64)]
    rows = [(i, vector()) for i in range(40)] + [(7, vector()), (7, [0.0] * 64), (7, [0.0] * 64), (None, vector()), (50, vector(100_000.0)), (51, None), (52, [1.0] * 63), (53, [1.0] * 63 + [None]), (54, [1.0] * 63 + [float("nan")]), (55, [float("inf")] * 64), (56, [])]
    rows += [(60, [2.0] * 64)] * 30
    ddl = "vec_id long, embedding array<double>, cluster int, v string"
    query = queries.QUERIES["op12_pca_filtered_kmeans"]
    for name, part in (("all", rows), ("few", rows[:3]), ("one", rows[:1])):
        got = query(spark, table(spark, tmp_path / name, [(*r, 9, "x") for r in part], ddl, "embeddings")).select(*COLUMNS).collect()
        assert collections.Counter(map(tuple, got)) == brute_force(part)
    assert query(spark, table(spark, tmp_path / "none", [], ddl, "embeddings")).collect() == []
    with pytest.raises(Exception, match="too large"):
        query(spark, table(spark, tmp_path / "large", [(1, [1e30] * 64, 1, "")], ddl, "embeddings")).collect()


def test_bounds_spare_distances_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 900, (8, 64))
    v = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 60, (1600, 64))).astype(np.int64)
    mean = v.mean(0)
    rotation = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    p, c = centroids.rotate(v, mean, rotation, 12).astype(np.float32).astype(float), np.floor(centres).astype(np.int64)
    c[5] = c[2]
    cluster, distance, exact = centroids.nearest(v, p, c, centroids.rotate(c, mean, rotation, 12))
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert exact < 2 * len(v)


# --- alignment


def whole(text, both):
    """Ids and byte lengths of a whole text by both, or nothing where the bytes differ."""
    # By the file, not by the ranks that the operator uses.
    a, b = both.first.encode(f" {text}", add_special_tokens=False).ids, both.second.encode(text)
    parts = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
    if not text or any(b"".join(p) != f" {text}".encode() for p in parts):
        return None
    return a, b, *(list(itertools.accumulate(map(len, p))) for p in parts)


def expected(rows, both):
    found, links = [], []
    for _, text in rows:
        groups, own = [], []
        if w := whole(text or "", both):
            a, b, ends_a, ends_b = w
            i = k = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                j, m = ends_a.index(end, i) + 1, ends_b.index(end, k) + 1
                groups.append(",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])))
                own.append((a[j - 1], b[m - 1]))
                i, k = j, m
        found.append((len(w[0]), len(w[1]), groups) if w else (0, 0, []))
        links.append(own)
    counts = collections.Counter(x for own in links for x in own)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return collections.Counter(
        (doc_id, n_a, n_b, len(g), len(own), sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (doc_id, _), (n_a, n_b, g), own in zip(rows, found, links)
    )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chars", [20_000, alignment.CHUNK_CHARS])
def test_op13_against_whole_texts(spark, sf_dir, tmp_path, chars):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, t) for t in ODD_TEXTS] + [(7, None), (3, "same text for all of us"), (3, "same text for all of us")]
    path = table(spark, tmp_path, [(*r, 1, "x") for r in rows], "doc_id long, text string, link long, chunk string")
    docs = spark.read.parquet(f"{path}/documents.parquet").repartition(3)
    got = alignment.align(docs) if chars == alignment.CHUNK_CHARS else None
    if got is None:
        original = alignment.chunked
        try:
            alignment.chunked = lambda d: original(d, chars)
            got = alignment.align(docs)
        finally:
            alignment.chunked = original
    assert collections.Counter(map(tuple, got.select(*ALIGNED).collect())) == expected(rows, alignment.Vocabularies())


def test_op13_without_rows_or_tokens(spark, tmp_path):
    ddl = "doc_id long, text string"
    query = queries.QUERIES["op13_align_tokenizers"]
    assert query(spark, table(spark, tmp_path / "a", [], ddl)).collect() == []
    got = query(spark, table(spark, tmp_path / "b", [(1, None), (2, "▁")], ddl)).select(*ALIGNED).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60), max_size=30), st.sets(st.integers(1, 60), max_size=30))
def test_common_ends(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    got = alignment.common_ends(np.array(a), np.array(b))
    assert list(zip(*(x.tolist() for x in got))) == [(a.index(x) + 1, b.index(x) + 1) for x in sorted(set(a) & set(b))]


def test_stretches_keep_all_characters():
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choice("ab \n ") for _ in range(rng.randrange(1, 30)))
        assert " ".join(alignment.stretches(t)) == t
