"""Operators that look across documents, against brute force on whole small tables and on invented ones."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import fingerprints, language, mixing, near_dedup, packing, queries, substrings

ODD = [(1, None, "a", None), (2, "", "a", "en"), (2, "", None, "en"), (None, "one two three four five six seven eight", None, "fr"), (3, "word " * 60_000, "b", None), (4, "same text here for all of us today", "b", "de"), (4, "same text here for all of us today", "b", "de"), (5, "\t \n", "c", "xx")]
ODD_DDL = "doc_id long, text string, source string, lang string, n_words long, class_id string, _size string"


def odd(spark, tmp_path, rows=ODD):
    spark.createDataFrame([(*r, 7, "x", "y") for r in rows], ODD_DDL).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q[:4] in ("op1_", "op5_", "op6_", "op7_", "op9_", "op10")])
def test_odd_and_empty_tables(spark, tmp_path, name):
    got = queries.QUERIES[name](spark, odd(spark, tmp_path)).collect()
    if name != "op6_pack_ffd":
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in ODD)
    else:
        assert {r.doc_id for r in got} == {r[0] for r in ODD}
    assert queries.QUERIES[name](spark, odd(spark, tmp_path / "none", [])).count() == 0


# --- packing


def test_tokens_equal_the_tokenizers(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{packing.VOCABULARY}.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for x in [*texts, "", "a  b\n\n c", "it's 12 ½ ²x", "<|endoftext|> a", "x́ 1́\x85 \x1c", "日本 語\n x"]:
        assert np.frombuffer(packing.token_bytes(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing_against_a_scan(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    used: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, u in enumerate(used) if u + sizes[i] <= 50), len(used))
        if b == len(used):
            used.append(0)
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += sizes[i]


def check_packing(rows, texts):
    """texts: the token bytes of each document id, one entry for each copy."""
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 1024
    want = collections.Counter()
    for doc_id, many in texts.items():
        for ids in many:
            for a in range(0, len(ids), 4096):
                part = ids[a : a + 4096]
                want[doc_id, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    return sum(r.length for r in rows) / 1024 / len(by_sequence)


def tokens(text):
    return packing.token_bytes(text or "") + np.array([packing.END_ID], "<u4").tobytes()


def test_packing_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: [tokens(r.text)] for r in docs.collect()}
    assert check_packing(packing.op6_pack_ffd(spark, sf_dir).collect(), texts) > 0.97
    many = packing.pack_documents(docs, group_rows=30).collect()  # several groups
    assert check_packing(many, texts) > 0.8


def test_packing_repeated_rows(spark, tmp_path):
    rows = packing.op6_pack_ffd(spark, odd(spark, tmp_path)).collect()
    texts = collections.defaultdict(list)
    for doc_id, text, *_ in ODD:
        texts[doc_id].append(tokens(text))
    check_packing(rows, texts)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "\u2003"])
def test_long_runs_of_white_space(spark, tmp_path, blank):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{packing.VOCABULARY}.json"))
    texts = [blank * 1_500_000, f"a{blank * 1_500_000}b", blank * 9_999 + "x"]
    for x in texts:
        assert np.frombuffer(packing.token_bytes(x), "<u4").tolist() == whole.encode(x, add_special_tokens=False).ids
    if blank == " ":
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        rows = packing.op6_pack_ffd(spark, str(tmp_path)).collect()
        check_packing(rows, {i: [tokens(x)] for i, x in enumerate(texts)})


# --- mixing


def water_fill(sizes, weights, cap):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


def test_mixing_targets_and_copies(spark):
    r = random.Random(4)
    many = {"a": 40, "b": 400, "c": 4, "d": 0, None: 300, "é": 250}
    rows = [(i, "w " * r.randrange(1, 200), s) for i, s in enumerate(s for s, n in many.items() for _ in range(n))]
    rows.append((len(rows), None, "d"))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    names = sorted((s for s in many if s is not None), key=lambda s: s) + [None]
    size = collections.Counter()
    taken = collections.Counter()
    for x in got:
        assert x._size == len((x.text or "").split()) and 0 <= x._copies <= 3
        size[x.source] += x._size
        taken[x.source] += x._size * x._copies
    want = water_fill([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 3)
    for s, w in zip(names, want):
        target = {x._target for x in got if x.source == s}
        assert len(target) == 1 and abs(target.pop() - w) < 1e-6 * max(1, w)
        assert abs(taken[s] - w) <= max(200, 0.05 * w)


def test_mixing_is_repeatable_and_emits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = sorted((r.doc_id, r._copies) for r in mixing.mix(docs).collect())
    b = sorted((r.doc_id, r._copies) for r in mixing.mix(docs.repartition(7)).collect())
    assert a == b
    emitted = mixing.emit_copies(mixing.mix(docs), docs.columns)
    assert emitted.columns == docs.columns and emitted.count() == sum(n for _, n in a)


# --- repeated passages


def plain_removal(rows, window=20):
    """rows: (doc_id, text) in order of doc_id."""
    first, words = {}, []
    for k, (_, t) in enumerate(rows):
        w = (t or "").encode().split()
        words.append(w)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (k, i))
    out = []
    for k, ((doc_id, _), w) in enumerate(zip(rows, words)):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cover_brings_every_pair_together():
    p, d = substrings.PERIOD, substrings.COVER
    assert all(any((i + s) % p in d and (j + s) % p in d for s in range(p)) for i in range(p) for j in range(p))


def removal(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_removal_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_HASHES", 50)  # many buckets
    r = random.Random(seed)
    passages = [[f"p{i}_{j}" for j in range(r.choice((19, 20, 21, 33, 60)))] for i in range(5)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randrange(1, 6)):
            w += [f"u{r.randrange(10**9)}" for _ in range(r.randrange(0, 30))] if r.random() < 0.6 else r.choice(passages)
        rows.append((i * 3, " \n".join(w)))
    rows += [(500, "a b " * 40), (501, "a b " * 30), (502, rows[0][1]), (503, None)]
    assert removal(spark, rows) == plain_removal(rows)


def test_work_of_a_chunk_does_not_follow_the_number_of_buckets():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.int64).astype(np.uint64)
    for buckets in (1, 7, 100, 10**6, 10**9):
        dealt = substrings._dealt(h, buckets)
        assert len(dealt) <= len(h) and sorted(np.concatenate(list(dealt.values())).tolist()) == list(range(len(h)))
        assert all(((h[at] >> np.uint64(20)) % np.uint64(buckets) == k).all() for k, at in dealt.items())


def test_removal_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in substrings.op9_repeats_difference_cover(spark, sf_dir).collect()) == plain_removal(rows)


# --- sketches


def test_sketch_is_mergeable_and_estimates_containment():
    r = random.Random(1)
    big = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    small = big[3000:5000]
    a, b = fingerprints.sketch(" ".join(small)), fingerprints.sketch(" ".join(big))
    assert fingerprints.containment(a, b) == 1 and abs(fingerprints.containment(b, a) - 0.1) < 0.03
    parts = [fingerprints.sketch(" ".join(big[i : i + 5004])) for i in range(0, 20_000, 5000)]
    assert np.array_equal(fingerprints.merge(*parts), b)
    assert len(fingerprints.sketch("")) == 0 and fingerprints.likeness(a, a, True) == 1 and fingerprints.likeness(a[:0], a[:0], False) == 0


@pytest.mark.parametrize("range_rows", [1024, 17])
def test_neighbours_against_brute_force(spark, sf_dir, range_rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy(F.desc("doc_id")).collect()]
    got = {r.doc_id: r for r in fingerprints.neighbour_likeness(docs, range_rows).collect()}
    assert len(got) == len(rows)
    for (i, x), (_, y) in zip(rows, rows[1:] + rows[:1]):
        n = len(x) // 3
        edited = x[: len(x) - n] + y[:n]
        a, b, c = map(fingerprints.sketch, (x, edited, y))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(x), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encoded(a), fingerprints.encoded(b))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b, x == edited), fingerprints.likeness(a, c, x == y))


# --- language


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3))
    post, pairs = language.forward_backward(emit, np.array([4]), trans)
    import itertools

    weight = {p: np.exp(sum(emit[0, i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=4)}
    total = sum(weight.values())
    for i in range(4):
        for y in range(3):
            assert abs(post[0, i, y] - sum(w for p, w in weight.items() if p[i] == y) / total) < 1e-9
    want = np.zeros((3, 3))
    for p, w in weight.items():
        for a, b in zip(p, p[1:]):
            want[a, b] += w / total
    assert np.allclose(pairs, want)


def test_held_out_accuracy_and_code_switching(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language.op10_language_crf(spark, sf).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.97
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = dict(language.Labeller(model).word_labels("the with ereding queque eauouai der keitschung und"))
    assert labels["ereding"] == "en" and labels["eauouai"] == "fr" and labels["keitschung"] == "de"


def test_numbers_are_no_letters():
    assert language.split_words("½ ² Ⅷ ٣ _") == [] and language.split_words("Él² am½ 3x ß") == ["él", "am", "x", "ß"]
    model = language.fit([("the cat and the dog", "en"), ("el gato y el perro", "es")])
    assert language.Labeller(model).predict(["½ ² Ⅷ"]) == [("und", 0.0)]


@pytest.mark.parametrize("ids", ["null", "one", "copies"])
def test_training_sample_with_repeated_ids(spark, ids):
    rows = [(None if ids == "null" else 7, "the same" if ids == "copies" else f"word{i} {'the of and' if i % 2 else 'el de los'}", "en" if i % 2 else "es") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter(lang for _, lang in language.training_sample(docs))
    assert got == ({"en": 1, "es": 1} if ids == "copies" else {"en": 300, "es": 300})


def test_rare_languages_are_learned_and_long_texts_cut(spark):
    rows = [(i, "common words " * 10, "en") for i in range(5000)] + [(9000 + i, "raro " * 30_000, "es") for i in range(3)]
    sample = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(lang == "es" for _, lang in sample) == 3 and max(len(t) for t, _ in sample) <= language.SAMPLE_CHARS


def test_training_windows_come_from_the_whole_text(spark):
    rows = [(i, "anfang " * 2000 + "ende " * 4000, "de") for i in range(60)]
    sample = [text for text, _ in language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))]
    assert any("anfang" in t for t in sample) and any("ende" in t for t in sample) and max(map(len, sample)) <= language.SAMPLE_CHARS


def test_too_many_languages_raise(spark):
    docs = spark.createDataFrame([(i, f"word{i}", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(language.training_sample(docs, most_languages=5)) == 5
    with pytest.raises(ValueError, match="most_languages"):
        language.training_sample(docs, most_languages=4)


def test_words_keep_combining_marks():
    assert language.split_words("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"] and language.split_words("สวัสดีครับ") == ["สวัสดีครับ"]
    assert language.split_words("cafe\u0301 \u0301\u0302 x1\u0301") == ["cafe\u0301", "x"]


@pytest.mark.parametrize("n", [0, 1, 48, 63, 64, 65, 112, 113, 500])
def test_each_word_is_labelled_by_one_chain_with_context(n):
    seen = np.zeros(n + 3, int)
    for start, size, since, until in zip(*language.overlapping([0, n, 3, 0])):
        assert size <= language.CHAIN and 0 <= since < until <= size
        seen[start + since : start + until] += 1
        if start < n:
            assert (since == 0) == (start == 0) and (until == size) == (start + size == n)
            assert since in (0, language.CONTEXT) and size - until in (0, language.CONTEXT)
    assert (seen == 1).all()


def test_words_of_spliced_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    k = len(model.languages)
    assert (model.transitions - np.diag(np.diag(model.transitions)) != 0).sum() == k * (k - 1)
    rest = [(r.text, r.lang) for r in docs.where(language.held_out(F.col("doc_id"))).limit(120).collect()]
    whole = [(w, [model.languages.index(lang)] * len(w)) for text, lang in rest if (w := language.split_words(text))]
    labeller, right, n = language.Labeller(model), 0, 0
    for words, labels in language.spliced(whole, 200):
        got = labeller.word_labels(" ".join(words))
        right += sum(model.languages[y] == own for (_, own), y in zip(got, labels))
        n += len(labels)
    assert right / n > 0.9
    assert min(labeller.certainty([" ".join(words) for words, _ in language.spliced(whole, 50)])) > 0.5


def test_language_without_letters_or_training(spark):
    df = spark.createDataFrame([(1, None, None), (2, "123 !?", None), (3, "some words", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(df, language.train(df)).collect()} == {"und"}
    known = spark.createDataFrame([(1, "alpha beta", "x"), (2, "gamma delta", "y")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.train(known)).collect()}
    assert got[1] == got[2] == "und" and got[3] in ("x", "y")


# --- near-duplicates


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=30), st.lists(st.sampled_from("abcde"), min_size=1, max_size=30), st.integers(0, 29))
def test_banded_distance(x, y, most):
    most %= len(x)
    assert near_dedup.banded_distance(x, y, most) == min(edit_distance(x, y), most + 1)
    assert near_dedup.alike(" ".join(x), " ".join(y)) == (edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9))


def test_order_and_occurrence_matter():
    words = [f"w{i}".encode() for i in range(60)]
    turned = words[30:] + words[:30]
    same = np.mean(near_dedup.order_minhash(words) == near_dedup.order_minhash(words[:59] + [b"x"]))
    assert np.mean(near_dedup.order_minhash(words) == near_dedup.order_minhash(turned)) < same
    repeated = near_dedup.order_minhash([b"a"] * 30)
    assert len(repeated) == near_dedup.SKETCHES and len(near_dedup.order_minhash([])) == 0


def plain_classes(rows):
    """Components over all pairs, by the alignment alone."""
    first = {}
    for i, t in rows:
        if t is not None:
            first[t] = min(i, first.get(t, i))
    texts = list(first)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if texts[a].split() and texts[b].split() and near_dedup.alike(texts[a], texts[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, t in enumerate(texts):
        least[find(k)] = min(first[t], least.get(find(k), first[t]))
    return {i: i if t is None else least[find(texts.index(t))] for i, t in rows}


def test_classes_against_all_pairs(spark):
    r = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30, 200))]
        for _ in range(r.randrange(1, 6)):
            w = base[:]
            for _ in range(r.randrange(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((r.randrange(10**6), " ".join(w)))
    rows += [(10**6 + 1, rows[0][1]), (10**6 + 2, rows[0][1]), (10**6 + 3, None), (10**6 + 4, None), (10**6 + 5, ""), (10**6 + 6, "")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == plain_classes(rows)
    assert collections.Counter(x.class_id for x in got if x.keeper) == collections.Counter(set(plain_classes(rows).values()))


def test_isolated_pairs_with_many_edits(spark):
    r = random.Random(12)
    rows = []
    for k in range(160):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(150, 300))]
        w = base[:]
        for i in r.sample(range(len(w)), int(len(w) * (0.05, 0.1, 0.15, 0.2)[k % 4])):
            w[i] = f"x{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(w))]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in got} == {i: i // 2 * 2 for i, _ in rows}


def test_alike_texts_in_a_large_group(spark):
    """400 texts share a passage of about 40 % of their words, so most of their groups are large; 50 pairs of them are alike."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(350):
        base = [f"w{r.randrange(10**6)}" for _ in range(90)]
        at = r.randrange(91)
        rows.append((len(rows), " ".join(base[:at] + passage + base[at:])))
        if k < 50:
            w = base[:at] + passage + base[at:]
            for i in r.sample(range(150), 20):
                w[i] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i: c for i, c in got.items() if i != c}
    assert found.items() <= {i: i - 1 for i in range(1, 100, 2)}.items() and len(found) >= 48


@pytest.mark.parametrize("words", [60, 200])
def test_pairs_that_share_a_sketch(words):
    """Isolated pairs, which no third text helps: the share that meets, by the share of words edited."""
    r = random.Random(words)
    for edited in (0.05, 0.1, 0.15, 0.19):
        met = 0
        for _ in range(200):
            base = [b"%d" % r.randrange(10**6) for _ in range(words)]
            w = base[:]
            for i in r.sample(range(words), int(words * edited)):
                w[i] = b"%d" % r.randrange(10**6)
            met += bool((near_dedup.order_minhash(base) == near_dedup.order_minhash(w)).any())
        assert met >= 190, (edited, met)


def test_repeated_rows_leave_one(spark):
    rows = [(1, "t u v"), (1, "t u v"), (None, "x"), (None, "x"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_classes(docs).collect()
    assert collections.Counter((x.doc_id, x.class_id, x.keeper) for x in got) == {(1, 1, True): 1, (1, 1, False): 1, (None, None, True): 1, (None, None, False): 1, (2, 2, True): 2}
    assert sorted(near_dedup.deduplicated(docs).collect(), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def test_many_distinct_words_need_little_memory():
    import tracemalloc

    x = [f"w{i}" for i in range(20_000)]
    y = [w if i % 9 else f"z{i}" for i, w in enumerate(x)]
    tracemalloc.start()
    assert near_dedup.banded_distance(x, y, 4000) == len(range(0, 20_000, 9))
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()
    assert near_dedup.banded_distance(["a"] * 3000, ["a"] * 2000 + ["b"] * 900, 1000) == 1000


def test_whole_table_classes(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in near_dedup.op1_near_dedup_omh(spark, sf_dir).collect()} == plain_classes(rows)


# --- the pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, *_, last = corpus_pipeline.STAGES
    at = docs.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, sf_dir)
        assert at.columns == before.columns, name
        at = spark.createDataFrame(at.toPandas(), before.schema) if at.count() else at
        if name == "near-duplicates":
            classes = plain_classes([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in at.collect()) == sorted(set(classes.values()))
    pieces = last[1](spark, at, sf_dir).collect()
    texts = collections.defaultdict(list)
    for r in at.collect():
        texts[r.doc_id].append(tokens(r.text))
    check_packing(pieces, texts)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _copies long"
    rows = [(1, None, None, None, None, 1), (2, "the words of this text and more", "en", "a", 31, None), (2, "the words of this text and more", "en", "a", 31, None), (3, "les mots de ce texte token=abcdefgh", "fr", None, 35, 1), (None, "the other words", "en", "a", 15, 1)]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 1 not in {r.doc_id for r in pieces}
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
