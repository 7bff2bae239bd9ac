"""Language identification word by word with a linear-chain conditional random field.

Words (runs of letters and the marks that combine with them, lower-cased) are labelled with languages. The score of a label at a word adds learned weights of
affixes (the first and last one to three characters, marked as such), character n-grams of two to four, and the word itself
where the lexicon of frequent training words has it; learned transition weights tie neighbouring labels. Forward-backward
gives each word's label probabilities, which a document averages over all its words: the language with the largest share
is its prediction, the share its score. In code-switched text the words keep labels of their own (``word_labels``).

A chain is at most ``CHAIN`` consecutive words; longer texts are several chains, each of which begins and ends ``CONTEXT`` words
beyond those that it labels, so that no word is judged without its neighbours. Every word is labelled by one chain.

Training: a bounded sample of the documents with a language. The languages come from all of them; more than ``MOST_LANGUAGES``
raise, since weights and sample grow with them, so none is left out unsaid. Each gives an equal part of ``SAMPLE_ROWS`` different
documents (``LEAST_ROWS`` at least, if it has them), those with the smallest hash of id and text, and of each one window of
``SAMPLE_CHARS`` characters, which the hash picks from all windows of its whole text. They fit on the driver (a few MB),
every word of theirs labelled with its document's language. Further chains are spliced from documents of two languages, so
that transitions between languages are learned too. Weights start at the log-odds of features and are then trained by gradient
steps on the chains' likelihood. The weights are broadcast: their size is fixed by ``BUCKETS``, whatever the corpus.

Defined cases: a text that is null or has no letter is 'und' with score 0; languages are those of the sample; a sample
without any language predicts 'und' everywhere; marks without a letter are no word; an empty table gives no rows; repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, documents, id_and_text, ship, slices

SAMPLE_ROWS = 600
LEAST_ROWS = 40
SAMPLE_CHARS = 8192
MOST_LANGUAGES = 100
BUCKETS = 1 << 16
LEXICON = 2000
CHAIN = 64
CONTEXT = 8
EPOCHS = 3
BATCH = 64
RATE = 0.5
UNKNOWN = "und"
REMEMBER = 200_000
_ASCII = re.compile("[a-z]+")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_ORDERS = (2, 3, 4)


def split_words(text: str) -> list[str]:
    """Runs of letters and combining marks with a letter among them."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    words = _WORD.findall(text.lower())
    return words if "".join(words).isalpha() else [w for w in words if any(map(str.isalpha, w))]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, word number of each) for a list of words: n-grams over the word with its borders marked, the
    ones at a border being affixes, and the whole word (the lexicon's feature, which only has weight for frequent words).
    """
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    numbers, owners = [], []
    h = codes.copy()
    for n in range(2, max(_ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        numbers.append(_mix(h[inside] + np.uint64(n << 40)))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(numbers).astype(np.int64), np.concatenate(owners)


class Model:
    """Weights of features, lexicon words and transitions for the languages."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS, k))
        self.lexicon: dict[str, np.ndarray] = {}
        self.transitions = np.zeros((k, k))

    def emissions(self, words: list[str]) -> np.ndarray:
        numbers, owners = features(words)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owners, self.weights[numbers, k], len(words))
        for i, w in enumerate(words):
            if w in self.lexicon:
                out[i] += self.lexicon[w]
        return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Marginals [chains, CHAIN, K] and expected transitions [K, K] of padded chains of the given lengths."""
    n, t, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    m = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ m) * e[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (beta[:, i + 1] * e[:, i + 1]) @ m.T
        b /= b.sum(1, keepdims=True)
        beta[:, i] = np.where((i + 1 < lengths)[:, None], b, 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    live = np.arange(1, t)[None, :] < lengths[:, None]
    left, right = alpha[:, :-1], beta[:, 1:] * e[:, 1:]
    scale = np.einsum("ntj,jk,ntk->nt", left, m, right)
    pairs = np.einsum("ntj,ntk,nt->jk", left, right, np.where(live, 1 / scale, 0.0)) * m
    return post, pairs


def chains(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each chain of a word stream starts, and its length, for documents of the given numbers of words."""
    starts, sizes, at = [], [], 0
    for n in counts:
        for a in range(0, n, CHAIN):
            starts.append(at + a)
            sizes.append(min(CHAIN, n - a))
        at += n
    return np.array(starts, np.int64), np.array(sizes, np.int64)


def overlapping(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of chains that overlap, and from which word to which each of them labels."""
    step, rows, at = CHAIN - 2 * CONTEXT, [], 0
    for n in counts:
        begins = range(0, max(1, n - 2 * CONTEXT), step) if n else ()
        for a in begins:
            size = min(CHAIN, n - a)
            rows.append((at + a, size, CONTEXT if a else 0, size if a == begins[-1] else CHAIN - CONTEXT))
        at += n
    return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def spliced(docs: list[tuple[list[str], list[int]]], many: int) -> list[tuple[list[str], list[int]]]:
    """``many`` chains of runs of 3 to 20 words, in turn from two documents of different languages."""
    rng, out = np.random.default_rng(11), []
    by: dict[int, list] = {}
    for words, labels in docs:
        by.setdefault(labels[0], []).append(words)
    while len(by) > 1 and len(out) < many:
        pair = rng.choice(sorted(by), 2, replace=False).tolist()
        texts = [by[y][rng.integers(len(by[y]))] for y in pair]
        words, labels, turn = [], [], 0
        while len(words) < CHAIN:
            n, own = int(rng.integers(3, 21)), texts[turn % 2]
            at = int(rng.integers(max(1, len(own) - n + 1)))
            words += own[at : at + n]
            labels += [pair[turn % 2]] * len(own[at : at + n])
            turn += 1
        out.append((words[:CHAIN], labels[:CHAIN]))
    return out


def fit(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """rows: (text, language). Deterministic."""
    model = Model(sorted({lang for _, lang in rows}))
    k = len(model.languages)
    docs = [(words, [model.languages.index(lang)] * len(words)) for text, lang in rows if (words := split_words(text))]
    docs += spliced(docs, len(docs))
    if not docs or k < 1:
        return model
    stream = [w for words, _ in docs for w in words]
    unique = {w: i for i, w in enumerate(dict.fromkeys(stream))}
    vocabulary = list(unique)
    numbers, owners = features(vocabulary)
    order = np.argsort(owners, kind="stable")
    numbers, first = numbers[order], np.searchsorted(owners[order], np.arange(len(vocabulary) + 1))
    ids = np.array([unique[w] for w in stream])
    labels = np.array([y for _, own in docs for y in own])
    # Log-odds of each feature as the start; then the chains' own gradient.
    seen = np.zeros((BUCKETS, k))
    for y in range(k):
        word_counts = np.bincount(ids[labels == y], minlength=len(vocabulary))
        seen[:, y] = np.bincount(numbers, np.repeat(word_counts, np.diff(first)), BUCKETS)
    rate = (seen + 0.5) / (seen.sum(0) + 0.5 * BUCKETS)
    model.weights = np.where(seen.sum(1, keepdims=True) > 0, np.log(rate) - np.log(rate).mean(1, keepdims=True), 0.0) / 4
    model.transitions = np.eye(k)
    frequent = [w for w, _ in Counter(stream).most_common(LEXICON)]
    model.lexicon = {w: np.zeros(k) for w in frequent}
    lex_id = np.full(len(vocabulary), -1)
    lex_id[[unique[w] for w in frequent]] = np.arange(len(frequent))
    lex = np.zeros((len(frequent), k))
    starts, sizes = chains([len(w) for w, _ in docs])
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // BATCH)):
            s, n = starts[part], sizes[part]
            live = np.arange(CHAIN)[None, :] < n[:, None]
            at = np.where(live, s[:, None] + np.arange(CHAIN), s[:, None])
            words, inverse = np.unique(ids[at], return_inverse=True)
            inverse = inverse.reshape(at.shape)
            feats = np.concatenate([numbers[first[w] : first[w + 1]] for w in words])
            own = np.repeat(np.arange(len(words)), first[words + 1] - first[words])
            score = np.stack([np.bincount(own, model.weights[feats, y], len(words)) for y in range(k)], 1)
            in_lex = lex_id[words]
            score += np.where((in_lex >= 0)[:, None], lex[in_lex], 0.0)
            post, pairs = forward_backward(score[inverse], n, model.transitions)
            wrong = (np.eye(k)[labels[at]] - post) * live[:, :, None]
            grad = np.stack([np.bincount(inverse.ravel(), wrong[:, :, y].ravel(), len(words)) for y in range(k)], 1)
            step = RATE / (1 + epoch) / max(1, live.sum())
            for y in range(k):
                np.add.at(model.weights[:, y], feats, step * grad[own, y])
            np.add.at(lex, in_lex[in_lex >= 0], step * grad[in_lex >= 0])
            gold = np.zeros((k, k))
            pair_live = live[:, 1:]
            np.add.at(gold, (labels[at][:, :-1][pair_live], labels[at][:, 1:][pair_live]), 1)
            model.transitions += RATE * (gold - pairs) / max(1, pair_live.sum())
    model.lexicon = {w: lex[i] for i, w in enumerate(frequent)}
    return model


class Labeller:
    """A model at work in a Python worker; remembers the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.ids, self.scores = model, {}, np.zeros((0, len(model.languages)))

    def word_ids(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > REMEMBER:
            ids.clear()
            self.scores = self.scores[:0]
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            for w in new:
                ids[w] = len(ids)
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """[words, K] for each text."""
        docs = [split_words(t) for t in texts]
        ids = self.word_ids([w for d in docs for w in d])
        counts = [len(d) for d in docs]
        starts, sizes, since, until = overlapping(counts)
        out, places = np.zeros((len(ids), len(self.model.languages))), np.arange(CHAIN)[None, :]
        for a in range(0, len(starts), 1024):
            s, n, first, end = (x[a : a + 1024, None] for x in (starts, sizes, since, until))
            at = np.where(places < n, s + places, s)
            post, _ = forward_backward(self.scores[ids[at]], n[:, 0], self.model.transitions)
            labels = (places >= first) & (places < end)
            out[at[labels]] = post[labels]
        return np.split(out, np.cumsum(counts)[:-1])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = []
        for post in self.marginals(texts):
            share = post.mean(0) if len(post) else None
            found.append((UNKNOWN, 0.0) if share is None else (self.model.languages[int(share.argmax())], min(1.0, float(share.max()))))
        return found

    def certainty(self, texts: list[str]) -> list[float]:
        """The mean probability of the words' best labels, in one language or several; 0 for a text without words."""
        if not self.model.languages:
            return [0.0] * len(texts)
        return [float(post.max(1).mean()) if len(post) else 0.0 for post in self.marginals(texts)]

    def word_labels(self, text: str) -> list[tuple[str, str]]:
        post = self.marginals([text])[0]
        return [(w, self.model.languages[int(y)]) for w, y in zip(split_words(text), post.argmax(1))] if len(post) else []


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """The bounded sample: (window of the text, language) of different documents of each language, those with the smallest hash of id and text.

    The number of different hashes of a language gives the share of the hash range where about a third more than its part
    lie; only those leave their tasks, and copies of one document are one, so what reaches the driver is bounded.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(11)), F.lit(1 << 40))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", place.alias("place"))
    windows = F.greatest(F.ceil(F.length("text") / chars), F.lit(1))
    known = known.select("lang", F.col("text").substr((F.pmod(F.col("place"), windows) * chars + 1).cast("int"), F.lit(chars)).alias("text"), "place")
    found = known.groupBy("lang").agg(F.approx_count_distinct("place").alias("different"))
    languages = found.orderBy("lang").limit(most_languages + 1).collect()
    if not languages:
        return []
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages: pass a larger most_languages, or map rare ones together")
    each = max(LEAST_ROWS, rows // len(languages))
    most = {r["lang"]: int(min(1.0, (each * 4 / 3 + 20) / max(1, r["different"])) * (1 << 40)) for r in languages}
    limit = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))[F.col("lang")]
    near = known.where(F.col("place") <= limit).groupBy("lang", "place").agg(F.min("text").alias("text"))
    by: dict[str, list] = {}
    for r in near.collect():
        by.setdefault(r["lang"], []).append((r["place"], r["text"]))
    return [(text, lang) for lang in sorted(by) for _, text in sorted(by[lang])[:each]]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, **bounds) -> Model:
    return fit(training_sample(docs, rows, **bounds))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, lang_pred string, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        labeller = Labeller(shared.value)
        for b in slices(batches, 128):
            found = labeller.predict([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found]), pa.array([s for _, s in found])], schema=schema)

    return id_and_text(docs).mapInArrow(run, ddl)


def filtered(docs: DataFrame, model: Model, judge) -> DataFrame:
    """All columns of the rows of ``docs`` for whose texts (null: empty) ``judge(labeller, texts)`` says true."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        labeller = Labeller(shared.value)
        for b in slices(batches, 128):
            yield b.filter(pa.array(judge(labeller, [t or "" for t in b.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op10_language_crf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
