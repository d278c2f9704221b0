"""Operator 4, language identification: a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features; label transitions are learned on spliced (code-switched) sequences.
Forward-backward gives each word's label marginals; a document's label is the one with the largest sum of marginals over all its words.

The classifier is fitted on a bounded sample: about PER_LABEL labelled documents per label (about SAMPLE_MOST in all, at least one for each of as many labels), chosen by
a hash of the id among the training rows of at most SAMPLE_CHARS characters; their whole texts are used. Prediction covers every word of every document and reads nothing but the text.

Null texts and texts without a letter are `und` with score 0. Null ids are never trained on and never held out. Null labels are never trained on. Repeated rows are
predicted each. With no training rows every document is `und`. Further columns are ignored or passed through by label_documents().
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memory, arrow_filter, arrow_map, crc_mod, table

UND = "und"
PER_LABEL = 120
SAMPLE_MOST = 4000
SAMPLE_CHARS = 100_000
HOLD = 2
PARTS = 4
SPLICE = (8, 40)
STEP_WORDS = 400_000
LONG = 40
_SIGNS = re.compile(r"[\W\d_]+")


def core_of(word: str) -> str:
    """The word without signs and digits at its ends; empty if it has no letter."""
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def words_in(text: str) -> list[str]:
    """White-space tokens in lower case; a longer one than LONG is parted at signs and digits, and then into pieces of LONG characters."""
    out = []
    for w in text.lower().split():
        if len(w) <= LONG:
            out.append(w)
        else:
            out += [p[i : i + LONG] for p in _SIGNS.split(w) for i in range(0, len(p), LONG)]
    return out


def features(core: str) -> list[str]:
    """Affixes of 1 to 3, inner bigrams and trigrams with borders, and the word itself (lexicon)."""
    c = core
    w = f"^{c}$"
    out = ["=" + core, "b"]
    out += ["<" + c[:n] for n in (1, 2, 3) if n <= len(c)] + [">" + c[-n:] for n in (1, 2, 3) if n <= len(c)]
    out += [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    return out


class Chains:
    """Sequences laid out step by step: position t of the sequences that are longer than t, the longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(steps), "left")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        flat = np.concatenate([sequences[i] for i in self.order]) if len(lengths) else np.zeros(0, np.int64)
        step = np.concatenate([np.arange(n) for n in self.lengths]) if len(lengths) else flat
        lane = np.repeat(np.arange(len(lengths)), self.lengths)
        self.items = np.empty_like(flat)
        self.lane = np.empty_like(lane)
        at = self.start[step] + lane
        self.items[at], self.lane[at] = flat, lane

    def marginals(self, emission: np.ndarray, transition: np.ndarray, edges: bool = False):
        """(marginals per position, log-likelihood normaliser, expected transitions if asked). emission: scores per position."""
        top = emission.max(1, keepdims=True)
        e = np.exp(emission - top)
        move = np.exp(transition)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        scale = np.empty(len(e), e.dtype)
        s, n = self.start, self.active
        for t in range(len(n)):
            a, b = s[t], s[t + 1]
            x = e[a:b] if t == 0 else (alpha[s[t - 1] : s[t - 1] + n[t]] @ move) * e[a:b]
            z = x.sum(1)
            scale[a:b] = z
            alpha[a:b] = x / z[:, None]
        for t in range(len(n) - 1, -1, -1):
            a, b = s[t], s[t + 1]
            k = n[t + 1] if t + 1 < len(n) else 0
            beta[a + k : b] = 1
            if k:
                c = s[t + 1]
                beta[a : a + k] = (e[c : c + k] * beta[c : c + k] / scale[c : c + k, None]) @ move.T
        m = alpha * beta
        m /= m.sum(1, keepdims=True)
        if not edges:
            return m
        expected = np.zeros_like(move)
        for t in range(1, len(n)):
            c, k, p = s[t], n[t], s[t - 1]
            expected += alpha[p : p + k].T @ (e[c : c + k] * beta[c : c + k] / scale[c : c + k, None])
        return m, float(np.log(scale).sum() + top.sum()), expected * move


class _Rows(dict):
    """word -> row of the emission table; 0 for words without a letter."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> int:
        return self.model._learned(word)


class Model:
    """labels, feature -> row of weights, transitions. Emissions of words are remembered per worker, up to a bound."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.index, self.weights, self.transition = labels, index, weights, transition

    def ready(self) -> Model:
        """The model in a worker, with its memory of words."""
        if not hasattr(self, "known"):
            self.prepare()
        Memory.use("language", self.prepare)
        return self

    def prepare(self) -> None:
        self.known = _Rows(self)
        self.rows = np.zeros((1 << 12, len(self.labels)), np.float32)

    def word_ids(self, text: str) -> np.ndarray:
        """Rows of the emission table for the words that have a letter."""
        words = words_in(text)
        out = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        return out[out > 0]

    def _learned(self, word: str) -> int:
        core, n = core_of(word), len(self.known) + 1
        if not core:
            self.known[word] = 0
            return 0
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        got = [i for i in map(self.index.get, features(core)) if i is not None]
        self.rows[n] = self.weights[got].sum(0) if got else 0
        self.known[word] = n
        return n

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UND] * len(texts), [0.0] * len(texts)
        if len(self.known) > 400_000:
            self.prepare()
        ids = [self.word_ids(t) if t else np.zeros(0, np.int32) for t in texts]
        labels, scores = [UND] * len(texts), [0.0] * len(texts)
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: len(ids[i]))
        at = 0
        while at < len(order):
            end, words = at, 0
            while end < len(order) and (end == at or words + len(ids[order[end]]) <= STEP_WORDS):
                words += len(ids[order[end]])
                end += 1
            group = order[at:end]
            at = end
            c = Chains([ids[i] for i in group])
            m = c.marginals(self.rows[c.items], self.transition.astype(np.float32))
            mean = np.stack([np.bincount(c.lane, m[:, k], len(group)) for k in range(m.shape[1])], 1) / c.lengths[:, None]
            best = mean.argmax(1)
            for lane, place in enumerate(c.order):
                labels[group[place]], scores[group[place]] = self.labels[best[lane]], float(min(1.0, mean[lane, best[lane]]))
        return labels, scores


def spliced(docs: list[tuple[list[str], int]], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Code-switched sequences: pieces of SPLICE words of random documents follow one another until every document is used up."""
    r = random.Random(seed)
    left, out = [[w, y, 0] for w, y in docs if w], []
    while left:
        words, labels = [], []
        for _ in range(r.randint(1, 4)):
            if not left:
                break
            i = r.randrange(len(left))
            w, y, at = left[i]
            n = r.randint(*SPLICE)
            words += w[at : at + n]
            labels += [y] * len(w[at : at + n])
            left[i][2] = at + n
            if left[i][2] >= len(w):
                left[i] = left[-1]
                left.pop()
        out.append((words, labels))
    return out


def fit(texts: list[str], langs: list[str], steps: int = 25, least: int = 3, rate: float = 0.25, l2: float = 1e-4) -> Model:
    """Maximum likelihood by Adam over all sequences at once."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)))
    of = {x: i for i, x in enumerate(labels)}
    docs = [([c for w in words_in(t) if (c := core_of(w))], of[x]) for t, x in zip(texts, langs)]
    types: dict[str, int] = {}
    seqs, gold = [], []
    for words, y in spliced(docs):
        seqs.append(np.array([types.setdefault(w, len(types)) for w in words], np.int64))
        gold.append(np.array(y, np.int64))
    counts: dict[str, int] = {}
    for w in types:
        for f in set(features(w)):
            counts[f] = counts.get(f, 0) + 1
    tally = np.bincount(np.concatenate(seqs)) if seqs else np.zeros(0, int)
    index: dict[str, int] = {}
    rows, cols = [], []
    for w, t in types.items():
        for f in features(w):
            if counts[f] >= least or f[0] == "=" and tally[t] >= 20:
                cols.append(index.setdefault(f, len(index)))
                rows.append(t)
    rows, cols, k = np.array(rows, np.int64), np.array(cols, np.int64), len(labels)
    w, move = np.zeros((len(index), k)), np.zeros((k, k))
    if not seqs:
        return Model(labels, index, w, move)
    c, y = Chains(seqs), Chains(gold)
    seen = np.zeros((k, k))
    for g in gold:
        np.add.at(seen, (g[:-1], g[1:]), 1)
    n = len(c.items)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, steps + 1):
        by_type = np.stack([np.bincount(rows, w[cols, j], len(types)) for j in range(k)], 1)
        m, _, expected = c.marginals(by_type[c.items], move, edges=True)
        m[np.arange(n), y.items] -= 1
        g_type = np.stack([np.bincount(c.items, m[:, j], len(types)) for j in range(k)], 1)
        g = np.stack([np.bincount(cols, g_type[rows, j], len(index)) for j in range(k)], 1) / n + l2 * w
        h = (expected - seen) / n + l2 * move
        for x, grad, a, b in ((w, g, 0, 1), (move, h, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * grad
            moments[b] = 0.99 * moments[b] + 0.01 * grad * grad
            x -= rate * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, index, w.astype(np.float32), move)


def train(docs: DataFrame, per_label: int = PER_LABEL, most: int = SAMPLE_MOST, most_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on labelled rows with crc32(id) mod 4 not 2 and texts of at most most_chars characters: of every label the row of smallest hash, and by the hash about
    per_label (less, where there are more than most / per_label labels) others."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = docs.select("doc_id", "text", "lang", h.alias("h")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars) & (crc_mod("doc_id", PARTS) != HOLD))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).orderBy("lang").limit(most).collect()
    if not counts:
        return fit([], [])
    per_label = min(per_label, max(1, most // len(counts)))
    upto = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["least"], int(min(1.0, per_label / r["n"]) * (1 << 40))))])
    got = rows.filter(F.col("h") <= upto[F.col("lang")]).orderBy("h", "doc_id", "text").select("text", "lang").toArrow()
    return fit(got["text"].to_pylist(), got["lang"].to_pylist())


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value.ready()
        for b in batches:
            labels, scores = m.predict(b["text"])
            yield {"doc_id": b["doc_id"], "lang_pred": labels, "score": scores}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), predict, "doc_id long, lang_pred string, score double", piece=16 << 20)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Pipeline stage: documents whose language is known and holds at least `least` of the words' marginals; all columns stay."""
    shared = spark.sparkContext.broadcast(train(docs))

    def keep(texts):
        labels, scores = shared.value.ready().predict(texts)
        return [x != UND and s >= least for x, s in zip(labels, scores)]

    return arrow_filter(docs, keep, "text", piece=16 << 20)


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = label_documents(docs, train(docs))
    held = F.coalesce(crc_mod("doc_id", PARTS) == HOLD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
