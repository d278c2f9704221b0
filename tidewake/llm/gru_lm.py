"""Operator 6, language-model scoring with a gated recurrent network.

Words are lower-cased (A-Z) and counted over all training documents (partial counts before the shuffle). The most frequent words form the network's
vocabulary, dealt into classes by frequency; a word outside it is the tail class, whose words share that class's probability by their smoothed corpus
counts, one share standing for all unseen words. The output is a class-factored softmax: P(class | state) * P(word | class, state). The state is carried across windows through the whole
document, so a score is the log-likelihood of the complete text; in training, gradients are truncated at window borders.

All counts cover all documents. After them one pass over the texts writes every row's token numbers, known sums and rare words under a number of its own; training,
scoring and the join of rare words read that table. The network's weights are fitted on all training documents: groups of about GROUP_WORDS words, dealt by hash, train side by side from one
starting point (a pass over START_DOCS documents), and their weights are averaged by words; the number of groups grows with the input.
Counts of the KNOWN most frequent words are broadcast (a fixed bound); all other words meet their counts in a join on the word.

Null and empty texts are the end token alone. Null ids are neither trained on nor held out. Repeated rows are scored each. With no training rows N and V are 0 and the score is that of an
untrained network. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_table import Table, beyond_keys, keys, mix, one_of_each, padded
from .common import Memory, Scratch, Words, arrow_map, binary, crc_mod, table

PARTS, HOLD = 5, 1
VOCABULARY = 2048
CLASSES = 32
HIDDEN = 16
KNOWN = 131_072
START_DOCS, START_WORDS = 1500, 300_000
LANES, WINDOW = 48, 20
GROUP_WORDS, CHUNK_WORDS, GROUP_LANES, GROUP_RATE = 2_000_000, 500_000, 384, 0.007
SLICES = 64
END = b"\n"  # no word holds white space


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, trained, seen): counts in training documents and in all, the end token included."""
    rows = docs.select(F.coalesce(crc_mod("doc_id", PARTS) != HOLD, F.lit(False)).alias("train"), "text")

    def count(batches):
        from collections import Counter

        def fresh():
            nonlocal table, sums, long
            table, sums, long = Table(), np.zeros((2, 0), np.int64), (Counter(), Counter())  # long: words that have no keys

        def flush():
            slot = np.flatnonzero(table.value)
            got = sums[:, table.value[slot] - 1]
            for i in range(0, len(slot), 200_000):
                some = slot[i : i + 200_000]
                raw = np.stack([table.low[some], table.high[some]], 1).astype("<u8").view(np.uint8)
                yield {"word": binary(raw[raw != 0], (raw != 0).sum(1)), "trained": got[0, i : i + 200_000], "seen": got.sum(0)[i : i + 200_000]}
            if words := list(long[0].keys() | long[1].keys()):
                yield {"word": words, "trained": [long[0][w] for w in words], "seen": [long[0][w] + long[1][w] for w in words]}
            fresh()

        table = sums = long = None
        fresh()
        for b in batches:
            w, train = Words(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            number = table.find(w.low, w.high)
            number[w.odd] = -1
            miss = np.flatnonzero(number == 0)
            while len(miss):
                new = miss[one_of_each(w.low[miss], w.high[miss])]
                table.put(w.low[new], w.high[new], np.arange(table.kept + 1, table.kept + 1 + len(new)))
                number[miss] = table.find(w.low[miss], w.high[miss])
                miss = miss[number[miss] == 0]
            sums = np.pad(sums, ((0, 0), (0, table.kept - sums.shape[1])))
            kind = np.repeat(~train, w.count)  # row 0: training documents
            for k in (0, 1):
                sums[k] += np.bincount(number[~w.odd & (kind == k)] - 1, minlength=table.kept)
            for i in np.flatnonzero(w.odd).tolist():
                long[int(kind[i])][w.word(i)] += 1
            if table.kept + len(long[0]) + len(long[1]) > 500_000:
                yield from flush()
        yield from flush()

    return arrow_map(rows, count, "word binary, trained long, seen long", piece=1 << 20, lists=False).groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place. Where exp overflows, the result is 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Input rows per token (embedding times input weights, learned as one table), a GRU, class and word outputs.

    Tokens: 0 to words-1 vocabulary words, words = tail. Class 0 is the tail, the others hold equal numbers of words by frequency rank.
    """

    def __init__(self, words: int, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 11):
        r = np.random.default_rng(seed)
        self.words, self.hidden = words, hidden
        self.per = max(1, -(-words // classes))
        self.classes = 1 + max(1, -(-words // self.per))
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "x": n(words + 1, 3 * hidden, scale=0.1), "u": n(hidden, 3 * hidden, scale=0.2), "c": n(hidden, self.classes, scale=0.1),
            "cb": np.zeros(self.classes, np.float32), "o": n(self.classes, self.per, hidden, scale=0.1), "ob": np.zeros((self.classes, self.per), np.float32),
        }
        short = self.words - (self.classes - 2) * self.per
        if short < self.per:
            self.w["ob"][self.classes - 1, max(0, short) :] = -1e9

    def start_from(self, counts: np.ndarray, tail: int) -> None:
        """Output biases from the corpus counts."""
        c = np.concatenate([counts, np.zeros((self.classes - 1) * self.per - len(counts))]).reshape(self.classes - 1, self.per)
        self.w["cb"][:] = np.log(np.concatenate([[tail + 1], c.sum(1) + 1]))
        self.w["cb"] -= self.w["cb"].max()
        live = self.w["ob"][1:] > -1e8
        self.w["ob"][1:][live] = np.log(c[live] + 0.5)
        self.w["ob"][1:] -= np.where(live, self.w["ob"][1:], -np.inf).max(1, keepdims=True)
        self.w["ob"][1:][~live] = -1e9

    def step(self, tokens: np.ndarray, h: np.ndarray):
        k = self.hidden
        gx, gh = self.w["x"].take(tokens, 0), h @ self.w["u"]
        zr = _sigmoid(gx[:, : 2 * k] + gh[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = r * gh[:, 2 * k :]
        c += gx[:, 2 * k :]
        np.tanh(c, out=c)
        h = h - c
        h *= z
        h += c
        return h, (zr, c, gh)

    def class_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tail = tokens == self.words
        return np.where(tail, 0, 1 + tokens // self.per), np.where(tail, 0, tokens % self.per)

    def outputs(self, h: np.ndarray, tokens: np.ndarray, grads: bool = False):
        """Natural log probability of each token at its state; with grads, also d(-sum)/dh and the output gradients."""
        cls, place = self.class_of(tokens)
        a = h @ self.w["c"]
        a += self.w["cb"]
        wide = max(np.abs(self.w["c"]).sum(0).max(), np.abs(self.w["o"]).sum(2).max(), self.w["cb"].max(), self.w["ob"].max()) > 40  # states are within 1
        e = np.exp(np.minimum(a, 80, out=a) if wide else a)
        s = e @ np.ones(self.classes, np.float32)
        at = np.arange(len(h))
        lp = a[at, cls] - np.log(s)
        if grads:
            e /= s[:, None]
            e[at, cls] -= 1
            d = {"c": h.T @ e, "cb": np.ones(len(h), np.float32) @ e, "o": np.zeros_like(self.w["o"]), "ob": np.zeros_like(self.w["ob"])}
            dh = e @ self.w["c"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")  # 16-bit keys sort by radix
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        hs, places = h.take(order, 0), place.take(order)
        every = np.ones(self.per, np.float32)
        more, back = np.zeros(len(h), lp.dtype), np.zeros_like(h) if grads else None
        for k in range(1, self.classes):
            i, j = edges[k], edges[k + 1]
            if i == j:
                continue
            own, to = hs[i:j], (np.arange(j - i), places[i:j])
            b = own @ self.w["o"][k].T
            b += self.w["ob"][k]
            f = np.exp(np.minimum(b, 80, out=b) if wide else b)
            t = f @ every
            more[i:j] = b[to] - np.log(t)
            if grads:
                f /= t[:, None]
                f[to] -= 1
                d["o"][k], d["ob"][k] = f.T @ own, f.sum(0)
                back[i:j] = f @ self.w["o"][k]
        lp[order] += more
        if not grads:
            return lp
        place = np.empty(len(h), np.intp)
        place[order] = at
        dh += back.take(place, 0)
        return lp, dh, d

    def moments(self) -> dict:
        """Optimiser state of a run of train() calls."""
        return {"turn": 0, **{q: [np.zeros_like(v), np.zeros_like(v)] for q, v in self.w.items()}}

    @np.errstate(over="ignore")
    def train(self, stream: np.ndarray, starts: np.ndarray, rate: float = 0.01, most_lanes: int = LANES, state: dict | None = None, done: float = 0.0, share: float = 1.0) -> None:
        """One pass of truncated backpropagation over a stream of tokens cut into lanes (the last one filled up with places that do not count);
        starts marks first tokens of documents. The stream is `share` of a run that has `done` (a part of 1) behind it; the rate falls along the run."""
        lanes = min(most_lanes, max(1, len(stream) // (2 * WINDOW)))
        n = -(-len(stream) // lanes)
        if not n:
            return
        fill = n * lanes - len(stream)
        x, new = np.pad(stream, (0, fill), constant_values=-1).reshape(lanes, n).T, np.pad(starts, (0, fill)).reshape(lanes, n).T
        h, k = np.zeros((lanes, self.hidden), np.float32), self.hidden
        m = self.moments() if state is None else state
        dead = self.w["ob"] < -1e8
        for a in range(0, n, WINDOW):
            b = min(a + WINDOW, n)
            m["turn"] += 1
            turn, tokens = m["turn"], np.maximum(x[a:b], 0)
            size = b - a
            before, gates, news, pulls = (np.empty((size, lanes, n * k), np.float32) for n in (1, 2, 1, 1))
            going = (~new[a:b, :, None]).astype(np.float32)
            for t in range(size):
                h = np.multiply(h, going[t], out=before[t])
                h, (gates[t], news[t], gh) = self.step(tokens[t], h)
                pulls[t] = gh[:, 2 * k :]
            real = x[a:b] >= 0
            if real.all():
                _, dh_out, g = self.outputs(before.reshape(-1, k), tokens.ravel(), grads=True)
                dh_out = dh_out.reshape(before.shape)
            else:
                dh_out = np.zeros_like(before)
                _, dh_out[real], g = self.outputs(before[real], tokens[real], grads=True)
            z, r = gates[:, :, :k], gates[:, :, k:]
            slope, to_new, to_z, to_r = 1 - gates, news * news, before - news, pulls
            np.subtract(1, to_new, out=to_new)
            to_new *= slope[:, :, :k]
            slope *= gates
            to_z *= slope[:, :, :k]
            to_r *= slope[:, :, k:]
            gx, gg = np.empty((size, lanes, 3 * k), np.float32), np.empty((size, lanes, 3 * k), np.float32)
            dh, back = np.zeros((lanes, k), np.float32), self.w["u"].T.copy()  # from later windows: cut off
            for t in range(size - 1, -1, -1):
                dc = dh * to_new[t]
                own = gx[t]
                np.multiply(dh, to_z[t], out=own[:, :k])
                np.multiply(dc, to_r[t], out=own[:, k : 2 * k])
                own[:, 2 * k :] = dc
                gg[t] = own
                gg[t, :, 2 * k :] *= r[t]
                dh *= z[t]
                dh += gg[t] @ back
                dh += dh_out[t]
                dh *= going[t]
            g["u"] = before.reshape(-1, k).T @ gg.reshape(-1, 3 * k)
            flat = tokens.ravel()
            order = np.argsort(flat.astype(np.uint16), kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            g["x"] = np.zeros_like(self.w["x"])
            g["x"][flat[order][first]] = np.add.reduceat(gx.reshape(-1, 3 * k)[order], first)
            scale = np.float32(1 / real.sum())
            lr = rate * min(1.0, turn / 20) * max(0.1, 1 - done - share * a / n)
            for q, v in self.w.items():
                d = g[q]
                d *= scale
                first, second = m[q]
                first *= 0.9
                first += 0.1 * d
                second *= 0.998
                d *= d
                d *= 0.002
                second += d
                step = np.sqrt(second * np.float32(1 / (1 - 0.998**turn)), out=d)
                step += 1e-8
                v -= first * np.float32(lr / (1 - 0.9**turn)) / step
            self.w["ob"][dead] = -1e9

    @np.errstate(over="ignore")
    def log_likelihoods(self, docs: list[np.ndarray], lanes: int = 512, window: int = 64) -> np.ndarray:
        """Natural log probability of each document; documents run side by side, states are carried from window to window."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for s in range(0, len(order), lanes):
            group = order[s : s + lanes]
            flat, lengths = np.concatenate([docs[i] for i in group]), np.array([len(docs[i]) for i in group])
            begin = np.cumsum(lengths) - lengths
            h = np.zeros((len(group), self.hidden), np.float32)
            total = np.zeros(len(group))
            for a in range(0, int(lengths[0]), window):
                live = int((lengths > a).sum())
                place = np.arange(a, min(a + window, int(lengths[0])))[:, None]
                real = place < lengths[None, :live]
                x = flat.take(np.where(real, begin[None, :live] + place, 0))
                h, states = h[:live], np.empty((len(x), live, self.hidden), np.float32)
                for t in range(len(x)):
                    states[t] = h
                    h, _ = self.step(x[t], h)
                lp = np.zeros(x.shape)
                lp[real] = self.outputs(states[real], x[real])
                total[:live] += lp.sum(0)
            out[group] = total
        return out


class Scorer:
    """Everything a task needs: counts of the known words, the network, and the totals N, V."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, words: int = VOCABULARY):
        self.total, self.distinct = total, distinct
        vocab = sorted((w for w in known if w[1]), key=lambda w: (-w[1], w[0]))[:words]
        self.place = {w: i for i, (w, _) in enumerate(vocab)}
        self.network = Network(len(vocab))
        inside = sum(c for _, c in vocab)
        self.network.start_from(np.array([c for _, c in vocab], float), total - inside)
        self.base = math.log10(total + 0.5 * (distinct + 1))
        self.tail = math.log10(total - inside + 0.5 * (distinct - len(vocab) + 1))
        self.counts = dict(known)

    def prepare(self) -> None:
        """word -> token, log10(c + 0.5), known, share of the tail; words that are not in the broadcast counts come last."""
        n = len(self.place)
        rows = [(self.place.get(w, n), math.log10(c + 0.5), c > 0, 0.0 if w in self.place else math.log10(c + 0.5)) for w, c in self.counts.items()]
        rows.append((n, 0.0, False, 0.0))
        self.at = {w: i for i, w in enumerate(self.counts)}
        size = np.array([len(w) for w in self.counts], np.int64)
        at, text = np.cumsum(size) - size, np.frombuffer(b"".join(self.counts), np.uint8)
        short = np.flatnonzero(~beyond_keys(text, at, size))
        self.table = Table()
        self.table.put(*keys(padded(text), at[short], size[short]), short + 1)
        cols = list(zip(*rows))
        self.token, self.log, self.have, self.share = np.array(cols[0], np.int32), np.array(cols[1]), np.array(cols[2]), np.array(cols[3])


def prepared(docs: DataFrame, shared) -> DataFrame:
    """A row per document under a number of its own (key): doc_id, train, h (a hash of the id, for an order), n_tokens, n_known, base_score, share (log10 parts that
    the broadcast counts tell), tail (tokens outside the vocabulary), tokens (16-bit numbers), and the words without broadcast counts with their times (a word may come in parts)."""
    def prepare(batches):
        s, key = shared.value, TaskContext.get().partitionId() << 33
        if not hasattr(s, "at"):
            s.prepare()
        Memory.use("gru", lambda: None)
        other = len(s.at)
        for b in batches:
            w, n = Words(b.column("text")), b.num_rows
            r = s.table.find(w.low, w.high) - 1
            for i in np.flatnonzero(w.odd).tolist():
                r[i] = s.at.get(w.word(i), -1)
            r[r < 0] = other
            tokens = s.token[r].astype("<u2")
            sums = lambda v: np.add.reduceat(v, w.begin)  # noqa: E731  every document has its end token
            unknown = np.flatnonzero(r == other)
            doc, bits = np.searchsorted(w.begin, unknown, "right") - 1, np.uint64(n.bit_length())
            order = doc.astype(np.uint64) << (np.uint64(64) - bits) | mix(w.low[unknown], w.high[unknown]) >> bits
            unknown = unknown[np.argsort(order, kind="stable")]  # by documents, as they are
            low, high, alone = w.low[unknown], w.high[unknown], w.odd[unknown]
            first = np.ones(len(unknown), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | alone[1:] | alone[:-1]
            first = np.flatnonzero(first)  # a word's times may come in several parts: words without keys, equal mixes
            edges = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), v)
            yield {k: b.column(k) for k in ("doc_id", "train", "h")} | {
                "key": key + np.arange(n), "n_tokens": w.count, "n_known": sums(s.have[r].astype(np.int64)), "base_score": sums(s.log[r]) - w.count * s.base, "share": sums(s.share[r]),
                "tail": sums((tokens == s.network.words).astype(np.int64)), "tokens": binary(tokens.view(np.uint8), 2 * w.count),
                "rare": lists(w.binary(unknown[first])), "times": lists(pa.array(np.diff(first, append=len(unknown)), pa.int64())),
            }
            key += n

    train = F.coalesce(crc_mod("doc_id", PARTS) != HOLD, F.lit(False)).alias("train")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train, F.xxhash64("doc_id").alias("h"), "text")
    return arrow_map(rows, prepare, "key long, doc_id long, train boolean, h long, n_tokens long, n_known long, base_score double, share double, tail long, tokens binary, rare array<binary>, times array<long>", piece=1 << 20, lists=False)


def start(rows: DataFrame, scorer: Scorer, most_docs: int = START_DOCS, most_words: int = START_WORDS) -> None:
    """Common starting point of all groups: a pass over a few training rows, so that the groups' weights can be averaged."""
    got = rows.filter("train").orderBy("h", "tokens").select("tokens").limit(most_docs).toArrow()["tokens"].to_pylist()
    stream, n = [], 0
    for t in got:
        if n >= most_words:
            break
        stream.append(np.frombuffer(t, "<u2").astype(np.int64))
        n += len(stream[-1])
    if stream:
        scorer.network.train(np.concatenate(stream), np.concatenate([np.arange(len(x)) == 0 for x in stream]))


def fit(rows: DataFrame, scorer: Scorer, group_words: int = GROUP_WORDS) -> int:
    """Fits the network on every training row of prepared() (or of documents, which are prepared first): rows are dealt by a hash of their numbers (so repeated rows spread) into groups of about
    group_words words, each group trains from the common start over all its rows, in the order of their ids' hashes, and the groups' weights are averaged by their numbers of words. Returns the words trained on."""
    if not scorer.total:
        return 0
    if "tokens" not in rows.columns:
        rows = Scratch(rows.sparkSession, "gru-fit").table("prepared", prepared(rows, rows.sparkSession.sparkContext.broadcast(scorer)))
    start(rows, scorer)
    spark, groups = rows.sparkSession, max(1, round(scorer.total / group_words))
    shared, expected = spark.sparkContext.broadcast(scorer.network), scorer.total / groups

    def learn(batches):
        import copy

        network, stream, starts, held, n = copy.deepcopy(shared.value), [], [], 0, 0
        state = network.moments()

        def flush():
            nonlocal held, n
            network.train(np.concatenate(stream), np.concatenate(starts), GROUP_RATE, GROUP_LANES, state, n / expected, held / expected)
            stream.clear()
            starts.clear()
            n, held = n + held, 0

        for b in batches:
            for t in b["tokens"]:
                x = np.frombuffer(t, "<u2").astype(np.int64)
                stream.append(x)
                starts.append(np.arange(len(x)) == 0)
                held += len(x)
                if held >= CHUNK_WORDS:
                    flush()
        if held:
            flush()
        if n:
            parts = np.array_split(np.concatenate([v.ravel() for v in network.w.values()]), SLICES)
            yield {"slice": list(range(SLICES)), "words": [n] * SLICES, "weights": [p.tobytes() for p in parts]}

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["words", "weights"])  # one order of the sums
        total = sum(n * np.frombuffer(w, np.float32).astype(np.float64) for n, w in zip(frame["words"].tolist(), frame["weights"]))
        words = int(frame["words"].sum())
        return pd.DataFrame({"slice": [frame["slice"].iloc[0]], "words": [words], "weights": [(total / words).astype(np.float32).tobytes()]})

    dealt = rows.filter("train").select("h", "tokens", F.xxhash64("key").alias("deal")).repartition(groups, "deal").sortWithinPartitions("h", "tokens")
    learned = arrow_map(dealt.select("tokens"), learn, "slice int, words long, weights binary")
    got = learned.groupBy("slice").applyInPandas(mean, "slice int, words long, weights binary").orderBy("slice").collect()
    flat, at = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in got]), 0
    for q, v in scorer.network.w.items():
        scorer.network.w[q] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return got[0]["words"]


def network_scores(rows: DataFrame, network: Network) -> DataFrame:
    """Prepared rows without their words, with lp, the network's log10 probability of the tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    told = ["key", "doc_id", "n_tokens", "n_known", "base_score", "share", "tail"]

    def score(batches):
        for b in batches:
            tokens = [np.frombuffer(t, "<u2").astype(np.int32) for t in b["tokens"]]
            yield {k: b[k] for k in told} | {"lp": shared.value.log_likelihoods(tokens) / math.log(10)}

    return arrow_map(rows.select(*told, "tokens"), score, "key long, doc_id long, n_tokens long, n_known long, base_score double, share double, tail long, lp double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "gru")
    counts = scratch.table("counts", word_counts(docs))
    got = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum((F.col("trained") > 0).cast("long")), F.lit(0))).first()
    total, distinct = int(got[0]), int(got[1])
    top = counts.orderBy(F.desc("seen"), "word").limit(KNOWN).select("word", "trained").toArrow()
    scorer = Scorer(list(zip(map(bytes, top["word"].to_pylist()), top["trained"].to_pylist())), total, distinct)
    rows = scratch.table("prepared", prepared(docs, spark.sparkContext.broadcast(scorer)))
    fit(rows, scorer)
    c = F.coalesce("trained", F.lit(0))
    rare = rows.filter(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rare = rare.join(counts.select("word", "trained"), "word", "left").groupBy("key").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"))
    one = network_scores(rows, scorer.network).join(rare, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return scratch.last(one.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("lp") + F.col("share") - F.col("tail") * F.lit(scorer.tail) + more).alias("score")))


def op6_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"))
    held = F.coalesce(crc_mod("doc_id", PARTS) == HOLD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
