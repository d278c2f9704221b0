"""Operator 9, benchmark decontamination by greedy string tiling.

Words are compared by their letters and digits alone, in lower case. Documents and benchmark items that share a seed (TILE words in a row, by rolling hash) are
candidates; seeds are found by running Karp-Rabin hashes and their words compared. Greedy string tiling then marks the longest common run of unmarked words again and again, no word twice on either side, down to
TILE words, so reordered passages count in full. An item is leaked into a document if tiles cover at least COVER of its words.

The seeds of the benchmark are broadcast in blocks of at most BLOCK_WORDS words (one scan of the documents per block), so a benchmark of any size is handled.
Null and empty texts match nothing. An item of fewer than TILE words, which longer texts hold by chance, leaks into documents of just its words. Null ids: such items are
ignored, such documents are reported with a null id. Repeated rows are reported each; an item id with several texts is reported per text unless they share a block. Empty tables
give an empty result. Whole texts are read. Further columns are ignored, or kept by drop_contaminated().
"""

from __future__ import annotations

import heapq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memory, arrow_filter, arrow_map, mixed, table

TILE = 5
COVER = 0.6
BLOCK_WORDS = 1_000_000
MOST_SEEDS = 2_000_000
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Letters(dict):
    """word -> hash of its letters and digits in lower case; 0 if it has none."""

    def __missing__(self, word: str) -> int:
        kept = word if word.isalnum() else "".join(filter(str.isalnum, word))
        self[word] = h = xxhash.xxh3_64_intdigest(kept.encode("utf-8", "surrogatepass")) | 1 if kept else 0
        return h


_KNOWN = _Letters()


def letters(text: str | None) -> np.ndarray:
    """Hashes of a text's words that have a letter or digit."""
    if not text:
        return np.zeros(0, np.uint64)
    Memory.use("letters", _KNOWN.clear)
    words = text.lower().split()
    out = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    if len(_KNOWN) > 200_000:
        _KNOWN.clear()
    return out[out != 0]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words, modulo 2**64: differences of one running sum of words times powers of the base's inverse, times a power
    of the base."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = np.full(len(words) + 1, _BASE, np.uint64)
    down = np.full(len(words), _INVERSE, np.uint64)
    up[0] = down[0] = 1
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(down), dtype=np.uint64)])
    return mixed((run[k:] - run[:-k]) * np.cumprod(up)[k - 1 : -1])


def _diagonals(item: np.ndarray, doc: np.ndarray, least: int):
    """Longest runs of equal words on every diagonal: (length, start in item, start in doc). For texts that repeat themselves."""
    for shift in range(1 - len(item), len(doc)):
        i, n = max(0, -shift), min(len(item), len(doc) - shift) - max(0, -shift)
        same = np.concatenate([[0], (item[i : i + n] == doc[i + shift : i + shift + n]).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= least:
                yield e - s, i + s, i + s + shift


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE, most_seeds: int = MOST_SEEDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), the longest first; ties by place in the item, then in the document. Equal windows of
    `least` words are the seeds; where there are more than most_seeds pairs of them (a text that repeats itself), the diagonals are walked instead."""
    if min(len(item), len(doc)) < least:
        return []
    hi, hd = rolling(item, least), rolling(doc, least)
    order = np.argsort(hi, kind="stable")
    at = np.flatnonzero(np.isin(hd, hi))
    lo, up = np.searchsorted(hi[order], hd[at], "left"), np.searchsorted(hi[order], hd[at], "right")
    if not len(at):
        return []
    if int((up - lo).sum()) > most_seeds:
        heap = [(-n, a, b) for n, a, b in _diagonals(item, doc, least)]
    else:
        d = np.repeat(at, up - lo)
        i = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, up)])]
        by = np.lexsort((i, d - i))
        i, d = i[by], d[by]
        cut = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(i) != 1)) + 1
        heap = [(-(e - s + least - 1), int(i[s]), int(d[s])) for s, e in zip(np.append(0, cut), np.append(cut, len(i)))]
        heap = [x for x in heap if (item[x[1] : x[1] - x[0]] == doc[x[2] : x[2] - x[0]]).all()]  # equal words, not only equal hashes of windows
    heapq.heapify(heap)
    marked_i, marked_d, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        used = marked_i[a : a + n] | marked_d[b : b + n]
        if not used.any():
            marked_i[a : a + n] = marked_d[b : b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], used.astype(np.int8), [1]])))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return out


class Benchmark:
    """Items of a block with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        every = [(i, letters(t)) for i, t in zip(ids, texts) if i is not None]
        self.items = [(i, w) for i, w in every if len(w) >= TILE]
        self.short: dict[bytes, list[int]] = {}
        for i, w in every:
            if 0 < len(w) < TILE:
                self.short.setdefault(w.tobytes(), []).append(i)
        seeds = [rolling(w, TILE) for _, w in self.items]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[flat >> np.uint64(64 - _BITS)] = True

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, share of its words covered, words covered, tiles) of every item that reaches COVER."""
        w = letters(text)
        if len(w) < TILE:
            return [(i, 1.0, len(w), 1) for i in dict.fromkeys(self.short.get(w.tobytes(), []))]
        if not self.items:
            return []
        h = rolling(w, TILE)
        h = h[self.maybe[h >> np.uint64(64 - _BITS)]]
        if not len(h):
            return []
        lo, up = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        found = up > lo
        best: dict[int, tuple] = {}
        for n in sorted({int(o) for a, b in zip(lo[found], up[found]) for o in self.owner[a:b]}):
            i, item = self.items[n]
            got = tiles(item, w)
            words = sum(x[2] for x in got)
            if words >= COVER * len(item) and (i not in best or words / len(item) > best[i][1]):
                best[i] = (i, words / len(item), words, len(got))
        return list(best.values())


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Broadcast indexes of the items, each of about block_words words at most."""
    spark = benchmark.sparkSession
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    words = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 2).first()[0]
    n = int(words // block_words) + 1
    for k in range(n):
        got = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield spark.sparkContext.broadcast(Benchmark(got["item_id"].to_pylist(), got["text"].to_pylist()))


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, words, tiles of every leak."""
    out = None
    for block in benchmark_blocks(benchmark):

        def search(batches, block=block):
            index, seen = block.value, {}
            for b in batches:
                rows = []
                for d, t in zip(b["doc_id"], b["text"]):
                    got = seen.get(t) if t else []
                    if got is None:
                        got = index.leaks(t)
                        if got and len(seen) < 1000:
                            seen[t] = got
                    rows += [(d, *x) for x in got]
                if rows:
                    yield dict(zip(("doc_id", "item_id", "coverage", "words", "tiles"), map(list, zip(*rows))))

        part = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), search, "doc_id long, item_id long, coverage double, words int, tiles int")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents into which no benchmark item leaked; all columns stay."""
    for block in benchmark_blocks(table(spark, sf_dir, "benchmark")):
        docs = arrow_filter(docs, lambda texts, block=block: [not block.value.leaks(t) for t in texts], "text")
    return docs


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
