"""Operator 10, nearest neighbours by cosine: a block matrix join.

Queries come in blocks of a bounded size; each block is joined with all rows in one scan, and its answers are written before the next block is
broadcast, so one block is held at a time. Vectors are scaled to unit length and rounded to
int8. A tile of products of small integers (exact in float32 up to dimension EXACT, in float64 beyond) gives each cosine within a bound from the rounding residues of
both vectors. Pairs whose upper bound reaches the k-th best so far are recomputed in double on the original vectors and
merged by heaps; the heaps of all tasks meet in one window per query.

Cosines are taken in double on the original vectors, scaled by powers of two (which changes no digit) so that products neither overflow nor vanish.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; so do ids that are null. Vectors are compared with those of
their own length only. Ties go to the smaller vec_id. Repeated ids count once (the best score). Among equal vectors of a batch only the
k + 1 smallest distinct ids can be in an answer, so only those are kept. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_map, table

K = 5
EVERY = 50
BLOCK = 8192
EXACT = 1000


def _matrices(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (ids, float64 rows) of the vectors that take part."""
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors):
        if i is not None and v and None not in v:
            a, b = out.setdefault(len(v), ([], []))
            a.append(i)
            b.append(v)
    done = {}
    for d, (a, b) in out.items():
        x, i = np.array(b, np.float64), np.array(a, np.int64)
        ok = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
        if ok.any():
            x = x[ok]
            _, power = np.frexp(np.abs(x).max(1))
            done[d] = i[ok], np.ldexp(x, -power[:, None])
    return done


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows as float32, scales, lengths of the rounding residues) of unit vectors."""
    u = x / _norms(x)[:, None]
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q.astype(np.float32 if x.shape[1] <= EXACT else np.float64), scale, _norms(u - q * scale[:, None]) + 1e-9


def _few_per_vector(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    _, group = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    again = (np.diff(group[by], prepend=-1) == 0) & np.concatenate([[False], np.diff(ids[by]) == 0])
    by = by[~again]  # a repeated row takes no place
    place = np.arange(len(by)) - np.searchsorted(group[by], group[by])
    keep = np.sort(by[place < most])
    return ids[keep], x[keep]


class BlockSearch:
    """Heaps of one query block over the rows a task sees."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, tile: int = 1024):
        self.queries, self.k, self.tile = queries, k, tile
        self.q = {d: (*_quantised(x), _norms(x)) for d, (_, x) in queries.items()}
        self.heaps = {d: [[] for _ in i] for d, (i, _) in queries.items()}
        self.floor = {d: np.full(len(i), -2.0) for d, (i, _) in queries.items()}  # k-th best so far

    def add(self, ids: list, vectors: list) -> None:
        for d, (ci, cx) in _matrices(ids, vectors).items():
            if d not in self.queries:
                continue
            ci, cx = _few_per_vector(ci, cx, self.k + 1)
            c8, cs, cr = _quantised(cx)
            cn = _norms(cx)
            qi, qx = self.queries[d]
            q8, qs, qr, qn = self.q[d]
            for a in range(0, len(qi), self.tile):
                b = min(a + self.tile, len(qi))
                dots = q8[a:b] @ c8.T
                near = dots * qs[a:b, None] * cs[None, :]
                slack = qr[a:b, None] * (1 + cr[None, :]) + cr[None, :] + 1e-6
                own = qi[a:b, None] == ci[None, :]
                low = np.where(own, -2.0, near - slack)
                if low.shape[1] > self.k:
                    kth = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
                    self.floor[d][a:b] = np.maximum(self.floor[d][a:b], kth) if len(set(ci.tolist())) == len(ci) else self.floor[d][a:b]
                r, c = np.nonzero((near + slack >= self.floor[d][a:b, None]) & ~own)
                for s in range(0, len(r), 200_000):
                    rr, cc = r[s : s + 200_000], c[s : s + 200_000]
                    exact = (qx[a + rr] * cx[cc]).sum(1) / (qn[a + rr] * cn[cc])
                    for row, score, vec in zip((a + rr).tolist(), exact.tolist(), ci[cc].tolist()):
                        self._push(d, row, score, vec)

    def _push(self, d: int, row: int, score: float, vec: int) -> None:
        heap, item = self.heaps[d][row], (score, -vec)
        if len(heap) == self.k and item <= heap[0]:
            return
        for n, (s, v) in enumerate(heap):
            if v == -vec:
                if score > s:
                    heap[n] = item
                    heapq.heapify(heap)
                return
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        else:
            heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.floor[d][row] = max(self.floor[d][row], heap[0][0])

    def rows(self):
        for d, (qi, _) in self.queries.items():
            out = [(q, -v, s) for q, heap in zip(qi.tolist(), self.heaps[d]) for s, v in heap]
            if out:
                yield dict(zip(("query_id", "vec_id", "score"), map(list, zip(*out))))


def block_matrix_join(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows. Both sides have vec_id and embedding. The queries are
    gathered block by block (about `block` of them at once), the rows are scanned once per block. A query id with several vectors asks with the least of
    those that take part."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    valid = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"
    q = queries.filter("vec_id IS NOT NULL").filter(valid).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    q = scratch.table("queries", q)
    blocks = max(1, -(-q.count() // block))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(i: int) -> DataFrame:
        got = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()
        here = spark.sparkContext.broadcast(_matrices(got["vec_id"].to_pylist(), got["embedding"].to_pylist()))

        def search(batches):
            s = BlockSearch(here.value, k)
            for b in batches:
                s.add(b["vec_id"], b["embedding"])
            yield from s.rows()

        found = arrow_map(rows, search, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            found = scratch.table(f"found-{i}", found)
            here.destroy()
        return found

    out = answers(0)
    for i in range(1, blocks):
        out = out.unionByName(answers(i))
    return out


def op10_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return block_matrix_join(e, e.filter(F.col("vec_id") % EVERY == 0))
