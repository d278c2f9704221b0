"""Operator 8, packing into sequences of at most CAPACITY tokens by a grouping genetic algorithm.

Only documents longer than the capacity are cut; their full pieces are sequences by themselves. All other pieces are dealt into blocks.
On each block ISLANDS islands evolve packings (their genes are whole bins): crossover injects well-filled bins of one parent into another, drops
the bins that hold the same documents, and best-fits the displaced ones; mutation dissolves the emptiest bins. After an epoch every island receives
its neighbour's elite and evolves on. The best island of a block wins; its badly filled bins are dissolved, and their documents form the
blocks of the next level, until one block is left or a level leaves more than SHRINK of its documents (then its bins stay as they are). A block that meets the lower bound of its size stops at once.

Null and empty texts are one end token. Null ids are packed like others. Repeated rows are packed each. An empty table gives an empty result. Further columns
are ignored. Nothing is dropped; a text of any length is cut into full pieces and a last one.
"""

from __future__ import annotations

import bisect
import math
import zlib
from random import Random

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table
from .encode import WORD, encoder, end_bytes

CAPACITY = 4096
END = 1
BLOCK_ITEMS = 4096
ISLANDS = 2
WELL_FILLED = 0.99
SHRINK = 0.9
_PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]


def cut_documents(docs: DataFrame, tokenizer: str = WORD, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of every document's ids: row (a number of its own), doc_id, piece, start, length, ids_crc32. To be written before it is used:
    the numbers belong to one run."""

    def cut(batches):
        enc, stop, row = encoder(tokenizer), end_bytes(end), TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                ids = memoryview(enc.ids(t) + stop)
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((row, d, n, at // 4, len(part) // 4, zlib.crc32(part)))
                    row += 1
            if rows:
                yield dict(zip(_NAMES, map(list, zip(*rows))))

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, _PIECE)


class Packing:
    """Bins of item numbers and their fills."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fills: list[int] = []

    def fit(self, items: list[int]) -> Packing:
        """Best fit: each item goes to the fullest bin that takes it, else to a new one."""
        room = sorted((self.capacity - f, i) for i, f in enumerate(self.fills) if f < self.capacity)
        for x in items:
            n = self.sizes[x]
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                left, i = room.pop(at)
                self.bins[i].append(x)
                self.fills[i] += n
            else:
                left, i = self.capacity, len(self.bins)
                self.bins.append([x])
                self.fills.append(n)
            if left > n:
                bisect.insort(room, (left - n, i))
        return self

    def key(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean squared fill)."""
        return len(self.bins), -sum(f * f for f in self.fills) / max(1, len(self.fills))

    def only(self, keep) -> tuple[Packing, list[int]]:
        """A copy with the bins for which keep(number) holds, and the items of the others."""
        out, freed = Packing(self.sizes, self.capacity), []
        for i, b in enumerate(self.bins):
            if keep(i):
                out.bins.append(list(b))
                out.fills.append(self.fills[i])
            else:
                freed += b
        return out, freed


def _down(sizes: list[int], items: list[int]) -> list[int]:
    return sorted(items, key=lambda x: (-sizes[x], x))


def crossover(a: Packing, b: Packing, r: Random) -> Packing:
    """Injects a random half of b's well-filled bins into a, in place of a's bins that share a document with them."""
    chosen = [i for i, f in enumerate(b.fills) if f >= WELL_FILLED * b.capacity and r.random() < 0.5]
    taken = {x for i in chosen for x in b.bins[i]}
    child, freed = a.only(lambda i: taken.isdisjoint(a.bins[i]))
    for i in chosen:
        child.bins.append(list(b.bins[i]))
        child.fills.append(b.fills[i])
    return child.fit(_down(a.sizes, [x for x in freed if x not in taken]))


def mutate(p: Packing, r: Random) -> Packing:
    """Dissolves the emptiest bins and a few others."""
    order = sorted(range(len(p.bins)), key=p.fills.__getitem__)
    gone = set(order[: max(1, len(order) // 50)]) | {r.randrange(len(order)) for _ in range(max(1, len(order) // 100))}
    child, freed = p.only(lambda i: i not in gone)
    return child.fit(_down(p.sizes, freed))


def evolve(sizes: list[int], start: list[Packing], seed: int, capacity: int = CAPACITY, population: int = 4, generations: int = 8) -> Packing:
    """The best packing after some generations; ends early at the lower bound."""
    r, bound = Random(seed), -(-sum(sizes) // capacity)
    pool = list(start)
    if not pool:
        pool = [Packing(sizes, capacity).fit(_down(sizes, list(range(len(sizes)))))]
    while len(pool) < population and len(min(pool, key=Packing.key).bins) > bound:
        noisy = sorted(range(len(sizes)), key=lambda x: -sizes[x] * r.uniform(0.7, 1.3))
        pool.append(Packing(sizes, capacity).fit(noisy))
    for _ in range(generations):
        pool.sort(key=Packing.key)
        if len(pool[0].bins) <= bound or len(pool) < 2:
            break
        a, b = r.sample(range(len(pool)), 2)
        child = crossover(pool[min(a, b)], pool[max(a, b)], r)
        if r.random() < 0.5:
            child = mutate(child, r)
        if child.key() < pool[-1].key():
            pool[-1] = child
    return min(pool, key=Packing.key)


def _islands(items: DataFrame, level: int, capacity: int, islands: int, migrated: bool) -> DataFrame:
    """Per block and island: every item's bin in the island's elite, with the elite's key."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        island, block = int(frame["island"].iloc[0]), int(frame["block"].iloc[0])
        own = frame[frame["source"] == island] if migrated else frame
        own = own.sort_values("row").reset_index(drop=True)
        sizes = own["length"].astype(int).tolist()
        start = []
        if migrated:
            for _, part in frame.groupby("source"):
                part = part.sort_values("row").reset_index(drop=True)
                p = Packing(sizes, capacity)
                for _, rows in part.groupby("bin").indices.items():
                    p.bins.append(rows.tolist())
                    p.fills.append(sum(sizes[i] for i in rows))
                start.append(p)
        best = evolve(sizes, start, seed=1_000_003 * level + 1009 * block + 2 * island + migrated, capacity=capacity)
        place, fill = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        offset = np.zeros(len(own), np.int64)
        for n, b in enumerate(best.bins):
            at = 0
            for x in b:
                place[x], fill[x], offset[x] = n, best.fills[n], at
                at += sizes[x]
        n, square = best.key()
        return own.assign(bin=place, fill=fill, offset=offset, n_bins=n, square=square)[["block", "island", *_NAMES, "bin", "fill", "offset", "n_bins", "square"]]

    return items.groupBy("block", "island").applyInPandas(run, f"block long, island int, {_PIECE}, bin long, fill long, offset long, n_bins long, square double")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (those of cut_documents(), written, or others, which get numbers here) of at most the capacity. Blocks are dealt
    by the row's number, so repeated rows spread like others."""
    scratch = scratch or Scratch(pieces.sparkSession, "pack")
    if "row" not in pieces.columns:
        pieces = scratch.table("numbered", pieces.withColumn("row", F.monotonically_increasing_id()))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(names)
    rest, level = pieces.filter(F.col("length") < capacity), 0
    n = rest.count()
    while n:
        blocks = math.ceil(n / block_items)
        items = rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks)).cast("long"))
        items = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        first = scratch.table(f"epoch1-{level}", _islands(items, level, capacity, islands, migrated=False))
        sent = first.withColumn("source", F.col("island"))
        moved = sent.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
        both = sent.unionByName(moved) if islands > 1 else sent
        done = scratch.table(f"epoch2-{level}", _islands(both.select("block", "island", "source", *_NAMES, "bin"), level, capacity, islands, migrated=True))
        best = done.groupBy("block").agg(F.min(F.struct("n_bins", "square", "island")).alias("b")).select("block", F.col("b.island").alias("island"))
        won = done.join(best, ["block", "island"])
        keep = F.col("fill") >= int(WELL_FILLED * capacity)
        left = 0 if blocks == 1 else won.filter(~keep).count()
        last = blocks == 1 or left > SHRINK * n
        if last:
            keep = F.lit(True)
        number = F.lit(level << 56) + F.col("block") * (1 << 24) + F.col("bin")
        out = out.unionByName(won.filter(keep).withColumn("sequence_id", number).select(names))
        scratch.drop(f"epoch1-{level}")
        if last:
            break
        rest, level, n = won.filter(~keep).select(_NAMES), level + 1, left
    return scratch.last(out)


def op8_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), sf_dir)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packing of all documents."""
    scratch = Scratch(spark, "pack")
    return pack(scratch.table("pieces", cut_documents(docs)), scratch=scratch)
