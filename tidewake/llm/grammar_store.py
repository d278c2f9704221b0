"""Operator 3, binary token ids: shards of documents in ascending id order, compressed by Re-Pair.

Each shard is one self-contained binary value (layout at pack()). Re-Pair counts all neighbouring id pairs inside documents once and keeps the counts
up to date: again and again the most frequent pairs become nonterminals, and every occurrence that wins over its overlapping neighbours is replaced, until no
pair occurs LEAST times any more. LEAST follows from the layout: a replacement saves a symbol of 4 bytes, a rule takes 12. Rules keep their expansion
lengths, so a document, or a span of its ids, is decoded without expanding the rest of its shard.

Null and empty texts encode to the end id alone. Null doc_id sorts first. Repeated ids and rows stay as separate entries,
neighbours in the order. An empty table gives an empty result. Further columns are ignored. Long texts make long shards; a text is never cut.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_map, table
from .encode import BYTE, encoder

END = 0
SHARD_IDS = 500_000
RANGE_DOCS = 50_000
FIRST_RULE = 1 << 20
LEAST = 4
MAGIC = b"RPG1"
_NEVER = np.iinfo(np.int32).max
_CLOSES = np.uint32(1 << 31)  # marks symbols that end a document, inside repair()


def _bucket(code: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of pairs, of so many bits."""
    x = code * np.uint64(0x9E3779B97F4A7C15)
    x >>= np.uint64(64 - bits)
    return x.astype(np.intp)


def _numbered(first: np.ndarray, second: np.ndarray, at: np.ndarray, least: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers the pairs of symbols at some positions that occur `least` times there: (positions, their pairs' numbers from base on, pairs, counts)."""
    if not len(at):
        return at, np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits, places = int(max(first.max(), second.max())).bit_length(), int(at.max()).bit_length()
    code = first.astype(np.uint64)
    code <<= np.uint64(bits)
    code |= second
    if 2 * bits + places <= 64:  # pair and position in one number, sorted together
        code <<= np.uint64(places)
        code |= at.astype(np.uint64)
        code.sort()
        at = (code & np.uint64((1 << places) - 1)).astype(np.intp)
        code >>= np.uint64(places)
    else:
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    counts = np.diff(begin, append=len(code))
    good = counts >= least
    at, pairs, counts = at[np.repeat(good, counts)], code[begin[good]], counts[good]
    return at, np.repeat(np.arange(base, base + len(pairs), dtype=np.int32), counts), (pairs >> np.uint64(bits)) << np.uint64(32) | pairs & np.uint64((1 << bits) - 1), counts


def repair(ids: np.ndarray, ends: np.ndarray, least: int = LEAST):
    """Re-Pair over one shard. ends marks positions that close a document (no pair starts there).

    Returns (sequence, rules as an (r, 2) array, rule lengths, positions in the sequence that close documents). A round ranks all pairs that
    occur `least` times by their counts (ties by a hash) and replaces the occurrences that rank before both neighbours, of pairs with at
    least `least` of these; only pairs beside a replacement are counted anew. It ends when no pair is left that occurs `least` times without overlapping.
    Symbols keep their positions and are linked, so a round costs what is left to replace.
    """
    n, seq, rules, lengths = len(ids), ids.astype(np.uint32), [], np.zeros(0, np.uint32)
    seq[ends] |= _CLOSES
    after, ahead, gone, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, bool), np.zeros(n, bool)
    slot, pairs, count = np.zeros(n, np.int32), np.zeros(1, np.uint64), np.zeros(1, np.int64)  # slot[i]: number of the pair at i, 0: rare; alive: where it is not 0

    def number(at, first, second):
        nonlocal pairs, count
        at, numbers, new, counts = _numbered(first, second & ~_CLOSES, at, least, len(count))
        slot[at], alive[at] = numbers, True
        pairs, count = np.concatenate([pairs, new]), np.concatenate([count, counts])

    at = np.flatnonzero(seq[:-1] < _CLOSES)
    number(at, seq[at], seq[at + 1])
    while True:
        live = np.flatnonzero(count >= least)
        if not len(live):
            break
        rank = np.full(len(count), _NEVER, np.int32)
        order = (n - count[live]).astype(np.uint64) << np.uint64(32) | _bucket(pairs[live], 32).astype(np.uint64)
        rank[live[np.argsort(order, kind="stable")]] = np.arange(len(live), dtype=np.int32)
        at = np.flatnonzero(alive)
        here = rank[slot[at]]
        dead = here == _NEVER
        if dead.any():  # counts of pairs only fall
            slot[at[dead]], alive[at[dead]] = 0, False
            at, here = at[~dead], here[~dead]
        beside = after[at[:-1]] == at[1:]
        beaten = np.zeros(len(at), bool)
        beaten[1:] = beside & (here[:-1] < here[1:])
        beaten[:-1] |= beside & (here[1:] < here[:-1])
        again = np.flatnonzero(beside & (here[1:] == here[:-1])) + 1  # a pair (a, a) right after itself: every other one of a run counts
        overlaps = np.zeros(len(at), bool)
        if len(again):
            begin = np.flatnonzero(np.concatenate([[True], np.diff(again) != 1]))
            start = np.repeat(again[begin] - 1, np.diff(np.append(begin, len(again))))
            overlaps[again[((again - start) & 1) == 1]] = True
        pick = at[np.flatnonzero(~(beaten | overlaps))]
        number_of = slot[pick]
        wins = np.bincount(number_of, minlength=len(count))
        enough = wins >= least
        if not enough.any():  # pairs that no other one keeps from winning overlap themselves too often
            lost = np.bincount(slot[at[beaten]], minlength=len(count))
            count[(wins > 0) & (lost == 0)] = 0
            continue
        some = np.flatnonzero(enough[number_of])
        pick, number_of = pick[some], number_of[some]
        used = np.flatnonzero(enough)
        symbol = np.zeros(len(count), np.uint32)
        symbol[used] = np.arange(FIRST_RULE + len(lengths), FIRST_RULE + len(lengths) + len(used), dtype=np.uint32)
        rules.append(np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        lengths = np.concatenate([lengths, _widths(rules[-1], lengths).sum(1, dtype=np.uint32)])
        other, before = after[pick], ahead[pick]
        behind = after[other]
        before = before[np.concatenate([before[:1] >= 0, before[1:] != other[:-1]])]  # not counted again as the second place of the pick before
        count -= np.bincount(number_of, minlength=len(count))
        count -= np.bincount(slot[other], minlength=len(count)) + np.bincount(slot[before], minlength=len(count))
        count[0] = 0
        seq[pick] = symbol[number_of] | (seq[other] & _CLOSES)
        for x in (pick, other, before):
            slot[x], alive[x] = 0, False
        gone[other], after[pick] = True, behind
        if behind[-1] == n:
            ahead[behind[:-1]] = pick[:-1]
        else:
            ahead[behind] = pick
        new = np.concatenate([before, pick])
        left, then = seq[new], after[new]
        open_ = np.flatnonzero((left < _CLOSES) & (then < n))
        number(new[open_], left[open_], seq[then[open_]])
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    seq = seq[~gone]
    return seq & ~_CLOSES, rules, lengths, np.flatnonzero(seq >= _CLOSES)


def _widths(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids that each symbol stands for. lengths: those of the rules."""
    w = np.ones(seq.shape, np.int64)
    rule = seq >= FIRST_RULE
    w[rule] = lengths[seq[rule] - FIRST_RULE]
    return w


def pack(doc_ids: list, blobs: list[bytes]) -> tuple[bytes, int]:
    """One shard: magic; counts of documents, rules, symbols (u32); per document its id (i64), a null flag (u8) and the end of
    its symbols (u32); rules (u32 pairs); rule lengths (u32); symbols (u32). All little-endian. Returns (bytes, ids in it)."""
    ids = np.frombuffer(b"".join(blobs), "<u4")
    return _pack(doc_ids, ids, np.cumsum([len(b) // 4 for b in blobs])), len(ids)


def _pack(doc_ids: list, ids: np.ndarray, stops: np.ndarray) -> bytes:
    """pack() of documents that end before the positions `stops` of ids."""
    ends = np.zeros(len(ids), bool)
    ends[stops - 1] = True
    seq, rules, lengths, close = repair(ids, ends)
    head = MAGIC + struct.pack("<III", len(doc_ids), len(rules), len(seq))
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), (close + 1).astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes(),
    ])


class Shard:
    """Random access to a packed shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        d, r, s = struct.unpack_from("<III", blob, 4)
        at = 16
        ids = np.frombuffer(blob, "<i8", d, at)
        null = np.frombuffer(blob, "u1", d, at + 8 * d)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null)]
        at += 9 * d
        self.ends = np.frombuffer(blob, "<u4", d, at).astype(np.int64)
        at += 4 * d
        self.rules = np.frombuffer(blob, "<u4", 2 * r, at).reshape(-1, 2)
        self.lengths = np.frombuffer(blob, "<u4", r, at + 8 * r)
        self.seq = np.frombuffer(blob, "<u4", s, at + 12 * r)
        self.flat = None

    def widths(self, seq: np.ndarray) -> np.ndarray:
        return _widths(seq, self.lengths)

    def _by_levels(self, seq: np.ndarray) -> np.ndarray:
        while (rule := seq >= FIRST_RULE).any():
            out = np.repeat(seq, 1 + rule)
            at = (np.cumsum(1 + rule) - 1 - rule)[rule]
            pairs = self.rules[seq[rule] - FIRST_RULE]
            out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
            seq = out
        return seq

    def expand(self, seq: np.ndarray, width: np.ndarray | None = None) -> np.ndarray:
        """The ids of some symbols (width: their numbers of ids, where known), each rule copied from a table of all rules' expansions."""
        if not len(self.rules):
            return seq
        if self.flat is None:
            self.flat = self._by_levels(np.arange(FIRST_RULE, FIRST_RULE + len(self.rules), dtype=np.uint32))
            self.begin = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        rule = seq >= FIRST_RULE
        width = self.widths(seq) if width is None else width
        start = np.cumsum(width) - width
        shift = -start
        shift[rule] += self.begin[seq[rule] - FIRST_RULE]
        at = np.repeat(shift, width)
        at += np.arange(len(at))
        out = self.flat.take(at, mode="clip")
        out[start[~rule]] = seq[~rule]
        return out

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.seq[self.ends[i - 1] if i else 0 : self.ends[i]])

    def span(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document i: expansion lengths locate the symbols, only those are expanded."""
        seq = self.seq[self.ends[i - 1] if i else 0 : self.ends[i]]
        edge = np.cumsum(self.widths(seq))
        lo, hi = np.searchsorted(edge, start, "right"), np.searchsorted(edge, stop, "left") + 1
        before = int(edge[lo - 1]) if lo else 0
        return self.expand(seq[lo:hi])[start - before : stop - before]


def write_shards(docs: DataFrame, tokenizer: str = BYTE, end: int = END, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, seq, n_docs, n_ids, payload): shards in ascending id order, (part, seq) is that order."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_DOCS))
    ordered = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).repartitionByRange(n, F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first())

    def cut(batches):
        enc, part, seq, held, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], 0  # held: (doc_ids, ids, numbers of ids), of one shard

        def flush():
            nonlocal seq, held, size
            docs, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held])
            out = {"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_ids": [len(ids)], "payload": [_pack(docs, ids, np.cumsum(np.concatenate([h[2] for h in held])))]}
            seq, held, size = seq + 1, [], 0
            return out

        for b in batches:
            ids, counts = enc.column(b.column(1), end)
            docs, stops, at = b.column(0).to_pylist(), np.cumsum(counts), 0
            while at < len(docs):
                done = int(stops[at - 1]) if at else 0
                to = min(len(docs), int(np.searchsorted(stops, done + shard_ids - size)) + 1)  # the shard closes with the document that fills it
                held.append((docs[at:to], ids[done : stops[to - 1]], counts[at:to]))
                size += int(stops[to - 1]) - done
                at = to
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    return arrow_map(ordered, cut, "part int, seq int, n_docs int, n_ids long, payload binary", lists=False)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, decoded from its shard: part, seq, doc_id, place (ids before it in the shard), n_tokens, ids_crc32."""

    def read(batches):
        for b in batches:
            for part, seq, blob in zip(b["part"], b["seq"], b["payload"]):
                s = Shard(blob)
                width = s.widths(s.seq)
                flat = s.expand(s.seq, width).astype("<u4", copy=False)
                edge = np.cumsum(width)[s.ends - 1] if len(s.ends) else np.zeros(0, np.int64)
                begin = np.concatenate([[0], edge[:-1]]) if len(edge) else edge
                raw = memoryview(flat).cast("B")
                yield {
                    "part": [part] * len(edge), "seq": [seq] * len(edge), "doc_id": s.doc_ids, "place": begin, "n_tokens": edge - begin,
                    "ids_crc32": [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), edge.tolist())],
                }

    return arrow_map(shards.select("part", "seq", "payload"), read, "part int, seq int, doc_id long, place long, n_tokens long, ids_crc32 long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each shard. Sums of parts (as many as shuffle partitions) give the first level."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("a")).join(before, "part").select("part", "seq", (F.col("a") + F.col("b")).alias("base"))


def op3_grammar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    shards = scratch.table("shards", write_shards(table(spark, sf_dir, "documents")))
    read = read_shards(shards).join(shard_starts(shards.select("part", "seq", "n_ids")), ["part", "seq"])
    return scratch.last(read.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"))
