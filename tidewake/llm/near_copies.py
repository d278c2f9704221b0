"""Operator 7, near duplicates by SetSketch registers.

A document's set is its distinct 5-word shingles (after lower-casing A-Z; fewer words make one shingle). Equal sets (two fingerprints of 64 bits agree) fall
into one class, numbered when the classes are written. A class's sketch holds REGISTERS registers: the logarithm to a base near 1, rounded down, of the smallest
of the set's exponential hashes, so sketches of unions are maxima of registers. Bands of BAND registers make bucket keys (a pair at the threshold shares none
of the BANDS keys in 3 of 10 million cases).

Links are confirmed on the full shingle sets. First every class meets the smallest head of its buckets. Buckets that still hold two components form families
(connected by bucket heads). Inside a family, by pairs of blocks, sketches alone tell which classes have a partner in another component whose likelihood
estimate of the similarity (known set sizes) is not SLACK, five standard errors, below the threshold; the full sets of these go, by pairs of blocks again, to
confirm the links. A pair already in one component needs no test, only links that join components leave a task, and none of those is lost.

Null and empty texts (no words) have an empty set and link with nothing. Rows with a null id take no part: their component is null and they are kept.
Repeated rows share their class and their id; an id with several texts is in several classes, which it does not link. An empty table gives an empty result.
Further columns are ignored, or kept by keep_one_of_each().
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, hashes_of, mixed, table, window_hashes, words_of
from .graph import components

SHINGLE = 5
PERCENT = 75
BANDS, BAND = 40, 4
REGISTERS = BANDS * BAND
BASE = 1.001
SHIFT = 4000
SLACK = 0.17
FAMILY_BLOCK, BLOCK_MOST, BLOCK_SETS = 256, 4096, 16 << 20

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes_of(words)
    return np.unique(window_hashes(h, min(SHINGLE, len(h))))


def registers(s: np.ndarray) -> np.ndarray:
    """Sketch of a non-empty set: floor(-log_BASE(smallest exponential)), shifted, as 16-bit values."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    lo, hi = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(s), 2048):
        v = _A[:, None] * lo[None, i : i + 2048]
        v ^= _B[:, None] * hi[None, i : i + 2048]
        np.minimum(least, v.min(1), out=least)
    e = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32)
    return (np.floor(-np.log(e) / math.log(BASE)) + SHIFT).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of a union."""
    return np.maximum(a, b)


_AROUND = np.linspace(-0.2, 0.2, 41)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of a and b) of sets of sizes na and nb, to 0.01, looked for around the
    share of equal registers (six standard errors to either side)."""
    over, under = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - over - under
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = (np.minimum(na, nb) / np.maximum(na, nb))[:, None]
    j = np.clip((same / a.shape[1])[:, None] + _AROUND, 0, most)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    like = over[:, None] * np.log(np.maximum(up, tiny)) + under[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), like.argmax(1)]


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a non-empty set."""
    m = mixed(s)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(m)).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, f1, f2 (fingerprints of the set), regs (null for empty sets)."""

    def sketch(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "h": b["h"], **{k: [] for k in ("n_shingles", "f1", "f2", "regs")}}
            seen: dict[str, tuple] = {}
            for t in b["text"]:
                row = seen.get(t) if t else None
                if row is None:
                    s = shingle_set(t)
                    row = (len(s), *fingerprints(s), registers(s).tobytes()) if len(s) else (0, 0, 0, None)
                    if t:
                        seen[t] = row
                for k, x in zip(("n_shingles", "f1", "f2", "regs"), row):
                    out[k].append(x)
            yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text"), sketch, "doc_id long, h long, n_shingles long, f1 long, f2 long, regs binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, cid): a row per class and band. Four 16-bit registers are the 64 bits of a key, mixed with the band's number."""
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def keys(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b["regs"]), "<u8").reshape(-1, BANDS)
            yield {"key": mixed(x ^ salt).ravel().view(np.int64), "cid": np.repeat(np.array(b["cid"], np.int64), BANDS)}

    return arrow_map(classes.select("cid", "regs"), keys, "key long, cid long", piece=1 << 20)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    full = pairs.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")

    def test(batches):
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(batch["a"], batch["b"], batch["sa"], batch["sb"]):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                if 100 * min(len(p), len(q)) < PERCENT * max(len(p), len(q)):
                    continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= PERCENT * (len(p) + len(q) - both):
                    a.append(x)
                    b.append(y)
            yield {"a": a, "b": b}

    return arrow_map(full.select("a", "b", "sa", "sb"), test, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, s): the sorted shingle hashes of the wanted classes, made from the text of the class's smallest id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("cid", "f1", "f2", F.col("rep").alias("doc_id")), "doc_id").select("cid", "f1", "f2", "text")

    def make(batches):
        for b in batches:
            cids, out = [], []
            for c, f1, f2, t in zip(b["cid"], b["f1"], b["f2"], b["text"]):
                s = shingle_set(t)
                if len(s) and fingerprints(s) == (f1, f2):  # an id may be repeated with another text
                    cids.append(c)
                    out.append(s.astype("<u8").tobytes())
            yield {"cid": cids, "s": out}

    return arrow_map(texts, make, "cid long, s binary").dropDuplicates(["cid"])


def _common(x: list[np.ndarray], y: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of 0/1 matrices, some columns at a time."""
    every = np.unique(np.concatenate([*x, *y]))
    where = lambda sets: (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(every, np.concatenate(sets)))
    (rx, cx), (ry, cy) = where(x), where(y)
    out = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, len(every), columns):
        a, b = np.zeros((len(x), columns), np.float32), np.zeros((len(y), columns), np.float32)
        m = (cx >= c) & (cx < c + columns)
        a[rx[m], cx[m] - c] = 1
        m = (cy >= c) & (cy < c + columns)
        b[ry[m], cy[m] - c] = 1
        out += a @ b.T
    return out.astype(np.int64)


def _column(rows: list[tuple], i: int) -> np.ndarray:
    return np.array([r[i] for r in rows], np.int64)


def _near_pairs(x: list[tuple], y: list[tuple] | None, tile: int = 512):
    """Pairs (i, j) of two blocks, or inside one, of different labels whose estimate is near or over the threshold, and their shares of equal
    registers. Rows begin with cid, label, n, regs. Some rows of x are compared with some of y at a time."""
    same = y is None
    y = x if same else y
    regs = lambda rows: np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), -1)
    nx, ny, lx, ly, kx, ky = _column(x, 2), _column(y, 2), _column(x, 1), _column(y, 1), regs(x), regs(y)
    for s in range(0, len(x), tile):
        for t in range(0, s + tile if same else len(y), tile):
            a, b = slice(s, s + tile), slice(t, t + tile)
            open_ = (lx[a, None] != ly[None, b]) & (100 * np.minimum(nx[a, None], ny[None, b]) >= PERCENT * np.maximum(nx[a, None], ny[None, b]))
            if same and s == t:
                open_ &= np.tri(*open_.shape, k=-1, dtype=bool)
            i, j = np.nonzero(open_)
            i, j = i + s, j + t
            for c in range(0, len(i), 8192):
                p, q = i[c : c + 8192], j[c : c + 8192]
                alike = (kx[p] == ky[q]).sum(1) / REGISTERS
                near = np.flatnonzero(alike >= PERCENT / 100 - SLACK - 0.04)
                for d in range(0, len(near), 2048):
                    e = near[d : d + 2048]
                    good = e[estimate(kx[p[e]], ky[q[e]], nx[p[e]], ny[q[e]]) >= PERCENT / 100 - SLACK]
                    if len(good):
                        yield p[good], q[good], alike[good]


def nearby(x: list[tuple], y: list[tuple] | None) -> list[int]:
    """Classes of two blocks, or of one, that have a partner of another label near or over the threshold."""
    found: set[int] = set()
    cx, cy = _column(x, 0), _column(x if y is None else y, 0)
    for i, j, _ in _near_pairs(x, y):
        found.update(cx[i].tolist(), cy[j].tolist())
    return sorted(found)


def links_across(x: list[tuple], y: list[tuple] | None) -> list[tuple[int, int]]:
    """Links between classes of different labels, of two blocks or inside one: (cid, label, n, regs, set) each. Near pairs are confirmed on the full sets,
    tile by tile, the most alike first; a pair that earlier links of the call have joined is passed over."""
    z = x if y is None else y
    sx, sy = [np.frombuffer(r[4], "<u8") for r in x], [np.frombuffer(r[4], "<u8") for r in z]
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while v in parent:
            v = parent[v]
        return v

    out = []
    for i, j, alike in _near_pairs(x, y):
        open_ = np.array([find(x[p][1]) != find(z[q][1]) for p, q in zip(i.tolist(), j.tolist())])
        i, j, alike = i[open_], j[open_], alike[open_]
        if len(i) > 64:
            ui, uj = np.unique(i), np.unique(j)
            both = _common([sx[p] for p in ui], [sy[q] for q in uj])[np.searchsorted(ui, i), np.searchsorted(uj, j)]
        else:
            both = np.array([len(sx[p]) + len(sy[q]) - len(np.union1d(sx[p], sy[q])) for p, q in zip(i, j)], np.int64)
        linked = 100 * both >= PERCENT * (np.array([len(sx[p]) for p in i], np.int64) + np.array([len(sy[q]) for q in j], np.int64) - both)
        order = np.argsort(-alike, kind="stable")
        for p, q in zip(i[order][linked[order]].tolist(), j[order][linked[order]].tolist()):
            a, b = find(x[p][1]), find(z[q][1])
            if a != b:
                parent[b] = a
                out.append((x[p][0], z[q][0]))
    return out


def by_block_pairs(rows: DataFrame, columns: list[str], blocks, each, schema: str, partitions: int) -> DataFrame:
    """each(x, y) on the rows of every pair of blocks of a family (y is None inside one block); a family is cut into `blocks` (an aggregate) blocks by a hash,
    and every pair of blocks is a group of its own, so a family of any size is spread over many tasks. Only two blocks are held at a time."""
    sizes = rows.groupBy("family").agg(blocks.cast("int").alias("nb"))
    r = rows.join(sizes, "family").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    keys = ["family", "i", "j"]
    r = r.select(*keys, "b", *columns).repartition(partitions, *keys).sortWithinPartitions(*keys, "b", "cid")

    def run(batches):
        now, blocks = None, {}

        def close():
            if now is not None:
                x, y = blocks.get(now[1], []), None if now[1] == now[2] else blocks.get(now[2], [])
                if x and (y is None or y):
                    yield from each(x, y)

        for b in batches:
            for f, i, j, block, *row in zip(*(b[c] for c in (*keys, "b", *columns))):
                if (f, i, j) != now:
                    yield from close()
                    now, blocks = (f, i, j), {}
                blocks.setdefault(block, []).append(tuple(row))
        yield from close()

    return arrow_map(r, run, schema)


def family_links(members: DataFrame, classes: DataFrame, sets: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """(a, b): links between different labels of a family. members: family, cid, label. Sketches pick the classes whose sets are needed at all."""
    tell = members.join(classes.select("cid", "n", "regs"), "cid")
    n = F.count(F.lit(1))
    small = F.ceil(n / F.least(F.greatest(n / 64, F.lit(FAMILY_BLOCK)), F.lit(BLOCK_MOST)))
    near = by_block_pairs(tell, ["cid", "label", "n", "regs"], small, lambda x, y: [{"cid": nearby(x, y)}], "cid long", partitions)
    near = scratch.table("nearby", near.distinct())
    full = tell.join(near, "cid").join(sets, "cid")
    large = F.greatest(small, F.ceil(F.sum(F.octet_length("s")) / BLOCK_SETS))

    def links(x, y):
        got = links_across(x, y)
        yield {"a": [g[0] for g in got], "b": [g[1] for g in got]}

    return by_block_pairs(full, ["cid", "label", "n", "regs", "s"], large, links, "a long, b long", partitions)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, and h, a hash of its text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = scratch.table("base", sketches(docs))
    classes = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    classes = scratch.table("classes", classes.select(F.monotonically_increasing_id().alias("cid"), "*"))
    keys = scratch.table("keys", band_keys(classes))
    heads = keys.groupBy("key").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head")
    bucketed = scratch.table("bucketed", keys.join(heads, "key"))
    scratch.drop("keys")
    stars = scratch.table("stars", bucketed.filter("cid <> head").groupBy("cid").agg(F.min("head").alias("a")).select("a", F.col("cid").alias("b")))
    shared = bucketed.select("cid").distinct()
    sets = scratch.table("sets", full_sets(docs, shared.join(classes.drop("regs"), "cid")), codec="uncompressed")
    links = scratch.table("links1", confirmed(stars, sets))
    scratch.drop("stars")
    labels = scratch.table("labels1", components(links, scratch, "c1"))

    named = bucketed.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").select("key", "cid", "head", F.coalesce("label", "cid").alias("label"))
    named = scratch.table("named", named)
    open_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    rest = scratch.table("rest", named.join(open_keys, "key").select("cid", "head", "label").distinct())
    scratch.drop("bucketed", "named", "labels1")
    families = scratch.table("families", components(rest.select(F.col("head").alias("a"), F.col("cid").alias("b")), scratch, "cf"))
    members = scratch.table("members", families.select(F.col("node").alias("cid"), F.col("label").alias("family")).join(rest.select("cid", "label").distinct(), "cid"))
    links = scratch.table("links2", links.unionByName(family_links(members, classes, sets, scratch, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    labels = scratch.table("labels2", components(links, scratch, "c2"))
    scratch.drop("sets", "rest", "families", "members", "nearby", "links1", "links2")

    # The smallest id of a component, for every class that a row of its own does not tell it.
    lowest = labels.join(classes.select(F.col("cid").alias("node"), "f1", "f2", "rep"), "node")
    joined = lowest.join(lowest.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("f1", "f2", "component_id")
    alone = classes.filter("copies > 1").join(labels.select(F.col("node").alias("cid")), "cid", "left_anti").select("f1", "f2", F.col("rep").alias("component_id"))
    moved = scratch.table("moved", joined.unionByName(alone))
    scratch.drop("classes", "labels2")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = base.select("doc_id", "h", "n_shingles", *[F.when(takes_part, F.col(x)).alias(x) for x in ("f1", "f2")])
    out = rows.join(moved, ["f1", "f2"], "left").select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every group of linked documents the one with the smallest id stays; all columns stay. Rows go by id and text, so an id with
    several texts keeps those that are linked to no smaller id; of rows that repeat an id and its text one stays. Rows with a null id stay."""
    scratch = Scratch(spark, "keep")
    verdicts = scratch.table("verdicts", near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1"))
    same = (docs["doc_id"].cast("long") == F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_h"))
    out = docs.join(verdicts.filter("NOT kept"), same, "left_anti")
    again = verdicts.filter("kept")
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_setsketch_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
