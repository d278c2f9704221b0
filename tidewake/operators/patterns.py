"""Groups that move together: clusters per frame, links between frames, mining, chaining of partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import AIS, EARTH_KM, Spec
from .components import connected

CLUSTER = "frame long, clusters array<bigint>"
PATTERN = "clusters array<bigint>, st long, et long"
BATCH_MEMBERS = 1 << 19  # of the lists that a worker holds before it hands them on
WIDE = 2048  # nodes of a graph whose sets are bits over all nodes; of a larger one, over a node's neighbours
FOLD_TASKS = 64  # a task of few rows may take long: groups are to be in different ones


def _adjacency(pdf: pd.DataFrame) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {}
    for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def component_lists(near: dict[int, set[int]]) -> list[list[int]]:
    seen, out = set(), []
    for v in near:
        if v not in seen:
            group, todo = [], [v]
            seen.add(v)
            while todo:
                u = todo.pop()
                group.append(u)
                todo += [x for x in near[u] if x not in seen]
                seen |= near[u]
            out.append(sorted(group))
    return out


def maximal_cliques(near: dict[int, set[int]]) -> list[list[int]]:
    """All maximal cliques, depth first with pivots, on an explicit stack."""
    out: list[list[int]] = []
    stack = [([], set(near), set())]
    while stack:
        r, p, x = stack.pop()
        if not p:
            if not x and r:
                out.append(sorted(r))
            continue
        pivot = max(p | x, key=lambda u: len(p & near[u]))
        for v in list(p - near[pivot]):
            stack.append(([*r, v], p & near[v], x & near[v]))
            p.remove(v)
            x = x | {v}
    return out


def _cluster_rows(frame: int, got: list[list[int]]) -> pd.DataFrame:
    return pd.DataFrame({"frame": pd.Series([frame] * len(got), dtype="int64"), "clusters": pd.Series(got, dtype=object)})


def frame_clusters(pairs: DataFrame, mode: str = "convoys", least: int = 2) -> DataFrame:
    """(frame, clusters) with at least so many members: connected components (convoys) or maximal cliques (flocks) of each frame's pairs.
    Frames are independent; only a frame's edges are together in one task."""
    if mode in ("flocks", "f"):
        find = maximal_cliques
    elif mode in ("convoys", "c"):
        find = component_lists
    elif mode in ("swarms", "s"):
        raise NotImplementedError("swarms are not defined")
    else:
        raise ValueError(f"unknown mode {mode}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [c for c in find(_adjacency(pdf)) if len(c) >= least]
        return _cluster_rows(pdf["frame"].iloc[0], got)

    return pairs.select(F.col("frame").cast("long"), F.col("src").cast("long"), F.col("dst").cast("long")).groupBy("frame").applyInPandas(run, CLUSTER)


class Sets:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, v: int) -> int:
        up = self.up
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    def join(self, v: int, w: int) -> None:
        self.up[self.find(w)] = self.find(v)


def _metres(lon1, lat1, lon2, lat2):
    """haversine_m on arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    dy, dx = np.sin((p2 - p1) / 2), np.sin((np.radians(lon2) - np.radians(lon1)) / 2)
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, dy * dy + np.cos(p1) * np.cos(p2) * dx * dx))) * 1000.0


def _any_within(a: np.ndarray, b: np.ndarray, radius_m: float, block: int = 1 << 20) -> bool:
    """Whether a point of a is within the radius of one of b (rows of lon, lat), in blocks of pairs."""
    if len(a) < len(b):
        a, b = b, a
    for j in range(0, len(b), 1024):
        y = b[j : j + 1024]
        rows = max(1, block // len(y))
        for i in range(0, len(a), rows):
            x = a[i : i + rows, None]
            if (_metres(x[..., 0], x[..., 1], y[:, 0], y[:, 1]) < radius_m).any():
                return True
    return False


def point_components(objects, lon, lat, radius_m: float) -> list[list[int]]:
    """Components of two or more objects that are linked by distances below the radius, without a list of all pairs. Points of a cube whose diagonal is shorter than the
    radius belong together; two cubes at most two apart are compared as long as nothing else has joined them, by their first points and then by all."""
    fine = np.isfinite(lon) & np.isfinite(lat)
    at, position = np.unique(np.stack([lon[fine], lat[fine]], 1), axis=0, return_inverse=True)
    if not len(at) or not radius_m > 0:
        return []
    x, y = np.radians(at[:, 0]), np.radians(at[:, 1])
    side = 2 * np.sin(min(np.pi / 2, radius_m / (2000 * EARTH_KM))) / np.sqrt(3) * 0.999
    cube = np.floor((np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1) + 1) / side).astype(np.int64)
    cubes, cell = np.unique(cube, axis=0, return_inverse=True)
    cell = cell.ravel()
    order = np.argsort(cell, kind="stable")
    ends = np.searchsorted(cell[order], np.arange(len(cubes) + 1))
    first, size, sets = order[ends[:-1]], np.diff(ends), Sets(len(cubes))
    number = {c: i for i, c in enumerate(map(tuple, cubes.tolist()))}
    steps = sorted(((i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)), key=lambda s: sum(d * d for d in s))
    open_ = []
    for step in steps:
        met = [(i, number[c]) for i, c in enumerate(map(tuple, (cubes + step).tolist())) if c in number]
        a, b = np.array(met, np.int64).reshape(-1, 2).T
        near = _metres(at[first[a], 0], at[first[a], 1], at[first[b], 0], at[first[b], 1]) < radius_m
        for v, w in zip(a[near].tolist(), b[near].tolist()):
            sets.join(v, w)
        left = ~near & (size[a] * size[b] > 1)
        open_ += zip(a[left].tolist(), b[left].tolist())
    ids = np.asarray(objects)[fine]
    one, again = np.unique(ids, return_inverse=True)
    if len(one) < len(ids):  # an object at several places links them
        home = cell[position.ravel()]
        begin: dict[int, int] = {}
        for o, c in zip(again.tolist(), home.tolist()):
            sets.join(begin.setdefault(o, c), c)
    for v, w in open_:
        if sets.find(v) != sets.find(w) and _any_within(at[order[ends[v] : ends[v + 1]]], at[order[ends[w] : ends[w + 1]]], radius_m):
            sets.join(v, w)
    label = np.array([sets.find(c) for c in range(len(cubes))])[cell][position.ravel()]
    groups = pd.Series(ids).groupby(label).unique()
    return [sorted(g.tolist()) for g in groups if len(g) > 1]


def frame_components(points: DataFrame, radius_m: float, frame: str = "ts", least: int = 2, s: Spec = AIS) -> DataFrame:
    """(frame, clusters): what frame_clusters makes of the pairs strictly within the radius as convoys, but found on the points, as pairs grow with the square of a crowd.
    Frames are independent; only a frame's points are together in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [c for c in point_components(pdf["o"].to_numpy(), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), radius_m) if len(c) >= least]
        return _cluster_rows(pdf["frame"].iloc[0], got)

    p = points.select(F.col(frame).cast("long").alias("frame"), F.col(s.oid).cast("long").alias("o"), F.col(s.lon).cast("double").alias("x"), F.col(s.lat).cast("double").alias("y"))
    return p.dropna().groupBy("frame").applyInPandas(run, CLUSTER)


def _near_places(at: np.ndarray, radius_m: float) -> list[np.ndarray]:
    """For each of some distinct places (rows of lon, lat) the others strictly within the radius: looked for in the cubes around, a little longer than the radius reaches."""
    x, y = np.radians(at[:, 0]), np.radians(at[:, 1])
    side = 2 * np.sin(min(np.pi / 2, radius_m / (2000 * EARTH_KM))) * 1.001 + 1e-12
    cube = np.floor((np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], 1) + 1) / side).astype(np.int64)
    cubes, cell = np.unique(cube, axis=0, return_inverse=True)
    order = np.argsort(cell.ravel(), kind="stable")
    held = np.split(order, np.cumsum(np.bincount(cell.ravel(), minlength=len(cubes)))[:-1])
    number = {c: i for i, c in enumerate(map(tuple, cubes.tolist()))}
    near: list = [None] * len(at)
    for c, i in number.items():
        around = [number.get((c[0] + a, c[1] + b, c[2] + d)) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)]
        others = np.concatenate([held[j] for j in around if j is not None])
        for begin in range(0, len(held[i]), max(1, (1 << 20) // len(others))):
            own = held[i][begin : begin + max(1, (1 << 20) // len(others))]
            met = _metres(at[own, 0, None], at[own, 1, None], at[others, 0], at[others, 1]) < radius_m
            for v, row in zip(own.tolist(), met):
                w = others[row]
                near[v] = w[w != v]
    return near


def clique_lists(near: list[set[int]]) -> Iterator[list[int]]:
    """All maximal cliques of the graph of some neighbours, single nodes without neighbours included, one after another. Each is found at its first node by degree, in that
    node's neighbourhood, where sets are bits of integers; depth first with pivots."""
    ranked = sorted(range(len(near)), key=lambda v: len(near[v]))
    turn = {v: i for i, v in enumerate(ranked)}
    among = lambda nodes, local: (lambda bit: [sum(bit[w] for w in near[u] & nodes) for u in local])({u: 1 << i for i, u in enumerate(local)})
    if len(near) <= WIDE:
        local, links = ranked, among(turn.keys(), ranked)
    for v in ranked:
        if len(near) <= WIDE:
            held, first = links[turn[v]], turn[v]
        else:
            local = sorted(near[v], key=turn.__getitem__)
            links, held, first = among(near[v], local), (1 << len(local)) - 1, sum(turn[u] < turn[v] for u in local)
        past = held & ((1 << first) - 1)
        stack = [((v,), held ^ past, past)]
        while stack:
            r, p, x = stack.pop()
            if not p:
                if not x:
                    yield sorted(r)
                continue
            most, left, pivot = -1, p | x, 0
            while left:
                i = left.bit_length() - 1
                left ^= 1 << i
                if (k := (p & links[i]).bit_count()) > most:
                    most, pivot = k, i
            left = p & ~links[pivot]
            while left:
                i = left.bit_length() - 1
                b = 1 << i
                left ^= b
                stack.append(((*r, local[i]), p & links[i], x & links[i]))
                p ^= b
                x |= b


def point_cliques(objects, lon, lat, radius_m: float) -> Iterator[np.ndarray]:
    """Maximal sets of objects of which any two are linked by a distance below the radius, single ones included, one after another. Objects of equal places are in the same
    cliques, so cliques are found on places and their objects follow."""
    fine = np.isfinite(lon) & np.isfinite(lat)
    if not fine.any() or not radius_m > 0:
        return
    at, position = np.unique(np.stack([lon[fine], lat[fine]], 1), axis=0, return_inverse=True)
    where: dict[int, set] = {}
    for o, i in zip(np.asarray(objects)[fine].tolist(), position.ravel().tolist()):
        where.setdefault(o, set()).add(i)
    alike: dict[tuple, list] = {}
    for o, places in where.items():
        alike.setdefault(tuple(sorted(places)), []).append(o)
    places_of = list(alike)
    members = [np.array(o, np.int64) for o in alike.values()]
    here: list[list[int]] = [[] for _ in at]
    for k, places in enumerate(places_of):
        for i in places:
            here[i].append(k)
    around, left = _near_places(at, radius_m), np.ones(len(at), bool)
    for first in range(len(at)):
        if not left[first]:
            continue
        left[first], linked = False, [first]  # places that are linked with the first one, directly or by way of others: sets of neighbours are made for these only
        for i in linked:
            more = np.concatenate([around[i], *(places_of[k] for k in here[i] if len(places_of[k]) > 1)]).astype(np.int64)
            more = np.unique(more[left[more]])
            left[more] = False
            linked += more.tolist()
        number = {k: n for n, k in enumerate(sorted({k for i in linked for k in here[i]}))}
        reach = {i: {number[k] for j in (i, *around[i].tolist()) for k in here[j]} for i in linked}
        nodes = list(number)
        near = [set().union(*(reach[i] for i in places_of[k])) - {n} for k, n in number.items()]
        for c in clique_lists(near):
            yield np.sort(np.concatenate([members[nodes[n]] for n in c]))


def _in_batches(lists: Iterable[np.ndarray], most: int = BATCH_MEMBERS) -> Iterator[pa.Array]:
    """Arrow arrays of the lists, each of not many more members than `most`."""
    held: list[np.ndarray] = []
    members = 0
    for x in lists:
        held.append(x)
        members += len(x)
        if members >= most:
            yield _lists(held)
            held, members = [], 0
    if held:
        yield _lists(held)


def _lists(held: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held), pa.int64()))


def frame_cliques(points: DataFrame, radius_m: float, frame: str = "ts", least: int = 2, s: Spec = AIS) -> DataFrame:
    """(frame, clusters): what frame_clusters makes of the pairs strictly within the radius as flocks, but found on the points. Frames are independent; only a frame's
    points are together in one task, and cliques leave it in batches as they are found: there may be very many more than points."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        got = point_cliques(*(t[c].to_numpy() for c in ("o", "x", "y")), radius_m)
        for x in _in_batches(c for c in got if len(c) >= max(2, least)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key[0].as_py(), np.int64)), x], names=["frame", "clusters"])

    return _placed(points, frame, s).groupBy("frame").applyInArrow(run, CLUSTER)


def _placed(points: DataFrame, frame: str, s: Spec) -> DataFrame:
    return points.select(F.col(frame).cast("long").alias("frame"), F.col(s.oid).cast("long").alias("o"), F.col(s.lon).cast("double").alias("x"), F.col(s.lat).cast("double").alias("y")).dropna()


def companions(points: DataFrame, frame: str = "ts", s: Spec = AIS) -> DataFrame:
    """(object, members): objects that are at the same places in all frames, under the smallest of them. They are in the same clusters everywhere."""
    p = points.select(F.col(s.oid).cast("long").alias("o"), F.struct(F.col(frame).cast("long").alias("t"), F.col(s.lon).cast("double").alias("x"), F.col(s.lat).cast("double").alias("y")).alias("p"))
    track = p.groupBy("o").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("p"))), 256).alias("track"))
    return track.filter("o IS NOT NULL").groupBy("track").agg(F.array_sort(F.collect_list("o")).alias("members")).select(F.element_at("members", 1).alias("object"), "members")


def numbered(clusters: DataFrame) -> DataFrame:
    """st and et of single frames."""
    return clusters.select("clusters", F.col("frame").alias("st"), F.col("frame").alias("et"))


def translate(positions: DataFrame, rows: DataFrame) -> DataFrame:
    """Clusters of row positions (frame, cluster, positions) as sorted lists of ids; rows: frame, pos, id."""
    p = positions.select("frame", "cluster", F.explode("positions").alias("pos"))
    return p.join(rows, ["frame", "pos"]).groupBy("frame", "cluster").agg(F.array_sort(F.collect_list("id")).alias("clusters"))


def merge_equal(p: DataFrame, on: list[str] = ()) -> DataFrame:
    return p.groupBy(*on, "clusters").agg(F.min("st").alias("st"), F.max("et").alias("et"))


def _keyed(p: DataFrame) -> DataFrame:
    """Adds _p, a digest of clusters, st and et, that stands for a pattern where its list of members would travel with every member."""
    return p.withColumn("_p", F.unhex(F.sha2(F.to_json(F.struct("clusters", "st", "et")), 256)))


def shared_members(present: DataFrame, past: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of patterns that share a member, with the shared members: an equi-join on members, grouped. Members carry digests of their patterns; the lists join the pairs."""
    present, past = (_keyed(p.select(*on, "clusters", "st", "et")) for p in (present, past))
    b = present.select(*on, F.col("_p").alias("_b"), F.explode("clusters").alias("_m"))
    a = past.select(*on, F.col("_p").alias("_a"), F.explode("clusters").alias("_m"))
    met = a.join(b, [*on, "_m"]).groupBy(*on, "_a", "_b").agg(F.array_sort(F.collect_list("_m")).alias("common"))
    named = lambda p, x: p.dropDuplicates([*on, "_p"]).select(*on, F.col("_p").alias(f"_{x}"), F.col("clusters").alias(x), F.col("st").alias(f"{x}st"), F.col("et").alias(f"{x}et"))
    return met.join(named(past, "a"), [*on, "_a"]).join(named(present, "b"), [*on, "_b"]).select(*on, "a", "ast", "aet", "b", "bst", "bet", "common")


def intersection_links(present: DataFrame, past: DataFrame, least: int, on: list[str] = ()) -> DataFrame:
    """The next active patterns: every intersection of at least `least` members (start of the past, end of the present), and each present pattern
    that is no such intersection; equal sets are merged. `on` names columns that keep independent frames apart."""
    on = list(on)
    s = shared_members(present, past, on).filter(F.size("common") >= least)
    kept = s.select(*on, F.col("common").alias("clusters"), F.col("ast").alias("st"), F.col("bet").alias("et"))
    whole = s.filter(F.size("common") == F.size("b")).select(*on, F.col("b").alias("clusters")).distinct()
    fresh = present.select(*on, "clusters", "st", "et").join(whole, [*on, "clusters"], "left_anti")
    return kept.unionByName(fresh).groupBy(*on, "clusters").agg(F.min("st").alias("st"), F.max("et").alias("et"))


def subset_of_past(present: DataFrame, past: DataFrame, on: list[str] = ()) -> DataFrame:
    """Present patterns; those inside a past one inherit the earliest start."""
    on = list(on)
    s = shared_members(present, past, on).filter(F.size("common") == F.size("b")).groupBy(*on, F.col("b").alias("clusters")).agg(F.min("ast").alias("_s"))
    return present.join(s, [*on, "clusters"], "left").withColumn("st", F.least("st", F.coalesce("_s", "st"))).drop("_s")


def past_inside_present(present: DataFrame, past: DataFrame, on: list[str] = ()) -> DataFrame:
    """Past patterns strictly inside a present one live on to its end; those equal to a present one go."""
    on = list(on)
    s = shared_members(present, past, on).filter((F.size("common") == F.size("a")) & (F.size("b") > F.size("a"))).groupBy(*on, F.col("a").alias("clusters")).agg(F.max("bet").alias("_e"))
    out = past.join(s, [*on, "clusters"], "left").withColumn("et", F.coalesce("_e", "et")).drop("_e")
    return out.join(present.select(*on, "clusters").distinct(), [*on, "clusters"], "left_anti")


def _link(present: dict, past: dict, least: int) -> dict:
    """present, past: frozenset -> (st, et). The same rule as intersection_links, inside one fold."""
    by: dict[int, list] = {}
    for a, t in past.items():
        for m in a:
            by.setdefault(m, []).append((a, t))
    out: dict = {}

    def put(c, st, et):
        old = out.get(c)
        out[c] = (min(st, old[0]), max(et, old[1])) if old else (st, et)

    for b, (bst, bet) in present.items():
        whole = False
        near = {a: t for m in b for a, t in by.get(m, ())}
        for a, t in near.items():
            common = a & b
            if len(common) >= least:
                put(common, t[0], bet)
                whole |= len(common) == len(b)
        if not whole:
            put(b, bst, bet)
    return out


def fold(frames: list[tuple[int, int, list]], least: int, threshold_s: int, last: int, keep_start: int | None = None) -> list[tuple[list[int], int, int]]:
    """Patterns of consecutive frames: (number, time, clusters). Open ones end at frame number `last`; closed ones need the duration, or to start at keep_start."""
    active: dict = {}
    out, before = [], None

    def close(gone):
        out.extend((sorted(c), s, e) for c, (s, e) in gone if e - s >= threshold_s or s == keep_start)

    for number, t, clusters in frames:
        present = {frozenset(c): (t, t) for c in clusters}
        if before is not None and number != before + 1:
            close(active.items())
            active = {}
        linked = _link(present, active, least) if active else present
        close((c, x) for c, x in active.items() if c not in linked)
        active, before = linked, number
    if before is not None and before != last:
        close(active.items())
        active = {}
    out.extend((sorted(c), s, e) for c, (s, e) in active.items())
    return out


def meeting_groups(clusters: DataFrame) -> DataFrame:
    """(object, grp): objects that are in one cluster in some frame, directly or by way of others."""
    edges = clusters.select(F.element_at("clusters", 1).alias("a"), F.explode("clusters").alias("b")).distinct()
    return connected(edges).select(F.col("node").alias("object"), F.col("label").alias("grp"))


def mine(clusters: DataFrame, frames: DataFrame, least: int = 2, threshold_s: int = 1800, groups: DataFrame | None = None) -> DataFrame:
    """Group patterns (clusters, st, et) by the intersection rule. frames: all frame times; consecutive means the next time present in the data.
    groups (object, grp) splits the work into objects that never meet, each folded by itself; without it they are the components of all frames' clusters.
    Where most objects meet in the end, mine_partition() and reduce_partitions() split by time instead."""
    groups = meeting_groups(clusters) if groups is None else groups
    c = clusters.join(_in_turn(frames), "frame")
    c = c.withColumn("_o", F.element_at("clusters", 1)).join(groups.select(F.col("object").alias("_o"), "grp"), "_o").drop("_o")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fold([(int(i), int(t), [list(map(int, x)) for x in g["clusters"]]) for (i, t), g in pdf.sort_values("_i").groupby(["_i", "frame"])], least, threshold_s, int(pdf["_top"].iloc[0]))
        return pd.DataFrame(got, columns=["clusters", "st", "et"])

    return c.groupBy("grp").applyInPandas(run, PATTERN)


def _in_turn(frames: DataFrame) -> DataFrame:
    """(frame, _i, _top): frame times, their numbers from 1, and the last number."""
    order = frames.select("frame").distinct().withColumn("_i", F.row_number().over(Window.orderBy("frame")).cast("long"))  # a row per frame time
    return order.crossJoin(F.broadcast(order.agg(F.max("_i").alias("_top"))))  # one row


def _packed(sets: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as bits of 64-bit words."""
    out = np.zeros((len(sets), max(1, -(-sets.shape[1] // 64)) * 8), np.uint8)
    bits = np.packbits(sets, axis=1, bitorder="little")
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def _unpacked(rows: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(rows.view(np.uint8), axis=1, count=n, bitorder="little")


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, and where each run of them begins: by one mixed number a row, and by all words where two rows share a number."""
    mixed = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, j]
    order = np.argsort(mixed)
    for again in (False, True):
        r, m = rows[order], mixed[order]
        new = (r[1:] != r[:-1]).any(axis=1)
        if again or not (new & (m[1:] == m[:-1])).any():
            return order, np.flatnonzero(np.concatenate([[True], new]))
        order = np.lexsort(rows.T)


def _distinct(rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, with the least start of each."""
    if not len(rows):
        return rows, start
    order, first = _runs(rows)
    return rows[order[first]], np.minimum.reduceat(start[order], first)


def _contained(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which rows are among some others."""
    order, first = _runs(np.concatenate([of, rows]))
    label = np.empty(len(order), np.int64)
    label[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    there = np.zeros(len(first), bool)
    there[label[: len(of)]] = True
    return there[label[len(of) :]]


def fold_sets(frames: Iterable[tuple[int, int, list[np.ndarray]]], weight: np.ndarray, least: int, threshold_s: int, last: int, block: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The patterns of fold() for clusters that overlap much, as sets of small numbers below len(weight), which tells how many objects a number stands for. Sets are rows of bits over
    the members of a frame; what is active is first cut to a frame's members, where many sets become equal; products of matrices tell which pairs share enough, and
    only these are intersected. Yields (members, rows of bits over them, starts, end)."""
    kind = np.float32 if weight.sum() < 1 << 24 else np.float64  # sums of weights are exact
    own, rows, start, before, end = np.zeros(0, np.int64), np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), None, 0
    for number, t, clusters in frames:
        if before is not None and number != before + 1:
            long = end - start >= threshold_s
            yield own, rows[long], start[long], end
            rows, start = rows[:0], start[:0]
        flat = np.concatenate(clusters)
        members = np.unique(flat)
        present = np.zeros((len(clusters), len(members)), np.uint8)
        present[np.repeat(np.arange(len(clusters)), list(map(len, clusters))), np.searchsorted(members, flat)] = 1
        bits, many = _packed(present), weight[members].astype(kind)
        if not len(rows):
            linked, since = _distinct(bits, np.full(len(bits), t, np.int64))
        else:
            _, here, there = np.intersect1d(members, own, assume_unique=True, return_indices=True)
            past = _unpacked(rows, len(own))
            cut = np.zeros((len(rows), len(members)), np.uint8)
            cut[:, here] = past[:, there]
            inside, cut = cut.sum(axis=1, dtype=np.int64) == past.sum(axis=1, dtype=np.int64), _packed(cut)
            a, began = _distinct(cut, start)
            weighed = _unpacked(a, len(members)) * many
            enough = weighed.sum(axis=1) >= least
            a, began, weighed = a[enough], began[enough], weighed[enough]
            other, size, whole = present.T.astype(kind), present @ many, np.zeros(len(clusters), bool)
            found = []
            for i in range(0, len(a), max(1, block // len(clusters))):
                shared = weighed[i : i + max(1, block // len(clusters))] @ other
                whole |= (shared == size).any(axis=0)
                v, w = np.nonzero(shared >= least)
                found.append(_distinct(a[i + v] & bits[w], began[i + v]))
            found.append((bits[~whole], np.full((~whole).sum(), t, np.int64)))
            linked, since = _distinct(*map(np.concatenate, zip(*found)))
            gone = np.ones(len(rows), bool)
            gone[inside] = ~_contained(cut[inside], linked)
            gone &= end - start >= threshold_s
            yield own, rows[gone], start[gone], end
        own, rows, start, before, end = members, linked, since, number, t
    if before is not None:
        open_ = np.full(len(rows), before == last) | (end - start >= threshold_s)
        yield own, rows[open_], start[open_], end


def _members_of(named: list[np.ndarray], own: np.ndarray, rows: np.ndarray, most: int = BATCH_MEMBERS) -> Iterator[tuple[slice, pa.Array]]:
    """Sorted lists of the objects that rows of bits stand for, in parts of about so many objects. named: the objects of each number."""
    ends = np.cumsum([0, *map(len, named)])
    flat, per = np.concatenate(named), np.diff(ends)
    upto = np.concatenate([np.cumsum(_unpacked(rows[i : i + 65_536], len(own)) @ per[own]) for i in range(0, len(rows), 65_536)]) if len(rows) else np.zeros(0, np.int64)
    for i in range(65_536, len(rows), 65_536):
        upto[i : i + 65_536] += upto[i - 1]
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        row, number = np.nonzero(_unpacked(rows[i:j], len(own)))
        number = own[number]
        row, left = np.repeat(row, per[number]), np.repeat(ends[number] - np.concatenate([[0], np.cumsum(per[number])[:-1]]), per[number])
        objects = flat[left + np.arange(len(row))]
        objects = objects[np.lexsort((objects, row))]
        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))]).astype(np.int32)
        yield slice(i, j), pa.ListArray.from_arrays(pa.array(at), pa.array(objects, pa.int64()))
        i = j


def mine_flocks(points: DataFrame, radius_m: float, members: DataFrame, frame: str = "ts", least: int = 2, threshold_s: int = 1800, s: Spec = AIS) -> DataFrame:
    """mine() on the cliques of points within the radius; all frame times are those of the points. members (object, members), of companions(): objects at the same places in all
    frames are mined as one that counts as all. Cliques are found where they are folded, in the task of a group of objects that never meet others, and are not kept."""
    p = _placed(points, frame, s).join(members.select(F.col("object").alias("o")), "o", "left_semi")
    groups = meeting_groups(frame_components(p.withColumnsRenamed({"o": s.oid, "x": s.lon, "y": s.lat}), radius_m, "frame", s=s))
    group = F.coalesce("grp", "o").alias("grp")  # an object that meets only its companions is a group
    p = p.join(_in_turn(points.select(F.col(frame).cast("long").alias("frame"))), "frame").withColumn("members", F.lit(None).cast("array<bigint>"))
    p = p.unionByName(members.select(F.col("object").alias("o"), "members"), allowMissingColumns=True)
    p = p.join(groups.withColumnRenamed("object", "o"), "o", "left").select(group, "_i", "_top", "frame", "o", "x", "y", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pa.Table.from_batches(batches).to_pandas()
        names = d[d["members"].notna()].sort_values("o")
        objects, named, d = names["o"].to_numpy(np.int64), names["members"].tolist(), d[d["members"].isna()]
        weight = np.array(list(map(len, named)))

        def frames() -> Iterator[tuple[int, int, list[np.ndarray]]]:
            for (i, t), g in d.groupby(["_i", "frame"]):
                got = point_cliques(np.searchsorted(objects, g["o"].to_numpy(np.int64)), g["x"].to_numpy(float), g["y"].to_numpy(float), radius_m)
                if got := [c for c in got if weight[c].sum() >= max(2, least)]:
                    yield int(i), int(t), got

        for own, rows, start, end in fold_sets(frames(), weight, least, threshold_s, int(d["_top"].iloc[0]) if len(d) else 0):
            for part, lists in _members_of(named, own, rows):
                yield pa.RecordBatch.from_arrays([lists, pa.array(start[part]), pa.array(np.full(len(lists), end, np.int64))], names=["clusters", "st", "et"])

    return p.repartition(FOLD_TASKS, "grp").groupBy("grp").applyInArrow(run, PATTERN)


def mine_partition(clusters: DataFrame, bins: DataFrame, least: int, threshold_s: int) -> DataFrame:
    """Map side: mines every time range by itself and keeps what touches its start, for chaining. bins: (frame, bin)."""
    order = bins.withColumn("_i", F.row_number().over(Window.partitionBy("bin").orderBy("frame")).cast("long"))
    ends = order.groupBy("bin").agg(F.max("_i").alias("_top"), F.min("frame").alias("_lo"))
    c = clusters.join(order, "frame").join(ends, "bin")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf["_lo"].iloc[0])
        got = fold([(int(i), int(t), [list(map(int, x)) for x in g["clusters"]]) for (i, t), g in pdf.sort_values("_i").groupby(["_i", "frame"])], least, threshold_s, int(pdf["_top"].iloc[0]), lo)
        return pd.DataFrame(got, columns=["clusters", "st", "et"]).assign(bin=int(pdf["bin"].iloc[0]))

    return c.groupBy("bin").applyInPandas(run, PATTERN + ", bin long")


def merge_partitions(a: list, b: list, least: int) -> list:
    """Two neighbours: a's patterns that reach its end are linked with b's that begin at its start; all others pass."""
    if not a or not b:
        return [*a, *b]
    end, start = max(p[2] for p in a), min(p[1] for p in b)
    past = {frozenset(p[0]): (p[1], p[2]) for p in a if p[2] == end}
    present = {frozenset(p[0]): (p[1], p[2]) for p in b if p[1] == start}
    linked = _link(present, past, least)
    out = [p for p in a if p[2] != end] + [p for p in b if p[1] != start]
    out += [(sorted(c), *t) for c, t in past.items() if c not in linked]
    return out + [(sorted(c), *t) for c, t in linked.items()]


def reduce_partitions(parts: DataFrame, least: int, step_s: int, threshold_s: int, max_ts: int | None = None) -> DataFrame:
    """Chains partitions in time order where the gap is exactly one step, then keeps open, first, or long patterns. The patterns (not the points) meet in one fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {k: [([int(x) for x in c], int(s), int(e)) for c, s, e in zip(g["clusters"], g["st"], g["et"])] for k, g in pdf.groupby("bin")}
        done: list = []
        for part in sorted(rows.values(), key=lambda r: min(p[1] for p in r)):
            chained = done and min(p[1] for p in part) - max(p[2] for p in done) == step_s
            done = merge_partitions(done, part, least) if chained else done + part
        top, low = max_ts if max_ts is not None else max(p[2] for p in done), min(p[1] for p in done)
        return pd.DataFrame([p for p in done if p[2] == top or p[1] == low or p[2] - p[1] >= threshold_s], columns=["clusters", "st", "et"])

    return parts.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, PATTERN)


def mine_by_containment(clusters: DataFrame, least: int, threshold_s: int) -> DataFrame:
    """The older rule: only containment links patterns, intersections make none. Consecutive frames are those that hold clusters. Objects that never
    meet are folded apart."""
    order = clusters.select("frame").distinct().withColumn("_i", F.row_number().over(Window.orderBy("frame")).cast("long"))  # a row per frame time
    order = order.crossJoin(F.broadcast(order.agg(F.max("frame").alias("_end"))))  # one row
    order = order.withColumn("_prev", F.lag("frame").over(Window.orderBy("frame")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        closed: list = []

        def close(open_):
            closed.extend((sorted(a), s, e) for a, (s, e) in open_ if e - s >= threshold_s and len(a) >= least)

        for (_, t, prev), g in pdf.sort_values("_i").groupby(["_i", "frame", "_prev"], dropna=False):
            t = int(t)
            present = {frozenset(map(int, c)): t for c in g["clusters"]}
            open_ = {c: s for c, (s, e) in known.items() if e == prev}
            close((c, x) for c, x in known.items() if x[1] != prev)
            new = {}
            for b, st in present.items():
                new[b] = (min([st, *(s for a, s in open_.items() if b <= a)]), t)
            for a, s in open_.items():
                if a not in present:
                    if any(a < b for b in present):
                        new[a] = (s, t)
                    else:
                        close([(a, (s, int(prev)))])
            known = new
        end = int(pdf["_end"].iloc[0])
        close((c, x) for c, x in known.items() if x[1] != end)
        out = closed + [(sorted(c), s, e) for c, (s, e) in known.items() if e == end and len(c) >= least]
        return pd.DataFrame(out, columns=["clusters", "st", "et"])

    c = clusters.join(order, "frame").withColumn("_o", F.element_at("clusters", 1)).join(meeting_groups(clusters).withColumnRenamed("object", "_o"), "_o").drop("_o")
    return c.groupBy("grp").applyInPandas(run, PATTERN)


def merge_by_containment(a: list, b: list, threshold_s: int) -> list:
    """Two neighbours by the older rule: b's first patterns inherit the start of a's last ones that hold them, a's last ones inside a larger one of b live on; what was
    linked stays only if long enough."""
    end, start = max(p[2] for p in a), min(p[1] for p in b)
    past, now = [p for p in a if p[2] == end], [p for p in b if p[1] == start]
    linked = []
    for c, st, et in now:
        linked.append((c, min([st, *(s for x, s, _ in past if set(c) <= set(x))]), et))
    sets = {frozenset(c) for c, _, _ in now}
    for c, st, et in past:
        if frozenset(c) not in sets:
            linked.append((c, st, max([et, *(e for x, _, e in now if set(c) < set(x))])))
    return [p for p in a if p[2] != end] + [p for p in b if p[1] != start] + [p for p in linked if p[2] - p[1] >= threshold_s]


def reduce_by_containment(parts: DataFrame, step_s: int, threshold_s: int) -> DataFrame:
    """Starts at the partition that ends first and takes, again and again, the one that begins next at or after the end so far; merges where the gap is one step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [[([int(x) for x in c], int(s), int(e)) for c, s, e in zip(g["clusters"], g["st"], g["et"])] for _, g in pdf.groupby("bin")]
        left.sort(key=lambda part: max(p[2] for p in part))
        done = left.pop(0)
        while left:
            if not done:  # nothing of a merge was long enough
                done = left.pop(0)
                continue
            end = max(p[2] for p in done)
            gaps = [min(p[1] for p in part) - end for part in left]
            after = [g for g in gaps if g >= 0]
            i = gaps.index(min(after)) if after else 0
            part = left.pop(i)
            done = merge_by_containment(done, part, threshold_s) if gaps[i] == step_s else done + part
        return pd.DataFrame(done, columns=["clusters", "st", "et"])

    return parts.withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, PATTERN)


def pattern_velocity(patterns: DataFrame, points: DataFrame, oid: str = "mmsi", ts: str = "ts", velocity: str = "velocity") -> DataFrame:
    """Mean velocity of a pattern's members between its start and end: members are exploded into an equi-join on the object and carry the pattern's digest only."""
    p = _keyed(patterns)
    m = p.select("_p", "st", "et", F.explode("clusters").alias("_o"))
    j = m.join(points.select(F.col(oid).alias("_o"), F.col(ts).alias("_t"), F.col(velocity).alias("_v")), "_o").filter("_t >= st AND _t <= et")
    means = j.groupBy("_p").agg(F.avg("_v").alias("mean_velocity"), F.count(F.lit(1)).alias("n_points"))
    return p.select("_p", "clusters", "st", "et").dropDuplicates(["_p"]).join(means, "_p").select("clusters", "st", "et", "mean_velocity", "n_points")


def long_enough(patterns: DataFrame, minutes: int) -> DataFrame:
    return patterns.filter(F.col("et") - F.col("st") >= 60 * minutes)


def split_open(patterns: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    return patterns.filter(F.col("et") == last), patterns.filter(F.col("et") != last)
