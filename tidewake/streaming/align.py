"""Streaming forms: keyed two-point windows on a grid, and patterns carried from batch to batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.patterns import _link


def stream_delayed_interpolation(points: DataFrame, rate_min: int = 5, oid: str = "mmsi", delay: str = "1 hour", expire_s: int = 86_400) -> DataFrame:
    """(oid, grid_ts, lon, lat) of a stream of (oid, datetime, ts, lon, lat): each pair of consecutive points gives the value at the last grid instant
    before the second. State is the last point per object; it expires when the watermark is expire_s past it. Late points (older than the state) are passed over."""
    dt = 60 * rate_min

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable").drop_duplicates("ts")
        last = state.get if state.exists else None
        out = []
        for ts, lon, lat in zip(pdf["ts"].astype(int), pdf["lon"], pdf["lat"]):
            if last is not None and ts <= last[0]:
                continue
            if last is not None:
                g = (ts - 1) - (ts - 1) % dt
                if last[0] <= g:
                    f = (g - last[0]) / (ts - last[0])
                    out.append((key[0], g, last[1] + (lon - last[1]) * f, last[2] + (lat - last[2]) * f))
            last = (int(ts), float(lon), float(lat))
        state.update(last)
        state.setTimeoutTimestamp(max((last[0] + expire_s) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[oid, "grid_ts", "lon", "lat"])

    return points.withWatermark("datetime", delay).groupBy(oid).applyInPandasWithState(
        step, f"{oid} long, grid_ts long, lon double, lat double", "ts long, lon double, lat double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_extrapolation(points: DataFrame, rate_min: int = 5, limit: int = 3, oid: str = "mmsi", delay: str = "1 hour") -> DataFrame:
    """(oid, grid_ts, lon, lat): the line through an object's last two points, at up to `limit` grid instants until the next point. Instants are
    emitted when a later point or the watermark shows that no point comes before them."""
    dt = 60 * rate_min

    def grid(a, b, stop):
        g, n = -(-b[0] // dt) * dt, 0
        while n < limit and g < stop:
            f = (g - a[0]) / (b[0] - a[0])
            yield g, a[1] + (b[1] - a[1]) * f, a[2] + (b[2] - a[2]) * f
            g, n = g + dt, n + 1

    def step(key, batches, state: GroupState):
        a, b = None, None
        if state.exists:
            s = state.get
            a, b = ((s[0], s[1], s[2]) if s[0] is not None else None), (s[3], s[4], s[5])
        out = []
        if state.hasTimedOut:
            if a:
                out += [(key[0], *x) for x in grid(a, b, float("inf"))]
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values("ts", kind="stable").drop_duplicates("ts")
            for p in zip(pdf["ts"].astype(int).tolist(), pdf["lon"].tolist(), pdf["lat"].tolist()):
                if b and p[0] <= b[0]:
                    continue
                if a:
                    out += [(key[0], *x) for x in grid(a, b, p[0])]
                a, b = b, p
            state.update((a[0] if a else None, a[1] if a else None, a[2] if a else None, *b))
            state.setTimeoutTimestamp(max((b[0] + (limit + 1) * dt) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[oid, "grid_ts", "lon", "lat"])

    return points.withWatermark("datetime", delay).groupBy(oid).applyInPandasWithState(
        step, f"{oid} long, grid_ts long, lon double, lat double", "ats long, alon double, alat double, bts long, blon double, blat double", "append", GroupStateTimeout.EventTimeTimeout)


class IncrementalMiner:
    """Group patterns over micro-batches of (frame, clusters): active patterns are carried on. Use as foreachBatch target; frames must arrive in order."""

    def __init__(self, least: int, threshold_s: int):
        self.least, self.threshold_s = least, threshold_s
        self.active: dict = {}
        self.closed: list = []

    def resume(self, snapshot: DataFrame) -> None:
        """Takes up active and closed patterns (clusters, st, et, open) of an earlier run."""
        for r in snapshot.toLocalIterator():
            if r["open"]:
                self.active[frozenset(r["clusters"])] = (r["st"], r["et"])
            else:
                self.closed.append((sorted(r["clusters"]), r["st"], r["et"]))

    def state(self) -> list[tuple[list[int], int, int, bool]]:
        return [(*c, False) for c in self.closed] + [(sorted(c), s, e, True) for c, (s, e) in self.active.items()]

    def __call__(self, batch: DataFrame, epoch: int = 0) -> None:
        frames: dict[int, list] = {}
        for r in batch.orderBy("frame").toLocalIterator():  # clusters of one micro-batch, not points
            frames.setdefault(r["frame"], []).append(r["clusters"])
        for t in sorted(frames):
            present = {frozenset(c): (t, t) for c in frames[t] if len(c) >= self.least}
            linked = _link(present, self.active, self.least) if self.active else present
            self.closed += [(sorted(c), s, e) for c, (s, e) in self.active.items() if c not in linked and e - s >= self.threshold_s]
            self.active = linked

    def patterns(self) -> list[tuple[list[int], int, int]]:
        return self.closed + [(sorted(c), s, e) for c, (s, e) in self.active.items()]


def windowed_means(points: DataFrame, length: str = "10 minutes", slide: str = "5 minutes", delay: str = "1 hour", oid: str = "mmsi", value: str = "speed") -> DataFrame:
    """Sliding means per object with a watermark."""
    return points.withWatermark("datetime", delay).groupBy(F.window("datetime", length, slide), oid).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
