"""Column builders: geodesy, curves and arrays. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import EARTH_KM, NM_PER_KM


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def portable(x: Column, scale: float = 1e6) -> Column:
    """Rounds half up by floor, the same on every engine."""
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def haversine_km(lon1, lat1, lon2, lat2, legacy_axes: bool = False) -> Column:
    """Great-circle distance. legacy_axes: longitude and latitude change places."""
    if legacy_axes:
        lon1, lat1, lon2, lat2 = lat1, lon1, lat2, lon2
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dy, dx = F.sin((p2 - p1) / 2), F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), dy * dy + F.cos(p1) * F.cos(p2) * dx * dx)))


def haversine_m(lon1, lat1, lon2, lat2, legacy_axes: bool = False) -> Column:
    return haversine_km(lon1, lat1, lon2, lat2, legacy_axes) * F.lit(1000.0)


def bearing_deg(lon1, lat1, lon2, lat2, legacy_units: bool = False) -> Column:
    """Initial bearing from 0 to 360. legacy_units: degrees go into the trigonometric functions as they are."""
    rad = (lambda c: col(c)) if legacy_units else (lambda c: F.radians(col(c)))
    p1, p2, d = rad(lat1), rad(lat2), rad(lon2) - rad(lon1)
    x = F.sin(d) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(x, y)) + F.lit(360.0), F.lit(360.0))


def mercator_x(lon) -> Column:
    return F.lit(6378137.0) * F.radians(col(lon))


def mercator_y(lat) -> Column:
    return F.lit(6378137.0) * F.ln(F.tan(F.lit(0.7853981633974483) + F.radians(col(lat)) / 2))


def hybrid_distance(lon1, lat1, lon2, lat2, a: Column, b: Column) -> Column:
    """Nautical miles plus the Euclidean norm of the other features (arrays)."""
    return haversine_km(lon1, lat1, lon2, lat2) * F.lit(NM_PER_KM) + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def grid_floor(x, base: int) -> Column:
    """Largest multiple of base that is not above x."""
    return col(x) - F.pmod(col(x), F.lit(base))


def greyscale(r, g, b) -> Column:
    return F.lit(0.2989) * col(r) + F.lit(0.587) * col(g) + F.lit(0.114) * col(b)


def quantize(pixels, q: int) -> Column:
    """Pixels (array) rounded half to even onto steps of q."""
    return F.transform(col(pixels), lambda x: F.bround(F.bround(x / F.lit(float(q)), 2) * F.lit(float(q)), 2))


def sad(a, b) -> Column:
    """Sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def rle_encode(values) -> Column:
    """Runs of an array as "symbol!count" strings, inside one row."""
    empty = F.array().cast("array<struct<symbol:double,count:int>>")
    grown = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["symbol"] == x),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(x.alias("symbol"), (F.element_at(acc, -1)["count"] + 1).alias("count")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x.alias("symbol"), F.lit(1).alias("count")))))
    runs = F.aggregate(col(values), empty, grown)
    return F.transform(runs, lambda r: F.concat(r["symbol"].cast("string"), F.lit("!"), r["count"].cast("string")))


def rle_decode(tokens) -> Column:
    return F.flatten(F.transform(col(tokens), lambda t: F.array_repeat(F.split(t, "!")[0].cast("double"), F.split(t, "!")[1].cast("int"))))


def heading_line(lon, lat, heading) -> tuple[Column, Column]:
    """(slope, intercept) of the line through a point along its heading, to 2 decimals; infinite where vertical."""
    s, c = F.bround(F.sin(F.radians(col(heading))), 7), F.bround(F.cos(F.radians(col(heading))), 7)
    up = F.lit(float("inf"))
    return F.when(c == 0, up).otherwise(F.bround(F.try_divide(s, c), 2)), F.when(c == 0, up).otherwise(F.bround(F.try_divide(col(lat) * c - col(lon) * s, c), 2))


def control_point(a: dict, b: dict) -> tuple[Column, Column]:
    """Where the heading lines of two points (dicts lon, lat, heading) meet; their midpoint if parallel."""
    (m1, b1), (m2, b2) = heading_line(**a), heading_line(**b)
    inf = F.lit(float("inf"))
    x1, x2 = col(a["lon"]), col(b["lon"])
    flat = m1 == m2
    x = F.when(flat, (x1 + x2) / 2).when(m1 == inf, F.bround(x1, 2)).when(m2 == inf, F.bround(x2, 2)).otherwise(F.bround(F.try_divide(b2 - b1, m1 - m2), 2))
    y = (
        F.when(flat, (col(a["lat"]) + col(b["lat"])) / 2)
        .when(m1 == inf, F.bround(m2 * x1 + b2, 2))
        .when(m2 == inf, F.bround(m1 * x2 + b1, 2))
        .otherwise(F.bround(m1 * F.try_divide(b2 - b1, m1 - m2) + b1, 2))
    )
    return x, y


def bezier(p0, c, p1, t) -> Column:
    """Quadratic Bezier curve at t."""
    t = col(t)
    return (1 - t) * (1 - t) * col(p0) + 2 * t * (1 - t) * col(c) + t * t * col(p1)


def linear(a, b, ta, tb, t) -> Column:
    """Value at t of the line through (ta, a) and (tb, b), inside or outside."""
    return col(a) + (col(b) - col(a)) * F.try_divide((col(t) - col(ta)).cast("double"), (col(tb) - col(ta)).cast("double"))
