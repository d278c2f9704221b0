"""Names of the columns that operators work on, and typed parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Spec:
    """oid: object id, ts: epoch seconds, tie: breaks equal times so that every order is total."""

    oid: str = "mmsi"
    ts: str = "ts"
    lon: str = "lon"
    lat: str = "lat"
    speed: str = "speed"
    course: str = "course"
    heading: str = "heading"
    tie: tuple[str, ...] = field(default=("event_id",))


AIS = Spec()
EARTH_KM = 6371.0088
NM_PER_KM = 0.539956803
