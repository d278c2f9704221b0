"""Operator 2, WARC: a normaliser for monolithic gzip archives.

Crawlers sometimes compress a whole archive as one gzip stream, which cannot be entered in its middle. The normaliser
inflates such a stream once, piece by piece, finds the record borders from the headers, rewrites every record as its own gzip
member, and writes a sidecar index (offset, compressed length, record id per record). A reader then opens one record by offset.

Payloads are SHA-1 digested. Of equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is a response and the others
revisit it; smaller ones are all responses. Null html is an empty payload. A null page_id loses to any other; repeated rows with the
largest page_id of their group are responses each. Null urls become empty targets. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
SALTS = 64
EPOCH = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(kind: str, page_id, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{page_id}:{digest}:{place}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, place: str = "") -> bytes:
    """One WARC/1.1 record. A revisit has no block; its headers tell the payload's digest and length and whom it repeats. place makes the id of a record that
    no other refers to its own, also where rows or null ids repeat."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page_id, digest, place if kind == 'revisit' or len(payload) < MIN_REVISIT else '')}", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id('response', refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records(stream: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """Whole records of a gzip archive (one stream or many members), inflated piece by piece; a cut-off tail raises."""
    held, d, at, need = bytearray(), zlib.decompressobj(31), 0, None
    view = memoryview(stream)
    while True:
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers_of(bytes(held[:end])).get("content-length", 0)) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
        if d.eof and d.unused_data:
            held += (n := zlib.decompressobj(31)).decompress(d.unused_data)
            d = n
        elif at < len(view):
            if d.eof:
                d = zlib.decompressobj(31)
            held += d.decompress(view[at : at + piece])
            at += piece
        else:
            break
    if held:
        raise ValueError("archive ends inside a record")


def member(record: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def normalise(stream: bytes) -> tuple[bytes, list[dict]]:
    """(archive with a gzip member per record, sidecar entries {offset, length, id})."""
    out, index, at = [], [], 0
    for r in records(stream):
        m = member(r)
        index.append({"offset": at, "length": len(m), "id": headers_of(r[: r.find(b"\r\n\r\n")]).get("warc-record-id", "")})
        out.append(m)
        at += len(m)
    return b"".join(out), index


def open_record(archive: bytes, entry: dict) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at a sidecar entry; nothing else is inflated."""
    raw = zlib.decompress(memoryview(archive)[entry["offset"] : entry["offset"] + entry["length"]], 31)
    end = raw.find(b"\r\n\r\n")
    head = headers_of(raw[:end])
    return head, raw[end + 4 : end + 4 + int(head.get("content-length", 0))]


def with_record_types(pages: DataFrame) -> DataFrame:
    """Adds payload (binary), digest, record_type and refers_to. Digest groups are pre-aggregated; only groups of two or more are
    joined back, salted, so that a third of all rows may share one payload."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("big", F.octet_length("payload") >= MIN_REVISIT)
    lead = p.filter("big").groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    lead = lead.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("big"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(lead, ["digest", "salt", "big"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def monolithic_archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive): gzip streams over many records each, about archive_bytes of records per stream; a record is never split."""

    def write(batches):
        c, size, n, partition = None, 0, 0, TaskContext.get().partitionId()
        parts: list[bytes] = []
        for b in batches:
            for row in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["record_type"], b["refers_to"]):
                if c is None:
                    c, size, parts = zlib.compressobj(6, zlib.DEFLATED, 31), 0, []
                r = record_bytes(*row, place=f"{partition}-{n}")
                n += 1
                parts.append(c.compress(r))
                size += len(r)
                if size >= archive_bytes:
                    yield {"archive": [b"".join(parts) + c.flush()]}
                    c = None
        if c is not None:
            yield {"archive": [b"".join(parts) + c.flush()]}

    return arrow_map(typed, write, "archive binary")


def normalised_archives(archives: DataFrame) -> DataFrame:
    """(archive, sidecar): members per record, and the index as JSON lines."""

    def rewrite(batches):
        for b in batches:
            for a in b["archive"]:
                out, index = normalise(a)
                yield {"archive": [out], "sidecar": ["\n".join(map(json.dumps, index))]}

    return arrow_map(archives, rewrite, "archive binary, sidecar string")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record, each opened at its offset; a response's digest and length are taken from its block."""
    import hashlib

    def read(batches):
        for b in batches:
            for archive, sidecar in zip(b["archive"], b["sidecar"]):
                out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
                for line in sidecar.split("\n"):
                    head, block = open_record(archive, json.loads(line))
                    kind = head["warc-type"]
                    out["page_id"].append(int(head["x-page-id"]) if head["x-page-id"] else None)
                    out["payload_bytes"].append(len(block) if kind == "response" else int(head["x-payload-length"]))
                    out["payload_digest"].append(hashlib.sha1(block).hexdigest() if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:"))
                    out["record_type"].append(kind)
                    out["refers_to"].append(int(head["x-refers-to-page"]) if kind == "revisit" else None)
                    out["url"].append(head.get("warc-target-uri", ""))
                yield out

    return arrow_map(archives, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "op2")
    raw = s.table("monolithic", monolithic_archives(with_record_types(table(spark, sf_dir, "pages"))), codec="uncompressed")
    done = s.table("members", normalised_archives(raw), codec="uncompressed")
    s.drop("monolithic")
    return s.last(read_archives(done).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS f FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN m.f IS NOT NULL AND m.f <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.f <> d.page_id THEN m.f END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h AND d.n >= 1000
"""
