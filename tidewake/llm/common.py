"""Shared plumbing of the training-data operators: tables in the shared folder, Arrow helpers, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .byte_table import beyond_keys, keys, padded, ranges

_OWN: dict[str, str] = {}
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
PIECE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a run inside one JVM (as in tests) gets a temporary one;
    a cluster has to name its own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="tidewake-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


class Scratch:
    """Intermediate tables of one run, written as Parquet to the shared folder so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Writes a table and reads it again. Meanwhile Arrow batches are small, which bounds what a task holds outside the heap."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = {k: conf.get(k) for k in _BATCHES}
        for k, v in _BATCHES.items():
            conf.set(k, v)
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Writes a run's result and deletes all its other tables."""
        out = self.table("result", df)
        self.drop(*[n for n in self.paths if n != "result"])
        return out

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            if path := self.paths.pop(name, None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def released() -> None:
    """Freed memory goes back to the system. Workers live on between tasks and stages, and an executor's memory counts what idle ones still hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict]], schema: str | StructType, piece: int = PIECE_BYTES, lists: bool = True) -> DataFrame:
    """mapInArrow whose function sees {column: list} (without lists: Arrow batches) for pieces of about `piece` bytes of each batch and yields {column: list or array}."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def pieces(batches):
        for b in batches:
            step = max(1, b.num_rows * piece // max(1, b.nbytes))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                yield part.to_pydict() if lists else part

    def run(batches):
        for got in fn(pieces(batches)):
            if len(got[out.names[0]]):
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type) for f in out], schema=out)
            del got
        released()

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, keep: Callable[[list], list[bool]], column: str, piece: int = PIECE_BYTES) -> DataFrame:
    """Rows for which keep() of the values of a column holds, piece by piece; no other column is converted. Columns may have any names."""
    at, plain = df.columns.index(column), df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches):
        for b in batches:
            step = max(1, b.num_rows * piece // max(1, b.nbytes))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
        released()

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


class Memory:
    """What a worker remembers between tasks belongs to one operator at a time: when another one starts, it is forgotten."""

    owner: str | None = None
    forget: dict[str, Callable[[], None]] = {}

    @classmethod
    def use(cls, owner: str, forget: Callable[[], None]) -> None:
        if cls.owner != owner:
            if cls.owner:
                cls.forget.pop(cls.owner)()
                gc.collect()
                released()
            cls.owner = owner
        cls.forget[owner] = forget


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered; bounded by trim()."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()


WORDS = WordHash()


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z: bytes.lower and bytes.split work on ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Words:
    """The words of a column of texts as words_of() gives them, by arrays. After each text's words comes an end, a line feed.

    b: a padded() buffer of lower-cased bytes. at, size: places of all words in it. begin, count: each text's first word and number of words, its end included.
    low, high: their keys; odd: words that have none.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        edge = np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * wide().itemsize).astype(np.int64)
        n, first = int(edge[-1] - edge[0]), int(edge[0])
        edge -= first
        self.b = padded(np.append(np.frombuffer(texts.buffers()[2], np.uint8, n, first) if n else np.zeros(0, np.uint8), np.uint8(10)))
        self.b |= ((self.b - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
        black = (self.b[: n + 1] != 32) & ((self.b[: n + 1] - np.uint8(9)) > 4)  # the last byte is the end
        inner = edge[(edge > 0) & (edge < n)]
        head = black.copy()
        head[1:] &= ~black[:-1]
        head[inner] = black[inner]
        tail = black.copy()
        tail[:-1] &= ~black[1:]
        tail[inner - 1] = black[inner - 1]
        at = np.flatnonzero(head)
        size = np.flatnonzero(tail) + 1 - at
        stop = np.searchsorted(at, edge[1:])
        self.odd = np.insert(beyond_keys(self.b[:n], at, size), stop, False)
        self.at, self.size = np.insert(at, stop, n), np.insert(size, stop, 1)
        self.count = np.diff(stop, prepend=0) + 1
        self.begin = np.cumsum(self.count) - self.count
        self.low, self.high = keys(self.b, self.at, self.size)

    def word(self, i: int) -> bytes:
        return self.b[self.at[i] : self.at[i] + self.size[i]].tobytes()

    def binary(self, places: np.ndarray) -> pa.Array:
        """Some of the words as an Arrow array."""
        return binary(self.b[ranges(self.at[places], self.at[places] + self.size[places])], self.size[places])


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of some sizes that stand one after another."""
    if data.nbytes >= 1 << 31:
        raw, edge = data.tobytes(), np.cumsum(sizes).tolist()
        return pa.array([raw[i:j] for i, j in zip([0, *edge], edge)], pa.binary())
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def hashes_of(words: list[bytes]) -> np.ndarray:
    Memory.use("words", WORDS.clear)
    out = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    WORDS.trim()
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words."""
    n = len(h) - k + 1
    x = h[:n].copy()
    for i in range(1, k):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x += h[i : i + n]
    return mixed(x)
