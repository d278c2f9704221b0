"""Readers and writers. All are lazy scans; chunking is Spark's input splits."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Job:
    """Parameters of a pattern search."""

    gp_type: str = "convoys"
    cardinality: int = 9
    dt_min: int = 30
    distance_m: float = 926.0
    step_s: int = 60

    def as_dict(self) -> dict:
        return asdict(self)

    def file_name(self) -> str:
        """A name that tells the parameters."""
        return f"{self.gp_type}_card-{self.cardinality}_dt-{self.dt_min}_dist-{self.distance_m:g}_step-{self.step_s}"


def write_job(spark: SparkSession, job: Job, path: str) -> None:
    """One JSON text, on any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(job.as_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_job(spark: SparkSession, path: str) -> Job:
    return Job(**json.loads(spark.read.text(path, wholetext=True).first()[0]))


# Names of units of time and their seconds.
_UNITS = {"d": 86_400, "day": 86_400, "days": 86_400, "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600, "m": 60, "t": 60, "min": 60, "minute": 60, "minutes": 60, "s": 1, "sec": 1, "second": 1, "seconds": 1}


def duration_seconds(text: str | int) -> int:
    """Seconds of texts such as '30 min', '1h', '1 day 02:30:00' or '90' (seconds)."""
    left = str(text).strip().lower()
    if re.fullmatch(r"\d+", left):
        return int(left)
    total = 0
    if clock := re.search(r"(\d+):(\d\d):(\d\d)$", left):
        total += 3600 * int(clock[1]) + 60 * int(clock[2]) + int(clock[3])
        left = left[: clock.start()]
    parts = re.findall(r"(\d+)\s*([a-z]+)", left)
    if re.sub(r"\d+\s*[a-z]+", "", left).strip() or not (parts or total) or any(u not in _UNITS for _, u in parts):
        raise ValueError(f"no duration: {text}")
    return total + sum(int(n) * _UNITS[u] for n, u in parts)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def stream_csv(spark: SparkSession, path: str, schema: str, files: int = 1, header: bool = True) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("header", header).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict[str, str]) -> DataFrame:
    """One partition per predicate. Credentials come from the caller."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def scan_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Half-open (low, high]; pushed down to the files."""
    return df.filter((F.col(column) > F.lit(low)) & (F.col(column) <= F.lit(high)))


def scan_between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Open interval."""
    return df.filter((F.col(column) > F.lit(low)) & (F.col(column) < F.lit(high)))


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays become JSON text."""
    cols = [F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_patterns_csv(patterns: DataFrame, folder: str, job: Job) -> str:
    """Writes under a name that tells the parameters and returns the path."""
    path = f"{folder}/{job.file_name()}.csv"
    write_csv(patterns, path)
    return path


def read_patterns_csv(spark: SparkSession, path: str) -> DataFrame:
    d = read_csv(spark, path, "clusters string, st long, et long")
    return d.withColumn("clusters", F.from_json("clusters", "array<bigint>"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _belongs(checksum: str, job: Job) -> dict:
    return {"checksum": checksum, "params": str(job.as_dict())}


def write_snapshot(patterns: DataFrame, path: str, checksum: str, job: Job, current_ts: int) -> None:
    """Active patterns with what they belong to, for a restart. The schema holds it too, so a snapshot without patterns is found again."""
    told = _belongs(checksum, job)
    patterns.withColumn("checksum", F.lit(checksum).alias("checksum", metadata=told)).withColumn("params", F.lit(told["params"])).withColumn("current_ts", F.lit(current_ts)).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, checksum: str, job: Job) -> DataFrame | None:
    """The snapshot if it is of this data and these parameters."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    d = spark.read.parquet(path)
    return d if d.schema["checksum"].metadata == _belongs(checksum, job) else None


def read_frames(spark: SparkSession, path: str, decode=None) -> DataFrame:
    """Frames from binary files. decode: bytes -> list of (height, width, pixels); without one the table of files is returned."""
    files = spark.read.format("binaryFile").load(path)
    if decode is None:
        return files
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(p, n, h, w, px) for p, raw in zip(pdf["path"], pdf["content"]) for n, (h, w, px) in enumerate(decode(raw))]
            yield pd.DataFrame(rows, columns=["video_id", "frame_id", "height", "width", "pixels"])

    return files.select("path", "content").mapInPandas(run, "video_id string, frame_id int, height int, width int, pixels array<double>")
