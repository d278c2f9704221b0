"""Mining in time partitions with a snapshot after each, so that a run that was stopped goes on where it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partitioning import time_bins
from ..sources import io
from ..sources.shared import written
from .align import IncrementalMiner


def group_patterns(clusters: DataFrame, job: io.Job, folder: str, parts: int = 4, stop_after: int | None = None) -> str | None:
    """Mines (frame, clusters) partition by partition and writes the CSV, whose path is returned. Every partition ends in a snapshot under its own number with the
    parameters; partitions with one are passed over at the next start. stop_after ends a run early (None is returned). Patterns, not points, are held."""
    spark = clusters.sparkSession
    miner, check = IncrementalMiner(job.cardinality, 60 * job.dt_min), f"parts-{parts}"
    binned = written(time_bins(clusters, "frame", parts), "clusters")  # read once per partition
    for part in range(parts):
        path = f"{folder}/snapshot-{part}"
        if io.read_snapshot(spark, path, check, job) is None:
            if part and not miner.active and not miner.closed and (before := io.read_snapshot(spark, f"{folder}/snapshot-{part - 1}", check, job)) is not None:
                miner.resume(before.filter("st IS NOT NULL"))
            miner(binned.filter(F.col("bin") == part).select("frame", "clusters"))
            rows = miner.state() or [(None, None, None, None)]  # an empty state is a state too
            state = spark.createDataFrame(rows, "clusters array<bigint>, st long, et long, open boolean")
            io.write_snapshot(state, path, check, job, part)
        if stop_after is not None and part + 1 >= stop_after:
            return None
    last = io.read_snapshot(spark, f"{folder}/snapshot-{parts - 1}", check, job).filter("st IS NOT NULL")
    return io.write_patterns_csv(last.select("clusters", "st", "et"), folder, job)
