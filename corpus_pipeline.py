"""The corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm.common import Scratch, table
from tidewake.llm.decontamination import drop_contaminated
from tidewake.llm.language_crf import keep_identified
from tidewake.llm.near_copies import keep_one_of_each
from tidewake.llm.packing import pack_documents

STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Tokenizing, sketching and the genetic packing have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    last = None
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
        if last:
            scratch.drop(last)
        last = name
    return docs
