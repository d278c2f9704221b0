"""Partition helpers: greedy balanced bins of groups, equal time ranges, content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def greedy_bins(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, bin): groups in key order fill a bin until it holds at least rows // n rows. Works on the counts of groups."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(df.agg(F.floor(F.count(F.lit(1)) / n).alias("_most"))))
    return c.groupBy(F.lit(0).alias("_k")).applyInPandas(lambda pdf: _fill(pdf, key), f"{key} long, bin int")


def _fill(pdf, key):
    pdf = pdf.sort_values(key)
    out, held, b = [], 0, 0
    for n, most in zip(pdf["n"], pdf["_most"]):
        out.append(b)
        held += n
        if held >= max(1, most):
            held, b = 0, b + 1
    return pdf[[key]].assign(bin=out)


def time_bins(df: DataFrame, ts: str, n: int) -> DataFrame:
    """Adds bin from 0: n equal ranges, closed on the right; the lowest edge belongs to the first."""
    ends = df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    d = df.crossJoin(F.broadcast(ends))  # one row
    pos = F.try_divide((F.col(ts) - F.col("_lo")).cast("double") * n, (F.col("_hi") - F.col("_lo")).cast("double"))
    return d.withColumn("bin", F.greatest(F.lit(0), F.coalesce(F.ceil(pos), F.lit(1)) - 1).cast("int")).drop("_lo", "_hi")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of all rows: count and combined row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xored"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("summed"))


def exact_fingerprint(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """sha256 over sha256s of sorted row digests: rows are digested, digests of equal first `digits` hexadecimal digits are gathered, sorted and digested
    together, and the 16 ** digits results once more."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = df.select(row.alias("_h")).groupBy(F.substring("_h", 1, digits).alias("_p")).agg(joined("_h").alias("_h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), ""), 256).alias("checksum"))


def numbered_bins(df: DataFrame, ts: str, n: int) -> DataFrame:
    return df.withColumn("bin", F.ntile(n).over(Window.orderBy(ts)))
