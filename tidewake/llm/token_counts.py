"""Operator 1, token counts: the exact length histogram and what suffix sums over it answer.

Documents are encoded whole and aggregated by their encoded length (partial counts before the shuffle). The histogram
has one row per distinct length and is written once, since both levels of the sums read it; block sums and window sums inside blocks of lengths turn it into suffix sums, so no
task holds more than one block. From these follow, for every context limit, the totals, the documents that fit, the
tokens left after truncation, and quantiles.

Null and empty texts have length 0 and count as documents. Ids play no part, so null or repeated ids and repeated rows
each count once per row. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_map, table
from .encode import BYTE, encoder

BLOCK = 128


def encoded_lengths(docs: DataFrame, text: str = "text", tokenizer: str = BYTE) -> DataFrame:
    """n_tokens of every row's whole text."""

    def lengths(batches):
        enc = encoder(tokenizer)
        for b in batches:
            yield {"n_tokens": [len(enc.ids(t)) // 4 for t in b["t"]]}

    return arrow_map(docs.select(F.col(text).alias("t")), lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L of the histogram: documents and tokens at lengths >= L and in all, by block sums and sums inside blocks."""
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    outer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per BLOCK lengths
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(outer), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("bt").over(outer), F.lit(0)).alias("tokens_above"), F.sum("bd").over(every).alias("docs_all"), F.sum("bt").over(every).alias("tokens_all"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return h.join(blocks, "block").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(inner) + F.col("docs_above")).alias("docs_from"),
        (F.sum("tokens").over(inner) + F.col("tokens_above")).alias("tokens_from"),
        "docs_all", "tokens_all",
    )


def context_report(histogram: DataFrame) -> DataFrame:
    """For every limit that is some document's length: fits (documents of at most that length), total_tokens of all documents,
    tokens_kept (each document cut at the limit), tokens_lost, and quantile (the share of documents of at most that length)."""
    s = suffix_sums(histogram)
    longer, tokens_to = F.col("docs_from") - F.col("n_docs"), F.col("tokens_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("n_docs")
    kept = tokens_to + F.col("n_tokens") * longer
    return s.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("docs_all") - longer).alias("fits"), F.col("tokens_all").alias("total_tokens"),
        kept.alias("tokens_kept"), (F.col("tokens_all") - kept).alias("tokens_lost"), ((F.col("docs_all") - longer) / F.col("docs_all")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left when every document is cut at each given limit."""
    return histogram.agg(*[F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(x)) * F.col("n_docs")), F.lit(0)).alias(f"kept_{x}") for x in limits])


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length at which at least the share of all documents fits: (share, n_tokens)."""
    r = context_report(histogram).select("context_limit", "quantile")
    return r.agg(*[F.min(F.when(F.col("quantile") >= x, F.col("context_limit"))).alias(f"q{i}") for i, x in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(x)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)])).alias("r")
    ).select("r.*")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = Scratch(spark, "op1").table("histogram", length_histogram(encoded_lengths(table(spark, sf_dir, "documents"))))
    return context_report(histogram)
