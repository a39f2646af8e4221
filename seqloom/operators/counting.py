"""Count distinct sequences, with reads per million and competition ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.reads import rpm, two_decimals


def count_sequences(reads: DataFrame, *by: str, sequence: str = "sequence") -> DataFrame:
    return reads.groupBy(*by, sequence).agg(F.count("*").alias("count"))


def with_rpm(counts: DataFrame, *by: str) -> DataFrame:
    """Reads per million of all reads (of each group)."""
    if by:
        return counts.join(counts.groupBy(*by).agg(F.sum("count").alias("_total")), list(by)).withColumn("rpm", rpm(F.col("count"), F.col("_total"))).drop("_total")
    # A subquery shares the shuffle of the counts, so the reads are scanned once.
    return counts.withColumn("rpm", rpm(F.col("count"), counts.agg(F.sum("count")).scalar()))


def with_rank(counts: DataFrame, *by: str) -> DataFrame:
    """1-2-2-4 ranks by count. Ranks are made from the histogram of counts, so no task gets all sequences.

    The number of different counts is no more than the square root of twice the reads, 1.5 million for a trillion reads, so
    without groups the ranks are sent to all tasks.
    """
    levels = counts.groupBy(*by, "count").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select(*by, "count", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("long").alias("rank"))
    return counts.join(ranks if by else F.broadcast(ranks), [*by, "count"])


def rank_table(counts: DataFrame) -> DataFrame:
    """rank, sequence, count, rpm, length (bytes) of counted sequences."""
    out = with_rank(with_rpm(counts))
    return out.select("rank", "sequence", "count", "rpm", F.octet_length("sequence").alias("length"))


def count_table(reads: DataFrame, sequence: str = "sequence") -> DataFrame:
    """rank, sequence, count, rpm, length (bytes)."""
    return rank_table(count_sequences(reads, sequence=sequence).withColumnRenamed(sequence, "sequence"))


def ranked(table: DataFrame) -> DataFrame:
    """In rank order; ties by sequence."""
    return table.orderBy(F.desc("count"), "sequence")


def fasta_header(table: DataFrame) -> DataFrame:
    """>RANK-COUNT-RPM and the sequence, as one text of two lines."""
    name = F.concat_ws("-", F.col("rank").cast("string"), F.col("count").cast("string"), two_decimals(F.col("rpm")))
    return table.select(F.concat(F.lit(">"), name, F.lit("\n"), F.col("sequence")).alias("value"), "count", "sequence")


def enrichment(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sequences of two rounds with both counts and the ratio of their reads per million (null where one is missing)."""
    a = with_rpm(before).select("sequence", F.col("count").alias("count_before"), F.col("rpm").alias("rpm_before"))
    b = with_rpm(after).select("sequence", F.col("count").alias("count_after"), F.col("rpm").alias("rpm_after"))
    return a.join(b, "sequence", "full").withColumn("fold_change", F.col("rpm_after") / F.col("rpm_before"))
