"""The commands on files of reads: analyze, count, validate, criteria and enrich."""

from __future__ import annotations

import sys
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions.reads import fenced_filter, normalize, two_decimals
from seqloom.operators import counting, criteria, matching
from seqloom.plans import reports
from seqloom.shared import write_text
from seqloom.sources import sinks
from seqloom.sources.fastx import check_samples, read_reads, sample_name

REPORTS = ("txt", "csv", "json")


def normalized(reads: DataFrame) -> DataFrame:
    return reads.withColumn("sequence", normalize(F.col("sequence")))


def match_unique(reads: DataFrame, construct: Construct, strict: bool = True, depth: int = 3) -> DataFrame:
    """Each distinct sequence once, with its count as weight: a read's match depends on nothing else."""
    unique = counting.count_sequences(reads)
    return matching.near_miss(matching.annotate(unique, construct, strict), construct, depth)


def analysis_table(unique: DataFrame) -> DataFrame:
    """The counts with is_valid and random_region from the match itself."""
    kept = unique.select("sequence", "count", F.col("matched").alias("is_valid"), matching.random_region().alias("random_region"))
    out = counting.with_rank(counting.with_rpm(kept))
    return out.select("rank", "sequence", "count", "rpm", F.octet_length("sequence").alias("length"), "is_valid", "random_region")


def _write_reads(reads: DataFrame, construct: Construct, strict: bool, prefix: str, keep: bool, extract: bool, kind: str) -> None:
    """The valid reads and their random regions; the reads are read once for both."""
    if not (keep or extract):
        return
    ok = matching.valid(matching.annotate(reads, construct, strict))
    both = keep and extract
    if both:
        ok = ok.select("id", "sequence", "quality", "matched", "rand_regions").persist()
    if keep:
        sinks.write_reads(ok, f"{prefix}.filtered.{sinks.READ_SUFFIXES[kind]}", kind)
    if extract:
        sinks.write_random_regions(ok, f"{prefix}.random.fa")
    if both:
        ok.unpersist()


def _say(quiet: bool, *lines: str) -> None:
    for line in () if quiet else lines:
        print(f"  {line}", file=sys.stderr)


def _prefixes(paths: list[str], output: str) -> list[tuple[str, str]]:
    check_samples(paths)
    return [(p, output if len(paths) == 1 else f"{output}/{sample_name(p)}") for p in paths]


def analyze(
    spark: SparkSession, paths: list[str], output: str, construct: Construct, strict: bool = True, depth: int = 3,
    keep: bool = False, extract: bool = False, kind: str = "auto", placeholder_validation: bool = False, multiqc: bool = False,
    formats: tuple[str, ...] = ("json", "txt"), enrich: bool = False, quiet: bool = True,
) -> None:
    """Counts as Parquet and FASTA, reports as JSON and text; with keep and extract also the valid reads and their random regions.

    enrich: each input after the first is a round that is compared with the one before it.
    """
    for path, prefix in _prefixes(paths, output):
        reads = normalized(read_reads(spark, path))
        unique = match_unique(reads, construct, strict, depth).persist()
        data = reports.report(unique, construct, "count")
        table = analysis_table(unique)
        if placeholder_validation:
            table = table.withColumns({"is_valid": F.lit(True), "random_region": F.lit(None).cast("string")})
        _say(quiet, f"{data['summary']['total_reads']} total reads, {unique.count()} unique sequences", reports.summary_line(data))
        facts = sinks.metadata(data["summary"]["total_reads"], path, construct)
        sinks.write_parquet(counting.ranked(table), f"{prefix}.parquet", facts)
        sinks.write_fasta(table, f"{prefix}.fasta")
        _write_report(spark, data, prefix, path, multiqc, formats)
        _write_reads(reads, construct, strict, prefix, keep, extract, kind)
        unique.unpersist()
    if enrich and len(paths) > 1:
        enrich_rounds(spark, paths, output)


def enrich_rounds(spark: SparkSession, paths: list[str], output: str) -> None:
    """For each round and the next, a CSV of counts, reads per million and their ratio."""
    counts = {p: counting.count_sequences(normalized(read_reads(spark, p))) for p in paths}
    for a, b in pairwise(paths):
        table = counting.enrichment(counts[a], counts[b]).orderBy(F.desc_nulls_last("fold_change"), "sequence")
        sinks.write_csv(table, f"{output}/{sample_name(a)}-{sample_name(b)}.enrichment.csv")


def _write_report(spark: SparkSession, data: dict, prefix: str, path: str, multiqc: bool, formats: tuple[str, ...]) -> None:
    if "json" in formats:
        write_text(spark, f"{prefix}.report.json", reports.as_json(data))
    if "txt" in formats:
        write_text(spark, f"{prefix}.report.txt", reports.as_text(data))
    if "csv" in formats:
        rows = ["rand,length,count"] + [f"{k},{n},{m}" for k, r in enumerate(data["per_rand_segment"]) for n, m in r["length_distribution"].items()]
        write_text(spark, f"{prefix}.length_dist.csv", "\n".join(rows) + "\n")
    if multiqc:
        write_text(spark, f"{prefix}_mqc.json", reports.as_multiqc(data, sample_name(path)))


def count(spark: SparkSession, paths: list[str], output: str, kind: str = "parquet", quiet: bool = True) -> None:
    """Counts of the raw sequences in one format."""
    for path, prefix in _prefixes(paths, output):
        unique = counting.count_sequences(read_reads(spark, path).select("sequence")).persist()
        table, facts = counting.rank_table(unique), unique.agg(F.sum("count").alias("n"), F.count("*").alias("k")).first()
        _say(quiet, f"{facts.n or 0} total reads, {facts.k} unique sequences")
        options = {"metadata": sinks.metadata(facts.n or 0, path)} if kind == "parquet" else {}
        sinks.write_counts(table, f"{prefix}.{kind}", kind, **options)
        unique.unpersist()


def validate(
    spark: SparkSession, path: str, output: str, construct: Construct, strict: bool = True, depth: int = 3,
    keep: bool = False, extract: bool = False, kind: str = "auto", multiqc: bool = False, formats: tuple[str, ...] = ("json", "txt"), quiet: bool = True,
) -> dict:
    reads = normalized(read_reads(spark, path))
    unique = match_unique(reads, construct, strict, depth).persist()
    data = reports.report(unique, construct, "count")
    _say(quiet, reports.summary_line(data))
    _write_report(spark, data, output, path, multiqc, formats)
    _write_reads(reads, construct, strict, output, keep, extract, kind)
    unique.unpersist()
    return data


def validate_criteria(
    spark: SparkSession, path: str, output: str, c: criteria.Criteria, formats: tuple[str, ...] = ("txt", "json"), keep: bool = False,
    kind: str = "fasta", multiqc: bool = False, quiet: bool = True,
) -> dict:
    """Validation by single criteria around one constant: reports, distributions as CSV, and the valid reads."""
    judged = criteria.judge(read_reads(spark, path), c).persist()
    data = reports.criteria_report(judged, c)
    _say(quiet, reports.summary_line(data))
    if "txt" in formats:
        write_text(spark, f"{output}.validation.txt", reports.criteria_text(data))
    if "json" in formats:
        write_text(spark, f"{output}.stats.json", reports.as_json(data))
    if "csv" in formats:
        for name, column in (("length", "total_length"), ("upstream", "upstream_length"), ("downstream", "downstream_length")):
            sinks.write_csv(criteria.length_distribution(judged, column).withColumnRenamed("n", "count").orderBy("length"), f"{output}.{name}_dist.csv")
        pairs = criteria.structure_pairs(judged).orderBy(F.desc("n"), "upstream_length", "downstream_length").withColumnRenamed("n", "count")
        sinks.write_csv(pairs.withColumn("percentage", two_decimals(F.col("percentage"))), f"{output}.structure_pairs.csv")
    if multiqc:
        write_text(spark, f"{output}_mqc.json", reports.as_multiqc(data, sample_name(path), c.mode))
    if keep:
        ok = fenced_filter(judged, F.col("valid")).select("id", "sequence", "quality")
        sinks.write_reads(ok, f"{output}.filtered.{sinks.READ_SUFFIXES[kind]}", kind)
    judged.unpersist()
    return data
