"""Validation by single criteria around one constant, joined by AND or OR."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.reads import fenced_filter, mean_quality, percent


@dataclass(frozen=True)
class Criteria:
    """Criteria left at None are not part of the verdict."""

    constant: str
    min_length: int | None = None
    max_length: int | None = None
    upstream: int | None = None
    upstream_tolerance: int = 0
    downstream: int | None = None
    downstream_tolerance: int = 0
    min_quality: float | None = None
    mode: str = "and"


def _tests(c: Criteria, quality: bool) -> dict[str, Column]:
    out = {"ok_constant": F.col("upstream_length").isNotNull()}
    if c.min_length is not None or c.max_length is not None:
        low = F.lit(True) if c.min_length is None else F.col("total_length") >= c.min_length
        high = F.lit(True) if c.max_length is None else F.col("total_length") <= c.max_length
        out["ok_length"] = low & high
    sides = []
    for side, length, tolerance in (("upstream", c.upstream, c.upstream_tolerance), ("downstream", c.downstream, c.downstream_tolerance)):
        if length is not None:
            out[f"ok_{side}"] = F.coalesce(F.abs(F.col(f"{side}_length") - length) <= tolerance, F.lit(False))
            sides.append(f"ok_{side}")
    if len(sides) == 2:
        out["ok_structure"] = out[sides[0]] & out[sides[1]]
    if c.min_quality is not None and quality:
        out["ok_quality"] = F.coalesce(F.col("mean_quality") >= c.min_quality, F.lit(False))
    return out


def judge(reads: DataFrame, c: Criteria, sequence: str = "sequence", quality: str = "quality") -> DataFrame:
    """Add lengths, one ok_ column for each criterion in use, and valid."""
    has = quality in reads.columns
    at = F.instr(F.upper(F.col(sequence)), c.constant.upper())
    out = reads.withColumn("_at", at).withColumns(
        {
            "total_length": F.length(sequence),
            "upstream_length": F.when(F.col("_at") > 0, F.col("_at") - 1),
            "downstream_length": F.when(F.col("_at") > 0, F.length(sequence) - F.col("_at") - (len(c.constant) - 1)),
            **({"mean_quality": mean_quality(F.col(quality))} if has else {}),
        }
    ).drop("_at")
    tests = _tests(c, has)
    fold = (lambda a, b: a & b) if c.mode == "and" else (lambda a, b: a | b)
    parts = [v for k, v in tests.items() if k not in ("ok_upstream", "ok_downstream") or "ok_structure" not in tests]
    return out.withColumns({**tests, "valid": reduce(fold, parts)})


def length_distribution(judged: DataFrame, column: str = "total_length") -> DataFrame:
    return fenced_filter(judged, F.col(column).isNotNull()).groupBy(F.col(column).alias("length")).agg(F.count("*").alias("n"))


def structure_pairs(judged: DataFrame) -> DataFrame:
    """Pairs of lengths of reads with the constant; percentage of those reads."""
    some = fenced_filter(judged, F.col("upstream_length").isNotNull())
    pairs = some.groupBy("upstream_length", "downstream_length").agg(F.count("*").alias("n"))
    return pairs.withColumn("percentage", percent(F.col("n"), pairs.agg(F.sum("n")).scalar()))


def failure_reasons(judged: DataFrame) -> DataFrame:
    """Counts that may overlap: reads that fail each criterion, and their share of the invalid reads."""
    names = [c for c in judged.columns if c.startswith("ok_")]
    counts = judged.agg(F.count_if(~F.col("valid")).alias("bad"), *[F.count_if(~F.col(c) & ~F.col("valid")).alias(c) for c in names])
    rows = [F.struct(F.lit(c[3:]).alias("reason"), F.col(c).alias("n"), percent(F.col(c), F.col("bad")).alias("pct")) for c in names]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validation_summary(judged: DataFrame) -> DataFrame:
    """Counts for each criterion with its share of all reads, or of reads with the constant for the flanks."""
    names = [c for c in judged.columns if c.startswith("ok_")]
    counts = judged.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), *[F.count_if(F.col(c)).alias(c) for c in names])
    flank = ("ok_upstream", "ok_downstream", "ok_structure")
    rows = [
        F.struct(F.lit(c[3:]).alias("criterion"), F.col(c).alias("n"), percent(F.col(c), F.col("ok_constant" if c in flank else "total")).alias("pct"))
        for c in names
    ]
    rows.append(F.struct(F.lit("valid").alias("criterion"), F.col("valid").alias("n"), percent(F.col("valid"), F.col("total")).alias("pct")))
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
