"""Statistics of annotated reads. Every count is a sum of weights, so unique sequences with their counts do as well as reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions.reads import fenced_filter, percent


def _sum(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("long")


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def summary(df: DataFrame, weight: str | None = None) -> DataFrame:
    w = _weight(weight)
    out = df.agg(_sum(F.lit(True), w).alias("total_reads"), _sum(F.col("matched"), w).alias("valid"))
    total, ok = F.col("total_reads"), F.col("valid")
    return out.withColumns({"invalid": total - ok, "valid_pct": percent(ok, total)})


def failure_breakdown(df: DataFrame, weight: str | None = None) -> DataFrame:
    out = df.groupBy(F.col("failure.kind").alias("kind"), F.when(F.col("failure.kind").isin("ConstNotFound", "RandOutOfRange"), F.col("failure.arg")).alias("arg"))
    return out.agg(F.sum(_weight(weight)).cast("long").alias("n"))


def per_const(df: DataFrame, construct: Construct, weight: str | None = None) -> DataFrame:
    """const_idx, sequence, found, not_found, found_pct and, with near_miss applied before, four buckets."""
    w = _weight(weight)
    near = [k for k in range(len(construct.consts)) if f"_b{k}" in df.columns]
    columns = [_sum(F.lit(True), w).alias("total")]
    for k in range(len(construct.consts)):
        columns += [_sum(F.col(f"_p{k}") > 0, w).alias(f"f{k}"), _sum(F.col(f"_p{k}") == 0, w).alias(f"n{k}")]
        columns += [_sum(F.col(f"_b{k}") == b, w).alias(f"b{k}_{b}") for b in range(4) if k in near]
    rows = [
        F.struct(
            F.lit(k).alias("const_idx"), F.lit(c).alias("sequence"), F.col(f"f{k}").alias("found"), F.col(f"n{k}").alias("not_found"),
            percent(F.col(f"f{k}"), F.col("total")).alias("found_pct"),
            *[(F.col(f"b{k}_{b}") if k in near else F.lit(0).cast("long")).alias(f"near_{b + 1}") for b in range(4)],
        )
        for k, c in enumerate(construct.consts)
    ]
    return df.agg(*columns).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def per_rand(df: DataFrame, construct: Construct, weight: str | None = None) -> DataFrame:
    """rand_idx, min_len, max_len, in_range, out_of_range, in_range_pct (of all reads)."""
    w = _weight(weight)
    columns = [_sum(F.lit(True), w).alias("total")]
    for k in range(len(construct.rands)):
        inside = F.get("rand_regions", F.lit(k))["in_range"]
        columns += [_sum(inside, w).alias(f"i{k}"), _sum(~inside, w).alias(f"o{k}")]
    rows = [
        F.struct(
            F.lit(k).alias("rand_idx"), F.lit(r.min_len).alias("min_len"), F.lit(r.max_len).alias("max_len"), F.col(f"i{k}").alias("in_range"),
            F.col(f"o{k}").alias("out_of_range"), percent(F.col(f"i{k}"), F.col("total")).alias("in_range_pct"),
        )
        for k, (_, r) in enumerate(construct.rands)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "rand_idx int, min_len int, max_len int, in_range long, out_of_range long, in_range_pct double")
    return df.agg(*columns).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rand_length_dist(df: DataFrame, weight: str | None = None) -> DataFrame:
    # An inner explode would have the optimizer match all reads once more, in a filter on the regions' number.
    out = df.select(F.posexplode_outer("rand_regions").alias("rand_idx", "r"), _weight(weight).alias("w")).filter(F.col("rand_idx").isNotNull())
    return out.groupBy("rand_idx", F.col("r.length").alias("length")).agg(F.sum("w").cast("long").alias("n"))


#: More positions than this are rows, not columns of one aggregation.
MOST_POSITIONS = 64


def composition(df: DataFrame, construct: Construct, weight: str | None = None, sequence: str = "sequence") -> DataFrame:
    """rand_idx, position (1-based) and counts of A, T, G, C in the random regions of matched reads.

    A matched read's region is no longer than its segment's maximum, so the positions of short segments are columns of one
    aggregation, without a row for each base; positions beyond the longest region are left out. Constructs with more than
    MOST_POSITIONS have a row for each base instead, as their plan would grow with the maximum.
    """
    if not construct.rands:
        return df.sparkSession.createDataFrame([], "rand_idx int, position int, A long, T long, G long, C long")
    if sum(r.max_len for _, r in construct.rands) > MOST_POSITIONS:
        return _composition_rows(df, weight, sequence)
    columns = []
    for k, (_, r) in enumerate(construct.rands):
        place = F.get("rand_regions", F.lit(k))
        columns.append(F.coalesce(F.max(F.when(F.col("matched"), place["length"])), F.lit(0)).alias(f"m{k}"))
        for i in range(r.max_len):
            inside = F.col("matched") & (place["length"] > i)
            base = F.substring(F.upper(F.col(sequence)), place["start"] + (i + 1), F.lit(1))
            columns += [_sum(inside & base.isin(*letters), _weight(weight)).alias(f"{k}_{i}_{letters[0]}") for letters in ("A", "TU", "G", "C")]
    rows = [
        F.struct(F.lit(k).alias("rand_idx"), F.lit(i + 1).alias("position"), F.col(f"m{k}").alias("m"), *[F.col(f"{k}_{i}_{b}").alias(b) for b in "ATGC"])
        for k, (_, r) in enumerate(construct.rands)
        for i in range(r.max_len)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "rand_idx int, position int, A long, T long, G long, C long")
    out = df.agg(*columns).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.filter(F.col("position") <= F.col("m")).drop("m")


def _composition_rows(df: DataFrame, weight: str | None, sequence: str) -> DataFrame:
    regions = fenced_filter(df, F.col("matched")).select(F.posexplode("rand_regions").alias("rand_idx", "r"), F.upper(F.col(sequence)).alias("s"), _weight(weight).alias("w"))
    bases = F.split(F.substring(F.col("s"), F.col("r.start") + 1, F.col("r.length")), "")
    rows = regions.filter(F.col("r.length") > 0).select("rand_idx", "w", F.posexplode(bases).alias("at", "base"))
    counts = [_sum(F.col("base").isin(*letters), F.col("w")).alias(letters[0]) for letters in ("A", "TU", "G", "C")]
    return rows.groupBy("rand_idx", (F.col("at") + 1).alias("position")).agg(*counts)


def outcomes(df: DataFrame, construct: Construct, weight: str | None = None) -> DataFrame:
    """mask, matched, const (the one that was not found), bucket (its near-miss bucket) and n: a small table that holds all counts of the report but lengths and bases."""
    missed, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in range(len(construct.consts)):
        here = F.col(f"_p{k}") == 0
        missed = F.when(here, k).otherwise(missed)
        bucket = F.when(here, F.col(f"_b{k}") if f"_b{k}" in df.columns else F.lit(None).cast("int")).otherwise(bucket)
    return df.groupBy("mask", "matched", missed.alias("const"), bucket.alias("bucket")).agg(F.sum(_weight(weight)).cast("long").alias("n"))


def composition_pct(counts: DataFrame) -> DataFrame:
    total = F.col("A") + F.col("T") + F.col("G") + F.col("C")
    return counts.select("rand_idx", "position", *[percent(F.col(b), total).alias(f"{b}_pct") for b in "ATGC"])


def combinations(df: DataFrame, weight: str | None = None) -> DataFrame:
    return df.groupBy("mask").agg(F.sum(_weight(weight)).cast("long").alias("n"))


def top_combinations(counts: DataFrame, k: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("n"), "mask").limit(k)


def pass_fail(counts: DataFrame, construct: Construct) -> DataFrame:
    """Names of the segments that passed and failed, for each mask."""
    names = F.array(*[F.lit(n) for n in construct.bit_names()])
    set_bit = lambda i: F.expr(f"shiftright(mask, {i})")
    flags = [set_bit(i).bitwiseAND(F.lit(1)) == 1 for i in range(len(construct.segments))]
    ok = F.array_compact(F.array(*[F.when(f, F.get(names, F.lit(i))) for i, f in enumerate(flags)]))
    bad = F.array_compact(F.array(*[F.when(~f, F.get(names, F.lit(i))) for i, f in enumerate(flags)]))
    return counts.select("mask", "n", ok.alias("passed"), bad.alias("failed"))


def mask_label(construct: Construct) -> Column:
    return F.when(F.col("mask") == construct.all_pass, "ALL PASS").otherwise(F.concat(F.lit("mask=0b"), F.bin("mask")))


def matched_only(df: DataFrame) -> DataFrame:
    return fenced_filter(df, F.col("matched"))
