"""Match reads against a construct: constants left to right, each at its first place after the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions.reads import fenced_filter, min_hamming, near_miss_bucket


def _anchor(k: int) -> str:
    return f"_p{k}"


def annotate(df: DataFrame, construct: Construct, strict: bool = True, sequence: str = "sequence", check_adjacent: bool = False) -> DataFrame:
    """Add _p0.. (1-based anchors: 0 not found, null not looked for), const_matches, rand_regions, leading_gap,
    trailing_gap, failure, matched and mask.

    Each anchor is a projection of its own, so a chain of many constants stays linear.
    """
    consts = construct.consts
    seq = F.upper(F.col(sequence))
    for k, c in enumerate(consts):
        if k == 0:
            place = F.position(F.lit(c), seq)
        else:
            before = F.col(_anchor(k - 1))
            place = F.when(before > 0, F.position(F.lit(c), seq, before + len(consts[k - 1])))
        df = df.withColumn(_anchor(k), place)
    anchors = [F.col(_anchor(k)) for k in range(len(consts))]
    found = anchors[-1] > 0
    whole = F.coalesce(found, F.lit(False))
    length = F.length(F.col(sequence))
    ends = [a + len(c) for a, c in zip(anchors, consts, strict=True)]
    lead, trail = anchors[0] - 1, length - ends[-1] + 1
    regions, failures, bits = [], [], []
    for n, (before, r) in enumerate(construct.rands):
        start = F.lit(0) if before == 0 else ends[before - 1] - 1
        size = lead if before == 0 else trail if before == len(consts) else anchors[before] - ends[before - 1]
        inside = size.between(r.min_len, r.max_len)
        regions.append(F.struct(start.cast("int").alias("start"), size.cast("int").alias("length"), inside.alias("in_range")))
        failures.append(F.when(whole & ~inside, _failure("RandOutOfRange", F.lit(n))))
        bits.append(F.when(whole & inside, F.lit(1 << (len(consts) + n)).cast("long")))
    missing = [F.when(a == 0, _failure("ConstNotFound", F.lit(k))) for k, a in enumerate(anchors)]
    if check_adjacent:
        for k in range(1, len(consts)):
            if not any(before == k for before, _ in construct.rands):
                failures.append(F.when(whole & (anchors[k] != ends[k - 1]), _failure("AdjacentGap", F.lit(k))))
    if strict and not construct.starts_open:
        failures.append(F.when(whole & (lead > 0), _failure("LeadingGap", lead)))
    if strict and not construct.ends_open:
        failures.append(F.when(whole & (trail > 0), _failure("TrailingGap", trail)))
    region_type = "array<struct<start:int,length:int,in_range:boolean>>"
    matches = F.array(
        *[F.when(a > 0, F.struct((a - 1).alias("position"), F.lit(len(c)).alias("length"))) for a, c in zip(anchors, consts, strict=True)]
    )
    tried = sum((F.when(a.isNotNull(), 1).otherwise(0) for a in anchors[1:]), F.lit(1))
    mask = F.lit(0).cast("long")
    for k, a in enumerate(anchors):
        mask = mask.bitwiseOR(F.when(a > 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    for b in bits:
        mask = mask.bitwiseOR(F.coalesce(b, F.lit(0).cast("long")))
    none = F.lit(None).cast("struct<kind:string,arg:int>")
    df = df.withColumns(
        {
            "const_matches": F.slice(matches, 1, tried),
            "rand_regions": F.when(whole, F.array(*regions) if regions else F.array().cast(region_type)).otherwise(F.array().cast(region_type)),
            "leading_gap": F.when(whole, lead).otherwise(0).cast("int"),
            "trailing_gap": F.when(whole, trail).otherwise(0).cast("int"),
            "failure": F.coalesce(*missing, *failures, none),
            "mask": mask,
        }
    )
    return df.withColumn("matched", F.col("failure").isNull() & F.col(sequence).isNotNull())


def _failure(kind: str, arg: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), arg.cast("int").alias("arg"))


def near_miss(df: DataFrame, construct: Construct, depth: int = 3, sequence: str = "sequence") -> DataFrame:
    """Add _b0..: the near-miss bucket of the one constant that was not found; no column work at depth 0."""
    for k, c in enumerate(construct.consts):
        if not depth:
            df = df.withColumn(f"_b{k}", F.lit(None).cast("int"))
            continue
        # The distance is a projection of its own: its bucket reads it three times. Only missed reads are compared.
        df = df.withColumn(f"_d{k}", min_hamming(F.when(F.col(_anchor(k)) == 0, F.upper(F.col(sequence))), c))
        df = df.withColumn(f"_b{k}", near_miss_bucket(F.col(f"_d{k}"), depth)).drop(f"_d{k}")
    return df


def valid(df: DataFrame) -> DataFrame:
    return fenced_filter(df, F.col("matched"))


def random_region(sequence: str = "sequence") -> Column:
    """The first random region of an annotated read."""
    r = F.get("rand_regions", F.lit(0))
    return F.when(F.col("matched") & r.isNotNull(), F.substring(F.col(sequence), r["start"] + 1, r["length"]))
