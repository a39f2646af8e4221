"""Column functions on reads."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(sequence: Column) -> Column:
    """Upper case, U as T, gaps as -, white space out, all other letters N."""
    dense = F.regexp_replace(sequence, "[ \t\r\n]", "")
    return F.regexp_replace(F.translate(dense, "acgtnuU.~", "ACGTNTT--"), "[^ACGTN-]", "N")


def min_hamming(sequence: Column, pattern: str) -> Column:
    """Fewest mismatches of the pattern against all windows; null for a null read or one shorter than the pattern.

    All reads of an Arrow batch are compared at once, one letter of the pattern at a time. Pass null for reads that don't matter: they cost nothing.
    """

    def fewest(reads: pd.Series) -> pd.Series:
        n = len(pattern)
        lengths = reads.str.len().fillna(0).astype("int64").to_numpy()
        some = np.flatnonzero(lengths >= n)
        out = pd.Series([None] * len(reads), dtype="Int32")
        if len(some):
            letters = np.frombuffer("".join(reads.iloc[some]).encode("utf-32-le"), "<u4")
            wrong = np.zeros(len(letters) - n + 1, "int32")
            for k, letter in enumerate(pattern):
                wrong += letters[k : len(letters) - n + 1 + k] != ord(letter)
            starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
            # Windows that reach into the next read count for neither.
            for k in range(1, n):
                wrong[starts[1:] - k] = n + 1
            out.iloc[some] = np.minimum.reduceat(wrong, starts)
        return out

    return F.pandas_udf(fewest, "int")(sequence)


def near_miss_bucket(distance: Column, depth: int) -> Column:
    """Bucket 0 to 3 for 1 to 4 and more mismatches within the depth; a distance of zero falls into the last."""
    return F.when(distance <= depth, F.when(distance == 0, 3).otherwise(F.least(distance - 1, F.lit(3))))


def mean_quality(quality: Column) -> Column:
    """Mean Phred score; null without a quality string."""
    scores = F.aggregate(F.split(quality, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c) - 33))
    return F.when(F.length(quality) > 0, scores / F.length(quality))


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100.0)


def rpm(count: Column, total: Column) -> Column:
    return count / total * 1000000.0


def two_decimals(value: Column) -> Column:
    """Two decimals, rounded by the exact binary value, true halves to even.

    A cast to decimal reads the shortest decimal of a double, which can be a half where the double is not. Less its whole
    part, which subtracts exactly, a double over 1 shows what it is; the doubles below 1 that look like halves are listed by rule.
    """
    ties = [Decimal(k).scaleb(-3) for k in range(5, 1000, 10)]
    low = [float(t) for t in ties if Decimal(float(t)) < t]
    high = [float(t) for t in ties if Decimal(float(t)) > t]
    whole = F.floor(value)
    part = value - whole
    part = F.when(part.isin(*low), part - 1e-9).when(part.isin(*high), part + 1e-9).otherwise(part)
    rounded = F.bround(part.cast("decimal(38,20)"), 2).cast("decimal(4,2)")
    return (whole.cast("decimal(34,2)") + rounded).cast("decimal(38,2)").cast("string")


def fenced_filter(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice: the optimizer leaves such a condition where it is."""
    fence = "_fence"
    while fence in df.columns:
        fence += "_"
    return df.withColumn(fence, F.monotonically_increasing_id()).filter(condition & (F.col(fence) >= 0)).drop(fence)
