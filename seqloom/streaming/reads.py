"""The same operators on streams: files of reads in a folder, matched as they come and counted over all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions.reads import normalize
from seqloom.operators.matching import annotate

SCHEMA = "id string, sequence string, quality string"


def read_stream(spark: SparkSession, folder: str, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Reads of new Parquet or JSON files with id, sequence and quality."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def matched_stream(reads: DataFrame, construct: Construct, strict: bool = True) -> DataFrame:
    """Append mode: each read with its match."""
    return annotate(reads.withColumn("sequence", normalize(F.col("sequence"))), construct, strict)


def running_counts(reads: DataFrame) -> DataFrame:
    """Complete or update mode: how often each sequence has come so far."""
    return reads.groupBy("sequence").agg(F.count("*").alias("count"))


def running_combinations(matched: DataFrame) -> DataFrame:
    return matched.groupBy("mask").agg(F.count("*").alias("n"))
