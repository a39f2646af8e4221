"""Writers for counts and reads."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.construct import Construct
from seqloom.functions.reads import two_decimals
from seqloom.operators.counting import fasta_header, ranked
from seqloom.operators.matching import random_region
from seqloom.shared import write_text

FORMATS = ("parquet", "csv", "tsv", "fasta")
#: Suffixes of files of filtered reads.
READ_SUFFIXES = {"auto": "fq", "fasta": "fa", "fastq": "fq", "fastq.gz": "fq.gz"}
#: Records of a gzipped file at most. One task reads such a file, so larger outputs are more files.
GZIP_RECORDS = 1_000_000


def write_parquet(table: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """ZSTD Parquet; the metadata travels in the schema of the first column and in _facts.json beside the files."""
    facts = {f"seqloom.{k}": str(v) for k, v in (metadata or {}).items()}
    if facts:
        table = table.withMetadata(table.columns[0], facts)
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if facts:
        write_text(table.sparkSession, f"{path}/_facts.json", json.dumps(facts, indent=2))


def metadata(total: int, source: str, construct: Construct | None = None, version: str = "1") -> dict[str, str]:
    out = {"version": version, "input": source, "total_reads": str(total)}
    if construct is not None:
        out |= {"construct": json.dumps(construct.as_json()), "timestamp": str(int(time.time()))}
    return out


def write_delimited(table: DataFrame, path: str, sep: str = ",") -> None:
    rows = ranked(table).select("rank", "sequence", "count", two_decimals(F.col("rpm")).alias("rpm"))
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A table in its order, with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)


def write_fasta(table: DataFrame, path: str) -> None:
    fasta_header(ranked(table)).orderBy(F.desc("count"), "sequence").select("value").write.mode("overwrite").text(path)


def write_counts(table: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    if kind == "parquet":
        write_parquet(ranked(table), path, **options)
    elif kind in ("csv", "tsv"):
        write_delimited(table, path, "," if kind == "csv" else "\t")
    elif kind == "fasta":
        write_fasta(table, path)
    else:
        raise ValueError(f"unknown format {kind!r}; one of {FORMATS}")


def read_records(reads: DataFrame) -> DataFrame:
    """FASTQ text where there is a quality string, else FASTA text."""
    fastq = F.concat_ws("\n", F.concat(F.lit("@"), "id"), "sequence", F.lit("+"), "quality")
    fasta = F.concat_ws("\n", F.concat(F.lit(">"), "id"), "sequence")
    return reads.select(F.when(F.col("quality").isNotNull(), fastq).otherwise(fasta).alias("value"))


def write_reads(reads: DataFrame, path: str, kind: str = "auto") -> None:
    """kind: auto (as read_records), fasta, fastq or fastq.gz."""
    if kind == "fasta":
        reads = reads.withColumn("quality", F.lit(None).cast("string"))
    sink = read_records(reads).write.mode("overwrite")
    (sink.option("compression", "gzip").option("maxRecordsPerFile", GZIP_RECORDS) if kind == "fastq.gz" else sink).text(path)


def write_random_regions(matched: DataFrame, path: str) -> None:
    """The first random region of each matched read as FASTA; an empty region is an empty line."""
    rows = matched.select("id", random_region().alias("region")).filter(F.col("region").isNotNull())
    rows.select(F.concat(F.lit(">"), "id", F.lit("\n"), "region").alias("value")).write.mode("overwrite").text(path)
