"""The text pipeline: each stage takes the documents that its predecessor kept, the last returns their tokens.

All stages take the columns of documents and leave out any others. No stage fails on null or repeated doc_ids, on tables
without rows, or on texts of any length; what each does with them is said below. lang, source and n_chars may be null anywhere: they are carried,
never read, and n_chars is counted anew where a text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from seqloom.llm.common import durable, fenced_filter, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go.

    A null or empty text has no words and goes. Repeated rows are judged alike and all stay or all go; limits are strict, so a document that
    just meets one stays. An empty table stays empty.
    """
    book = quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS)))
    return fenced_filter(book, F.col("kept")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go; a document that loses all of its lines goes.

    A null text is one empty line, which is never dropped: it stays as an empty text. Repeated rows count as documents of their own. A line that
    is in exactly as many documents as the limit goes. An empty table stays empty.
    """
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = found.filter(F.col("n_dropped") < F.col("n_lines")).drop("text").withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that with the smallest doc_id.

    Null, empty and wordless texts are copies of each other. Documents without an id come last, ties are broken by hashes of the text, and of
    rows with equal ids and texts one stays. An empty table stays empty.
    """
    return simhash.keep_representatives(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go.

    A null or empty text holds none and stays. Repeated rows all stay or all go. Without items every document stays; an empty table stays empty.
    """
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return fenced_filter(found, F.col("n_hit") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens and the digests of ids and decoded tokens.

    A null or empty text has no tokens and the digests of nothing. Repeated rows give equal rows, an empty table an empty result.
    """
    found = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("bpe", tokens),
]
#: SQL has neither the hashes of the third stage nor the merges of the last; tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
