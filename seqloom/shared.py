"""The folder that driver and executors share, and small files in any file system that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one.

    Only a single-machine session without that setting gets a temporary folder of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='seqloom-shared-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{shared_dir(spark)}/seqloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver through Spark's file systems; missing folders are made."""
    at, files = _files(spark, path)
    stream = files.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def first_bytes(spark: SparkSession, path: str, n: int = 2) -> bytes:
    """The first bytes of a file, or of the first of the files that a pattern or folder names."""
    at, files = _files(spark, path)
    found = files.globStatus(at) or []
    if not len(found):
        raise FileNotFoundError(path)
    first = found[0]
    if first.isDirectory():
        inside = [f for f in files.listStatus(first.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        if not inside:
            return b""
        first = inside[0]
    stream = files.open(first.getPath())
    try:
        out = []
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()
