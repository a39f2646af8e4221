"""Readers for FASTA and FASTQ files, plain or gzipped, on Spark's own file sources, so any store that it reaches will do.

read_reads streams rows through the text source: plain files are split, gzipped ones are one task each, and neither is held in
memory. FASTQ has four lines a record, and a quality line may begin with "@" or "+", so records are found by counting lines. A gzipped
file is read once, from its start. In plain ones a first pass counts the lines of each block and notes its first and last three, the sums
tell on which line of a record each block begins, and in a second pass each task puts its block's records together. Records that blocks
share are made of the noted lines. FASTA records are cut at line feed and ">" by the source itself; their sequences may span lines.

read_fastx loads each file whole (as one row of the binary source, up to 2 GB); it reads gzipped files of any name and files that mix formats.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.shared import first_bytes
from seqloom.shipping import ship

#: Suffixes taken off a file's stem, tried in this order, one at most.
SUFFIXES = (".fastq.gz", ".fq.gz", ".fasta.gz", ".fa.gz", ".fastq", ".fq", ".fasta", ".fa")
SCHEMA = "sample string, id string, sequence string, quality string"
BATCH = 5000


class FastxError(ValueError):
    """A malformed record; the file and the place are in the message."""


def sample_name(path: str) -> str:
    """The file's stem without its last extension, less one sequence suffix."""
    name = os.path.splitext(os.path.basename(path))[0]
    for s in SUFFIXES:
        if name.endswith(s):
            return name[: -len(s)]
    return name


def parse(lines: Iterator[str], where: str = "input") -> Iterator[tuple[str, str, str | None]]:
    """Records of id (the whole header line), sequence and quality. An empty input has none."""
    lines = iter(lines)
    first = next((x for x in lines if x.strip()), None)
    while first is not None:
        if first[0] == "@":
            rest = [next(lines, None) for _ in range(3)]
            if rest[2] is None or not rest[1].startswith("+") or len(rest[0].rstrip("\r")) != len(rest[2].rstrip("\r")):
                raise FastxError(f"{where}: malformed record {first!r}")
            yield first[1:].rstrip("\r"), rest[0].rstrip("\r"), rest[2].rstrip("\r")
            first = next((x for x in lines if x.strip()), None)
        elif first[0] == ">":
            parts, header, first = [], first[1:].rstrip("\r"), None
            for x in lines:
                if x.startswith(">"):
                    first = x
                    break
                parts.append(x.rstrip("\r"))
            yield header, "".join(parts), None
        else:
            raise FastxError(f"{where}: a record starts with {first[:20]!r}")


def _lines(data: bytes) -> Iterator[str]:
    """Lines of a plain or gzipped file, unpacked piece by piece."""
    import gzip
    import io

    raw = io.BytesIO(data)
    stream = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
    return (x.rstrip("\n") for x in io.TextIOWrapper(stream, "utf-8", newline="\n"))


def read_fastx(spark: SparkSession, *paths: str, mode: str = "FAILFAST", partitions: int | None = None) -> DataFrame:
    """One row per record: sample, id, sequence, quality (null for FASTA).

    A file is read by one task, as its packing doesn't split; give partitions to spread few large files.
    mode PERMISSIVE leaves out what follows a malformed record of its file and says so in the task's log, FAILFAST fails the query.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ("sample", "id", "sequence", "quality"), [pa.string()] * 4
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, sample = [], sample_name(path)
                try:
                    for record in parse(_lines(data.as_py()), path):
                        rows.append((sample, *record))
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                except FastxError as e:
                    if mode != "PERMISSIVE":
                        raise
                    logging.getLogger("seqloom").warning("left out the rest of a file: %s", e)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    out = spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, SCHEMA)
    return out.repartition(partitions) if partitions else out


def check_samples(paths: list[str]) -> None:
    """Two inputs of one name would share an output."""
    names = [sample_name(p) for p in paths]
    if len(set(names)) < len(names):
        raise ValueError(f"inputs share a sample name: {sorted(n for n in set(names) if names.count(n) > 1)}")


def read_fasta_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """FASTA through the text source, which splits large plain files: records are cut at line feed and '>'."""
    rows = spark.read.option("lineSep", "\n>").text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    body = F.regexp_replace("value", "^>", "")
    head = F.substring_index(body, "\n", 1)
    rest = F.regexp_replace(F.substring(body, F.length(head) + 1, F.length(body)), "[\r\n]", "")
    return rows.filter(F.length(F.trim("value")) > 0).select("path", F.rtrim(head).alias("id"), rest.alias("sequence"), F.lit(None).cast("string").alias("quality"))


def _record(lines: list[str], where: str) -> tuple[str, str, str] | None:
    """A record of four lines; None for blank lines at the end of a file."""
    if not any(x.strip() for x in lines):
        return None
    if len(lines) == 3 and lines[2] == "+":
        # The source drops a cut at the very end of a file: the quality of one base, "+", without a line feed.
        lines = [*lines, "+"]
    if len(lines) < 4 or not lines[0].startswith("@") or not lines[2].startswith("+") or len(lines[1]) != len(lines[3]):
        raise FastxError(f"{where}: malformed record {lines[0]!r}")
    return lines[0][1:], lines[1], lines[3]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """path, block, low and high of each run of rows of one block; path and block are the first columns."""
    if batch.num_rows:
        path, block = batch.column(0), batch.column(1)
        new = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield path[low].as_py(), block[low].as_py(), low, high


def _split(rows: pa.Array, first: bool) -> tuple[pa.Array, np.ndarray]:
    """The lines of rows that were cut at line feed and "+", and which of them lost a "+"; a file's first row lost none."""
    rows.validate(full=True)
    parts = pc.split_pattern(rows, "\n")
    bare = np.zeros(len(parts.values), bool)
    bare[parts.offsets.to_numpy()[first:-1]] = True
    return pc.ascii_rtrim(parts.values, "\r"), bare


def _restored(lines: pa.Array, bare: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(bare), pc.binary_join_element_wise("+", lines, ""), lines) if bare.any() else lines


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: how many lines it has, its first three and its last three."""
    found: dict[tuple[str, int], tuple[int, list[str], list[str]]] = {}
    for batch in batches:
        for path, block, low, high in _runs(batch):
            n, first, last = found.get((path, block), (0, [], []))
            rows, new = batch.column(2)[low:high], block == 0 and n == 0
            # Three rows have three lines at least.
            head, tail = _restored(*_split(rows[:3], new)), _restored(*_split(rows[-3:], new and len(rows) <= 3))
            first = (first + head[:3].to_pylist())[:3]
            last = (last + tail[-3:].to_pylist())[-3:]
            found[path, block] = (n + len(rows) + pc.sum(pc.count_substring(rows, "\n")).as_py(), first, last)
    rows = [(path, block, *x) for (path, block), x in found.items()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ("path", "block", "n", "head", "tail"))


def _checked(lines: list[str], where: str, mode: str) -> tuple[str, str, str] | None:
    try:
        return _record(lines, where)
    except FastxError as e:
        if mode != "PERMISSIVE":
            raise
        logging.getLogger("seqloom").warning("left out: %s", e)
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ("path", "id", "sequence", "quality"))


def _whole(lines: pa.Array, bare: np.ndarray, path: str, mode: str) -> pa.RecordBatch:
    """The records of lines, four each, checked as _record does it."""
    at = np.arange(0, len(lines), 4)
    head = lines.take(pa.array(at))
    sequence, quality = (_restored(lines.take(pa.array(at + k)), bare[at + k]) for k in (1, 3))
    good = pc.and_(pc.starts_with(head, "@"), pc.equal(pc.utf8_length(sequence), pc.utf8_length(quality)))
    good = pc.and_(good, pa.array(bare[at + 2] & ~bare[at]))
    head = pc.utf8_slice_codeunits(head, 1)
    out = pa.RecordBatch.from_arrays([pa.repeat(path, len(at)), head, sequence, quality], ("path", "id", "sequence", "quality"))
    bad = np.flatnonzero(~good.to_numpy(zero_copy_only=False))
    for k in bad.tolist():
        _checked(_restored(lines[4 * k : 4 * k + 4], bare[4 * k : 4 * k + 4]).to_pylist(), path, mode)
    return out.filter(good) if len(bad) else out


def _records(batches: Iterator[pa.RecordBatch], mode: str, rest: bool) -> Iterator[pa.RecordBatch]:
    """The records of blocks, from rows of path, block, number of the block's first line and text.

    With rest, what is left at the end of a block is a record too; else the edges have it, as they have the lines of a record begun before.
    """
    here, number, held = None, 0, (pa.array([], pa.string()), np.zeros(0, bool))

    def last() -> Iterator[pa.RecordBatch]:
        if rest and len(held[0]) and (r := _checked(_restored(*held).to_pylist(), here[0], mode)):
            yield _batch([(here[0], *r)])

    for batch in batches:
        for path, block, low, high in _runs(batch):
            new = here != (path, block)
            if new:
                yield from last()
                here, number, held = (path, block), batch.column(2)[low].as_py(), (held[0][:0], held[1][:0])
            lines, bare = _split(batch.column(3)[low:high], new and block == 0)
            skip = min(-number % 4, len(lines)) if not len(held[0]) else 0
            number += len(lines)
            lines, bare = pa.concat_arrays([held[0], lines[skip:]]), np.concatenate([held[1], bare[skip:]])
            whole = len(lines) - len(lines) % 4
            held = (lines[whole:], bare[whole:])
            if whole:
                yield _whole(lines[:whole], bare[:whole], path, mode)
    yield from last()


def read_fastq_lines(spark: SparkSession, *paths: str, mode: str = "FAILFAST") -> DataFrame:
    """path, id, sequence, quality of FASTQ files with four lines a record and no blank lines but at the end.

    Gzipped files (.gz) are read once, plain ones twice. mode PERMISSIVE leaves malformed records out and says so in the task's log,
    FAILFAST fails the query.
    """
    ship(spark)
    schema = "path string, id string, sequence string, quality string"
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    # Cut at line feed and "+", a row has the lines from one record's third to the next one's second, or fewer where qualities begin with "+".
    text = spark.read.option("lineSep", "\n+").text(list(paths))
    packed = F.col("_metadata.file_path").endswith(".gz")
    kinds = {x.endswith(".gz") for x in text.inputFiles()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(batches, mode, False)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _records(batches, mode, True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(p, *r) for p, x in parts if (r := _checked([y["line"] for y in sorted(x, key=lambda y: y["at"])], p, mode))]
            if rows:
                yield _batch(rows)

    # A gzipped file is one block, so its lines are counted as they come.
    streamed = text.filter(packed).select(*block, F.lit(0).cast("long").alias("first"), "value").mapInArrow(stream, schema)
    if kinds == {True}:
        return streamed
    rows = text.filter(~packed).select(*block, "value")
    edges = rows.mapInArrow(_edges, "path string, block long, n long, head array<string>, tail array<string>")
    # This filter and the next hold for every row. With them both uses of starts need the same rows and columns of the exchange, so they
    # share it and the files are counted once.
    edges = edges.filter(F.col("path").isNotNull() & ~F.col("path").endswith(".gz"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = edges.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.size("head") > 0) & (F.size("tail") > 0))
    # A row for each block of a file: some bytes for every 128 MB read, so it goes to all tasks.
    placed = rows.join(F.broadcast(starts.select("path", "block", "first")), ["path", "block"]).select("path", "block", "first", "value")
    end = F.col("first") + F.col("n")
    # A block's lines that belong to a record which an earlier block began, or which a later one ends.
    head = F.transform("head", lambda x, i: F.struct((F.col("first") + i).alias("at"), x.alias("line")))
    tail = F.transform("tail", lambda x, i: F.struct((end - F.size("tail") + i).alias("at"), x.alias("line")))
    head = F.filter(head, lambda x: (F.col("first") % 4 != 0) & (F.floor(x["at"] / 4) == F.floor(F.col("first") / 4)))
    tail = F.filter(tail, lambda x: (end % 4 != 0) & (F.floor(x["at"] / 4) == F.floor(end / 4)))
    shared = starts.select("path", F.explode(F.array_distinct(F.concat(head, tail))).alias("x"))
    shared = shared.groupBy("path", F.floor(F.col("x.at") / 4)).agg(F.collect_list("x").alias("lines")).select("path", "lines")
    plain = placed.mapInArrow(run, schema).unionByName(shared.mapInArrow(join, schema))
    return plain.unionByName(streamed) if True in kinds else plain


def read_reads(spark: SparkSession, *paths: str, mode: str = "FAILFAST") -> DataFrame:
    """sample, id, sequence, quality of FASTA and FASTQ files, plain or gzipped, as streams of lines.

    A file's first byte tells its format. Files gzipped under another name are read whole by read_fastx.
    """
    kinds: dict[str, list[str]] = {"@": [], ">": [], "": []}
    for path in paths:
        packed = path.endswith(".gz")
        head = (spark.read.text(path).limit(1).collect() or [None])[0] if packed else first_bytes(spark, path)
        first = head.value[:1] if packed and head else "" if packed else head[:1].decode("latin-1")
        kinds[first if first in kinds else ""].append(path)
    out = None
    for kind, some in kinds.items():
        if some:
            df = read_fastq_lines(spark, *some, mode=mode) if kind == "@" else read_fasta_lines(spark, *some) if kind == ">" else None
            df = read_fastx(spark, *some, mode=mode) if df is None else _sampled(df)
            out = df if out is None else out.unionByName(df)
    return out


def _sampled(df: DataFrame) -> DataFrame:
    """The file's sample name instead of its path."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    name = F.regexp_replace(name, "(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$", "")
    return df.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("sample"), "id", "sequence", "quality")
