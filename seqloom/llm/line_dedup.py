"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of h, the hash of a line's key, and n, in how many documents it has been seen so far, dealt to a fixed number of
buckets by h and sorted by h within each. A new batch is merge-joined with the runs, bucket by bucket, without moving or
sorting them: keys that a run has settled (min_docs documents or more) are left out, the others are added up and become the batch's
own run of level 0. Two runs of a level are merged into one of the next, so there are as many runs as the number of
batches has binary digits. Keys are settled in the run of the batch that brings them to min_docs, and in no later one.

The runs live in a folder with a manifest of levels, paths and counts; LineRuns.open takes up work where an earlier
application left it. A new manifest is written beside the old one and then given its name, so a lost driver leaves the last state.

A line's key is the line without white space at both ends, A-Z lower-cased. A hash of 128 bits stands for it.

Defined results: a null or empty text is one empty line and stays empty; keys shorter than min_chars are
never dropped; a key repeated within a document counts once for it; repeated rows are documents of their own,
whatever their doc_id. Texts of any length are split whole. An empty table gives an empty result. Input columns named like a
result column are replaced, columns of other names pass through.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import LOWER, SPACES, UPPER, durable, map_text, remove, scratch, unused

#: More settled keys than this are joined by a shuffle instead of being sent to every task (some 100 bytes each there).
BROADCAST_KEYS = 500_000
#: Above that, each settled key is repeated so many times, and its lines are dealt to as many tasks.
SALT = 16
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
FIELDS = [
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_dropped", T.LongType()),
    T.StructField("kept_text", T.StringType()),
]


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for a key that is too short to count."""
    keys = [x.strip(SPACES) for x in (text or "").split("\n")]
    digest = xxhash.xxh3_128_digest
    return [digest(k.encode().translate(LOWERED)) if len(k) >= min_chars else None for k in keys]


def _hashed(docs: DataFrame, min_chars: int, text: str, name: str = "_hashes") -> DataFrame:
    """The rows with the hashes of their lines in order."""
    return map_text(docs, lambda: lambda t: (line_hashes(t, min_chars),), [T.StructField(name, T.ArrayType(T.BinaryType()))], text)


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings for the jobs inside."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineRuns:
    """The store. Make one with create, or take up an earlier one with open; add batches; read settled()."""

    def __init__(self, spark: SparkSession, path: str, min_docs: int, min_chars: int, buckets: int, batches: int = 0, version: int = 0) -> None:
        self.spark, self.path = spark, path
        self.min_docs, self.min_chars, self.buckets = min_docs, min_chars, buckets
        self.batches, self.version = batches, version
        #: By level: the run's name and its rows, or None. Its table is the folder of that name.
        self.levels: list[tuple[str, int] | None] = []
        self.tables: dict[str, str] = {}
        #: Counted batches: their tables and folders.
        self.counts: dict[str, str] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, min_docs: int = 10, min_chars: int = 1, buckets: int | None = None) -> LineRuns:
        """buckets: as many tasks as the largest run needs; the session's shuffle partitions if not given."""
        out = cls(spark, path, min_docs, min_chars, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        out._save()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            raise FileNotFoundError(f"{path} holds no manifest")
        state = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest-{versions[-1]}.json").collect()))
        out = cls(spark, path, state["min_docs"], state["min_chars"], state["buckets"], state["batches"], versions[-1])
        out.levels = [tuple(x) if x else None for x in state["levels"]]
        return out

    def _save(self) -> None:
        """Write the next manifest; it counts from the moment it has its name."""
        state = {k: getattr(self, k) for k in ("min_docs", "min_chars", "buckets", "batches", "levels")}
        self.version += 1
        jvm = self.spark._jvm.org.apache.hadoop.fs
        name, made = jvm.Path(f"{self.path}/manifest-{self.version}.json"), jvm.Path(f"{self.path}/_manifest-{uuid.uuid4().hex}")
        files = name.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = files.create(made, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not files.rename(made, name):
            raise FileExistsError(f"{name.toString()}: another writer works on these runs")

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table, so that joins on h need no exchange."""
        if run not in self.tables:
            self.tables[run] = f"seqloom_run_{uuid.uuid4().hex}"
            self.spark.sql(
                f"create table {self.tables[run]} (h binary, n bigint) using parquet clustered by (h) sorted by (h) "
                f"into {self.buckets} buckets location '{self.path}/{run}'"
            )
        return self.spark.table(self.tables[run])

    def _write(self, df: DataFrame) -> tuple[str, int]:
        run, name = f"run-{uuid.uuid4().hex}", f"seqloom_run_{uuid.uuid4().hex}"
        with self._merging():
            df.select("h", "n").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.path}/{run}").saveAsTable(name)
        self.tables[run] = name
        return run, self.spark.table(name).count()

    def _merging(self):
        """One task for each bucket, and sorted files read as sorted."""
        return _set(self.spark, **{"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"})

    def runs(self) -> list[DataFrame]:
        return [self._table(x[0]) for x in self.levels if x]

    def counted(self, docs: DataFrame, n: int = 1, text: str = "text") -> list[DataFrame]:
        """The keys of a table, dealt to n batches by a hash of the text: a bucketed table of h, n for each, from one scan and one shuffle."""
        place, hashes = unused(docs.select(text), "_batch", "_hashes")
        rows = _hashed(docs.select(text, F.pmod(F.xxhash64(text), F.lit(n)).alias(place)), self.min_chars, text, hashes)
        rows = rows.select(F.col(place).alias("batch"), F.explode(F.array_distinct(hashes)).alias("h")).filter(F.col("h").isNotNull())
        counts = rows.groupBy("h").agg(*[F.count_if(F.col("batch") == b).alias(f"n{b}") for b in range(n)])
        path, name = scratch(self.spark, "line-batches"), f"seqloom_batch_{uuid.uuid4().hex}"
        with self._merging():
            counts.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", path).saveAsTable(name)
        self.counts[name] = path
        table = self.spark.table(name)
        return [table.filter(F.col(f"n{b}") > 0).select("h", F.col(f"n{b}").alias("n")) for b in range(n)]

    def probe(self, batch: DataFrame) -> DataFrame:
        """The batch's keys that no run has settled, with the documents they have been seen in so far."""
        for k, run in enumerate(self.runs()):
            seen = run.select("h", F.col("n").alias(f"n{k}")).hint("merge")
            batch = batch.join(seen, "h", "left")
            # An older run has the smaller count of a key that a newer one holds too.
            batch = batch.withColumn("before", F.greatest("before", F.coalesce(f"n{k}", F.lit(0))) if k else F.coalesce(f"n{k}", F.lit(0))).drop(f"n{k}")
        if "before" not in batch.columns:
            return batch
        return batch.filter(F.col("before") < self.min_docs).select("h", (F.col("n") + F.col("before")).alias("n"))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch's keys with the runs and add the rest as a run of level 0; merge runs of one level."""
        with self._merging():
            run = self._write(self.probe(batch))
        level, done = 0, []
        while level < len(self.levels) and self.levels[level]:
            other = self.levels[level]
            a, b = self._table(run[0]), self._table(other[0]).hint("merge").withColumnRenamed("n", "m")
            done += [run[0], other[0]]
            merged = a.join(b, "h", "full").select("h", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("n"))
            run, self.levels[level] = self._write(merged), None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run
        self.batches += 1
        self._save()
        for old in done:
            self._drop(old)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"drop table if exists {self.tables.pop(run)}")
        remove(self.spark, f"{self.path}/{run}")

    def add_documents(self, docs: DataFrame, text: str = "text", batches: int = 1) -> None:
        """A batch of documents, or several of one table."""
        for batch in self.counted(docs, batches, text):
            self.add(batch)
        self._forget_counts()

    def _forget_counts(self) -> None:
        for name, path in self.counts.items():
            self.spark.sql(f"drop table if exists {name}")
            remove(self.spark, path)
        self.counts.clear()

    def close(self, delete: bool = False) -> None:
        """Take the runs out of the session's catalog; their files stay, for another open, unless delete is said."""
        self._forget_counts()
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()
        if delete:
            remove(self.spark, self.path)

    def settled(self) -> DataFrame:
        """Keys that min_docs documents or more hold. A key is settled in one run only, so nothing is to be merged."""
        out = self.spark.createDataFrame([], "h binary")
        for run in self.runs():
            out = out.unionByName(run.filter(F.col("n") >= self.min_docs).select("h"))
        return out


def _split(lines: list[str], gone: list[bool]) -> tuple:
    dropped = sum(gone)
    return len(lines), dropped, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)


def drop_lines(docs: DataFrame, keys: DataFrame, min_chars: int = 1, text: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Add n_lines, n_dropped and kept_text: the text without the lines whose keys (column h) are given."""
    keys = durable(keys, "settled")
    if keys.count() <= broadcast_keys:
        known = docs.sparkSession.sparkContext.broadcast({bytes(r.h) for r in keys.toLocalIterator()})

        def factory():
            gone = known.value

            def one(t: str | None) -> tuple:
                return _split((t or "").split("\n"), [h in gone for h in line_hashes(t, min_chars)])

            return one

        return map_text(docs, factory, FIELDS, text)
    # The rows are written with a number each: copies of a text then share no key. Hot lines are dealt out by the row's number.
    row, hashes, places = unused(docs, "_row", "_hashes", "_gone")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    lines = _hashed(numbered.select(row, text), min_chars, text, hashes).select(row, F.posexplode(hashes).alias("at", "h"))
    each = keys.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = lines.filter(F.col("h").isNotNull()).withColumn("salt", F.pmod(F.xxhash64(row), F.lit(SALT)).cast("int")).join(each, ["h", "salt"], "left_semi")
    gone = found.groupBy(row).agg(F.collect_list("at").alias(places))

    def by_place():
        def one(t: str | None, at: list[int] | None) -> tuple:
            lines, gone = (t or "").split("\n"), set(at or ())
            return _split(lines, [i in gone for i in range(len(lines))])

        return one

    return map_text(numbered.join(gone, row, "left"), by_place, FIELDS, text, places).drop(row, places)


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, text: str = "text", runs: LineRuns | None = None,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Add n_lines, n_dropped and kept_text to every document.

    Without runs, a table at rest goes into new ones as several batches, and a key counts over all of them. With the runs of an earlier
    table, the documents are one more batch, and keys of documents seen before count too.
    """
    own = runs is None
    if own:
        runs = LineRuns.create(docs.sparkSession, scratch(docs.sparkSession, "line-runs"), min_docs, min_chars)
    runs.add_documents(docs, text, batches if own else 1)
    out = drop_lines(docs, runs.settled(), runs.min_chars, text, broadcast_keys)
    if own:  # the settled keys are in a table of their own by now
        runs.close(delete=True)
    return out
