"""What the text operators share: durable intermediate tables and Arrow row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.functions.reads import fenced_filter
from seqloom.shared import scratch, shared_dir
from seqloom.shipping import ship

__all__ = [
    "ascii_lower", "clear_scratch", "durable", "fenced_filter", "hot_keys", "map_rows", "map_text", "remove", "scratch", "shared_dir", "small_or_plain",
    "spread_join", "table", "unused",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word and line rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that still read them are void."""
    remove(spark, f"{shared_dir(spark)}/seqloom/{spark.sparkContext.applicationId}")


def unused(df: DataFrame, *names: str, beside: list[str] | None = None) -> list[str]:
    """Names for helper columns that no column of the frame has, nor any beside it."""
    taken = {c.lower() for c in [*df.columns, *(beside or [])]}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet into the shared folder and read it back.

    This cuts the lineage; a lost executor costs nothing, as the files outlive it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Frames of up to so many bytes may be sent to every task.
BROADCAST_BYTES = 32 << 20
#: A key with more than this share of the rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 500


def small_or_plain(df: DataFrame, size: Column, most: int | None = None) -> tuple[DataFrame, bool]:
    """The frame, marked for broadcast if its rows' sizes (bytes) add up to no more than the bound, and whether it is."""
    total = df.agg(F.coalesce(F.sum(size.cast("long") + 16), F.lit(0))).first()[0]
    fits = total <= (BROADCAST_BYTES if most is None else most)
    return (F.broadcast(df), True) if fits else (df, False)


def hot_keys(counts: DataFrame, key: list[str], n: str = "n", least: int = 200) -> DataFrame | None:
    """Keys with more than one in HOT_SHARE of all rows, and _parts, into how many parts to deal each; None if there is none.

    counts has one row for each key with its rows in column n; keys of up to ``least`` rows are never hot. Fewer than
    HOT_SHARE rows come out, so they may be broadcast.
    """
    most = max(least, (counts.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE)
    hot = counts.filter(F.col(n) > most).select(*key, F.ceil(F.col(n) / most).cast("int").alias("_parts"))
    hot = durable(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def spread_join(many: DataFrame, one: DataFrame, key: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join many rows a key with one row a key. Hot keys are dealt to several partitions: their row is repeated, their rows are dealt by place.

    Rows without a key, which a left join keeps, are dealt by place as well.
    """
    if hot is None and how != "left":
        return many.join(one, key, how)
    if hot is None:
        hot = one.limit(0).select(*key, F.lit(0).alias("_parts"))
    salt, parts = unused(many, "_salt", "_parts", beside=one.columns)
    hot = F.broadcast(hot.withColumnRenamed("_parts", parts))
    lost = F.when(F.array_contains(F.array(*[F.col(k).isNull() for k in key]), True), HOT_SHARE)
    place = F.monotonically_increasing_id() % F.coalesce(F.col(parts), lost, F.lit(1))
    left = many.join(hot, key, "left").withColumn(salt, place.cast("int")).drop(parts)
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    right = one.join(hot, key, "left").withColumn(salt, each).drop(parts)
    return left.join(right, [*key, salt], how).drop(salt)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def map_text(
    df: DataFrame, factory: Callable[[], Callable[..., tuple]], fields: list[T.StructField], *inputs: str
) -> DataFrame:
    """Add columns computed row by row from the input columns.

    factory runs once for each partition and returns a function from a row's inputs to the new values.
    """

    def by_rows() -> Callable[..., list]:
        f = factory()
        return lambda *columns: list(zip(*map(f, *columns), strict=True))

    return map_rows(df, by_rows, fields, *inputs)


def map_rows(
    df: DataFrame, factory: Callable[[], Callable[..., list]], fields: list[T.StructField], *inputs: str
) -> DataFrame:
    """Add columns computed from lists of the input columns' values, some hundred rows of an Arrow batch at a time.

    factory runs once for each partition and returns a function from the lists to the new columns.
    All other columns pass through untouched; an input column named like a new one is replaced.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    names = [c.lower() for c in df.columns]
    at = [names.index(c.lower()) for c in inputs]
    keep_at = [i for i, c in enumerate(names) if c not in new]
    kept = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name.lower() not in new]
    types = to_arrow_schema(T.StructType(fields))
    out_names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factory()
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                made = f(*[part.column(i).to_pylist() for i in at])
                columns = [part.column(i) for i in keep_at] + [pa.array(c, k.type) for c, k in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=out_names)

    return df.mapInArrow(run, T.StructType([*kept, *fields]))
