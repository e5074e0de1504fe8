"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import row_numbers
from ..session import shared_dir

ARROW_BATCH_BYTES = "16m"
ARROW_BATCH_ROWS = "4096"


@contextlib.contextmanager
def _one_use(spark: SparkSession) -> Iterator[None]:
    """What is run here leaves its shuffle files to be removed at its end: its result is written, and its plan isn't run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held) if held is not None else spark.conf.unset(key)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame with a reliable, replicated checkpoint."""
    shared_dir(df.sparkSession)
    with _one_use(df.sparkSession):
        return df.select("*").checkpoint()


#: Paths of the tables that are stored in the surrounding ``tables()``.
_TABLES: contextvars.ContextVar[list | None] = contextvars.ContextVar("tables", default=None)


def _in_store(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own objects."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide frame as a compressed table in the shared folder and reread it.

    What is read from it may be worked out at any later time, so the table is there until the application ends, which removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _one_use(spark):
        df.write.option("compression", "zstd").parquet(path)
    store, place = _in_store(spark, path)
    store.deleteOnExit(place)
    if (held := _TABLES.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables() -> Iterator[list[str]]:
    """A list that takes the paths of the tables stored inside."""
    token = _TABLES.set([])
    try:
        yield _TABLES.get()
    finally:
        _TABLES.reset(token)


def keep_last(spark: SparkSession, written: list[str]) -> None:
    """Remove the tables of ``tables()`` but the last one, which was worked out from them."""
    for path in written[:-1]:
        store, place = _in_store(spark, path)
        store.delete(place, True)
    del written[:-1]


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small, so a worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def pieces(batches, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column`` (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def document_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra ones never clash with what an operator adds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


#: Values whose rows are met by broadcast, at most. A value with more than 1/HUBS of all rows is one of them.
HUBS = 50_000


def joined(rows: DataFrame, classes: DataFrame, on: list[str], n_rows: int) -> DataFrame:
    """``rows`` with the columns of ``classes``: one row for each value of ``on``, with ``k``, how many rows have it.

    The rows of a hot value aren't gathered: what it stands for is broadcast to where they are. There are fewer than
    ``HUBS`` such values, since each holds more than 1/HUBS of the rows; the rest meets by a shuffle.
    """
    limit = max(1024, n_rows // HUBS)
    hot = classes.where(F.col("k") > limit).drop("k").withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(hot), on, "left")
    rest = met.where("__hot is null").select(*rows.columns).join(classes.where(F.col("k") <= limit).drop("k"), on)
    return met.where("__hot").drop("__hot").unionByName(rest)


def _with_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """``u``, ``v`` of the rows with ``m``, the smallest ``v`` of the row's ``u``; minima are taken map-side first."""
    return joined(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), ["u"], n_rows)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two columns of one orderable type. Returns ``node`` and
    ``component`` (the smallest node reachable) for each node of an edge.
    Self links and nulls are ignored. Every round is two aggregations with
    map-side minima and two joins in which a hub's rows stay where they are. Rounds are cut with ``checkpoint``, so lost
    executors cost at most one round.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = cut(now)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = _with_least(both, 2 * mark[0]).where("v > u")
        large = met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        met = _with_least(large, mark[0])
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        now = cut(small.distinct())
        was, mark = mark, _mark(now)
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free digest of an edge set; equal marks mean that a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def named_by_first(classes: DataFrame, *tie: str) -> tuple[DataFrame, DataFrame | None]:
    """Classes (which have their smallest id, ``first``) with ``entry``, a long that orders them as their ids do, null last.

    Where every class has an id of its own that is the id itself, so a component's smallest entry is its smallest id. Else (ids
    that come with several classes, or none) classes are numbered, ``tie`` deciding; the second frame then has ``component`` with its ``first``.
    """
    if classes.groupBy("first").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or first is null").isEmpty():
        return classes.withColumn("entry", F.col("first")), None
    order = [F.col("first").isNull(), F.col("first"), *map(F.col, tie)]
    named = cut(row_numbers(classes, order, "entry"))
    return named, named.select(F.col("entry").alias("component"), F.col("first").alias("__first"))
