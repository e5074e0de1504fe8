"""Incremental ingest of delimited files: each new file once, appended to a Parquet table or to a dataset of a store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store, as_schema, widened
from ..sources import delimited, readers


def follow_csv(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, sep: str = ",") -> StreamingQuery:
    """Files that arrive in ``folder`` as appended rows of ``table``; stops when all present files are in."""
    stream = spark.readStream.schema(schema).option("header", True).option("sep", sep).csv(folder)
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Follower:
    """Delimited files that arrive in a folder, as a dataset of a store.

    A batch is a number of new files. Its types are taken from all of its rows, and the dataset's columns widen where they
    must; records with more values than their header are kept aside, in ``aside-...`` tables beside the dataset, and counted.
    The batch's number is part of the dataset's commit, so a batch that is repeated after a failure comes in once.
    """

    ASIDE = "_aside"

    def __init__(self, store: Store, folder: str, ds: str, files_at_once: int = 1000):
        self.store, self.folder, self.ds, self.files_at_once = store, folder.rstrip("/"), ds, files_at_once
        self.stream = hashlib.sha256(f"{self.folder}|{ds}".encode()).hexdigest()[:12]

    def rows(self, paths: list[str]) -> DataFrame:
        """The records of some files, those of one layout together, and what is kept aside."""
        spark = self.store.spark
        layouts: dict[delimited.Layout, list[str]] = {}
        for path in sorted(paths):
            if readers.has_text(spark, path):
                layouts.setdefault(readers.layout_of(spark, path), []).append(path)
        frames = [delimited.read(spark, some, layout, aside=self.ASIDE) for layout, some in layouts.items()]
        if not frames:
            return None
        whole = frames[0].schema
        for df in frames[1:]:
            whole = widened(whole, df.schema)
        out = as_schema(frames[0], whole)
        for df in frames[1:]:
            out = out.unionByName(as_schema(df, whole))
        return out

    def take(self, files: DataFrame, number: int) -> None:
        """One batch of the stream: a frame of paths, at most ``files_at_once``."""
        paths = [r["path"] for r in files.select("path").collect()]
        if not paths or self.store.meta(self.ds).get("batches", {}).get(self.stream, -1) >= number:
            return
        rows = self.rows(paths)
        if rows is None:
            return
        aside = F.col(self.ASIDE)
        seen = Observation()
        kept = f"{self.store.folder(self.ds)}/aside-{self.stream}-{number}.parquet"
        rows.observe(seen, F.count(aside).alias("n")).where(aside.isNotNull()).select(aside.alias("record")).write.mode("overwrite").parquet(kept)
        n = seen.get["n"]
        if not n:
            self.store.files.delete(kept)
        self.store.append(self.ds, rows.where(aside.isNull()).drop(self.ASIDE), f"batch {number}: {len(paths)} files, {n} records aside", (self.stream, number))

    def start(self, checkpoint: str) -> StreamingQuery:
        """A query that takes all files that are there and then stops; run again with the same checkpoint it takes new ones only."""
        spark = self.store.spark
        names = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", self.files_at_once).schema("path string, modificationTime timestamp, length long, content binary").load(self.folder).select("path")
        return names.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
