"""Exact dedup with a heavy-hitter split.

Texts are reduced to SHA-256 digests first, so no shuffle carries text.
Misra-Gries summaries, merged in a tree, name every digest that holds more than
1/(k+1) of all rows; their exact counts are then taken, and these at most ``k``
verified winners are broadcast so that the rows of a hot group are resolved
where they are read. The remaining digests, each below that share, shuffle.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, cut, document_rows, texts_of, unused

#: Counters of a summary: digests above 1/(COUNTERS + 1) of all rows are found for certain.
COUNTERS = 1024
#: Summaries merged by one task of a level.
FAN_IN = 32


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the SHA-256 of the text with A-Z lower-cased (``digest``) and of the text itself (``raw``); null counts as empty."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            found = [[hashlib.sha256(t).digest() for t in some] for some in (map(bytes.lower, texts), texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.binary()) for x in found]], names=["id", "digest", "raw"])

    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, digest binary, raw binary")


def _pruned(counts: dict, k: int) -> dict:
    """The Misra-Gries merge step: subtract the (k+1)-th largest counter from all."""
    if len(counts) <= k:
        return counts
    drop = sorted(counts.values(), reverse=True)[k]
    return {key: n - drop for key, n in counts.items() if n > drop}


def frequent_candidates(keyed: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """At most ``k`` values of the binary column ``key`` that include each one above 1/(k+1) of the rows."""

    def summarise(batches):
        counts: dict = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)):
                value = x["values"].as_py()
                if value is not None:
                    counts[value] = counts.get(value, 0) + x["counts"].as_py()
            counts = _pruned(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        left = _pruned(group.groupby("key")["n"].sum().to_dict(), k)
        return pd.DataFrame({"part": group["up"].iloc[:1].tolist() * len(left), "key": list(left), "n": list(left.values())})

    found = keyed.select(F.col(key)).mapInArrow(summarise, "key binary, n long").withColumn("part", F.spark_partition_id())
    for step in (FAN_IN, FAN_IN, 1 << 30):
        found = found.withColumn("up", (F.col("part") / step).cast("int")).groupBy("up").applyInPandas(merge, "part int, key binary, n long")
    return found.select("key")


def _resolved(rows: DataFrame, k: int) -> DataFrame:
    """The rows (``id``, ``digest`` and more) with ``keep_id`` and ``group_size``; those of hot digests stay where they are."""
    hot = rows.join(F.broadcast(frequent_candidates(rows, "digest", k)), rows.digest == F.col("key"), "left_semi")
    winners = cut(hot.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    same = Window.partitionBy("digest")
    rest = marked.where("group_size is null").select(*rows.columns, F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return marked.where("group_size is not null").select(*rows.columns, "keep_id", "group_size").unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased); the row with the largest id stays.

    Returns a row for each input row: the id, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``. Null texts count as empty. Rows that repeat an
    id and its text carry the same values; rows with a null id stay only in a
    group without any id. An empty table gives an empty result.
    """
    return _resolved(cut(digests(docs, id_col, text_col).select("id", "digest")), k).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """``docs`` without all but the kept row of each group; rows that repeat an id and its text leave one.

    A document is an id with its text: other texts of the same id, or of null ids, are documents of their own. Of texts
    of one id that differ in case only, that with the smallest SHA-256 stays.
    """
    key, keep, kept = unused(docs, "__key", "__keep", "__kept")
    rows = _resolved(cut(digests(docs, id_col, text_col)), k).where(F.col("id").eqNullSafe(F.col("keep_id")))
    stay = cut(rows.groupBy("id", "digest").agg(F.min("raw").alias(kept)).select(F.col("id").alias(keep), kept))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.withColumn(key, F.unhex(F.sha2(text, 256))).join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(keep)) & (F.col(key) == F.col(kept)), "left_semi")
    return found.dropDuplicates([id_col, key]).drop(key)
