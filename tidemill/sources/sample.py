"""A seeded table of invented boat rentals with missing cells and repeated rows, to try the engine on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HARBOURS, MODELS, GUIDES = 5, 4, 6
KINDS = ("kayak", "motor", "sail")
ROWS, NO_CHARGE, NO_HARBOUR, REPEATED = 360, 12, 8, 10


def make_sample(spark: SparkSession, rows: int = ROWS, seed: int = 42) -> DataFrame:
    """``rows`` rentals and ``REPEATED`` of them once more; ``NO_CHARGE`` charges and ``NO_HARBOUR`` harbours are missing. The same seed gives the same rows."""

    def draw(what: str, upto: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(upto))

    def chosen(what: str, n: int) -> set:
        """``n`` ids, drawn from the few that there are."""
        return {r[0] for r in spark.range(rows).orderBy(F.xxhash64(F.lit(seed), F.lit(what), "id")).limit(n).collect()}

    def unless(what: str, n: int, value):
        return F.when(~F.col("id").isin(chosen(what, n)), value)

    hourly, hours = F.round(8 + draw("rate", 9001) / 100, 2), draw("hours", 12) + 1
    charge = F.round(hourly * hours, 2)
    rentals = spark.range(rows).select(
        "id",
        F.format_string("R%06d", F.col("id") * 7 + 1000).alias("rental"),
        F.timestamp_add("DAY", draw("day", 730).cast("int"), F.lit("2023-04-01").cast("timestamp_ntz")).cast("date").cast("string").alias("day"),
        unless("harbour", NO_HARBOUR, F.concat(F.lit("Harbour "), F.char(65 + draw("port", HARBOURS)))).alias("harbour"),
        F.element_at(F.array(*map(F.lit, KINDS)), (draw("kind", len(KINDS)) + 1).cast("int")).alias("kind"),
        hourly.alias("hourly"),
        hours.alias("hours"),
        unless("charge", NO_CHARGE, charge).alias("charge"),
        F.round(charge * (10 + draw("deposit", 41)) / 100, 2).alias("deposit"),
        F.concat(F.lit("guide "), draw("guide", GUIDES) + 1).alias("guide"),
        draw("model", MODELS).alias("number"),
    )
    rentals = rentals.withColumn("model", F.concat("kind", F.lit(" "), F.col("number") + 1)).drop("number")
    again = rentals.where(F.col("id").isin(chosen("repeat", REPEATED)))
    every = rentals.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1)))
    return every.orderBy(F.xxhash64(F.lit(seed), "id", "copy")).drop("id", "copy")
