"""Session defaults, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import InputError

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "tidemill", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map={**CONF, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names in ``spark.checkpoint.dir``.

    A temporary folder takes its place only where driver and executors are one process; on a cluster executors couldn't see it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith(("local[", "local*")) and context.master != "local":
            raise InputError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-checkpoint-"))
    return named or context.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lost executors cost no more than what follows it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
