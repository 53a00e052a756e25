"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and partition counts at run time; ANSI mode turns overflow and bad casts into errors.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lumenfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments are settings with dots written as double underscores."""
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


#: Arrow batches sent to Python hold at most this many rows and bytes: a worker's memory follows from them, whatever the size of its partition.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Arrow batches follow BATCH_ROWS and BATCH_BYTES from now on, unless the session has smaller ones."""
    spark = spark or SparkSession.active()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        value = int(now) if now and now.lstrip("-").isdigit() else 0
        if value <= 0 or value > most:
            spark.conf.set(key, str(most))
