"""Tables as they are stored, and small ones dealt out to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes up to which a table may lie in a single row group, which one task would read and work through alone.
SMALL = 64 << 20


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if what it scans is SMALL: work on each of its rows is worth more than their exchange, whose
    size is bounded. Larger tables have row groups enough and stay as they are. The rows are the same either way."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
