"""An extension: files or events as they arrive. Each file is a row, repeats within the watermark drop out, totals are kept by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, root: str, delay: str = "1 hour") -> DataFrame:
    """path, modified, size and sha256 of new files below root; the same content within the delay counts once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["sha256"])


def windowed_totals(events: DataFrame, time: str, by: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window; rows later than late after the newest are dropped. Works on streams and on tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")
