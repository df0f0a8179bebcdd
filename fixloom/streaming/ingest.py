"""Raw entries from a folder that grows, checked and normalised, appended to a table exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fixloom.schema import ENTRY, conform


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A streaming DataFrame of conforming entries from JSON lines; rows that fail a check are left out."""
    raw = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return conform(raw)


def arrivals(entries: DataFrame, at: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """``window, src_dataset, n, n_vfc`` by event time, with late rows up to ``late`` behind."""
    rows = entries.withWatermark(at, late).withColumn("src_dataset", F.explode("src_datasets"))
    return rows.groupBy(F.window(at, width), "src_dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_vfc").cast("long")).alias("n_vfc"))


def append(entries: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes everything that is there now and stops; a later call goes on where this one ended."""
    return entries.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
