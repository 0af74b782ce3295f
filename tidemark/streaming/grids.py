"""Structured Streaming over the grid accumulators.

The accumulators are sums and counts, so a stream of late files only ever adds to them; with a
watermark on the measuring time, windows close and can be appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.geo import lon_180
from tidemark.sources.granules import expert_scan


def read_pixel_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Pixel files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def streaming_grid(pixels: DataFrame, step: float = 1.0, late: str = "1 day", window: str | None = None) -> DataFrame:
    """Sums and counts of the corrected height per cell (and time window); repeated rows that arrive
    within the watermark count once."""
    once = pixels.withColumn("measured_at", F.col("measured_at").cast("timestamp")).withWatermark("measured_at", late).dropDuplicatesWithinWatermark(["obs_id"])
    h = expert_scan(once, other=["measured_at"]).where("abs(ssh) < 2.5 and latitude is not null and longitude is not null")
    keys = [F.floor(F.col("latitude") / step).cast("int").alias("ilat"), F.floor(lon_180(F.col("longitude")) / step).cast("int").alias("ilon")]
    if window:
        keys.insert(0, F.window("measured_at", window).alias("time"))
    return h.groupBy(*keys).agg(F.sum("ssh").alias("total"), F.count("*").alias("n"))


def write_grid(grid: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's updated cells replace the last ones in ``path``; the checkpoint folder must be shared."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return grid.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every cell over all batches."""
    df = spark.read.parquet(path)
    return df.groupBy("ilat", "ilon").agg(F.max_by(F.struct("total", "n"), "batch").alias("s")).select("ilat", "ilon", "s.total", "s.n")
