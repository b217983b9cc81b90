"""Event-time windows over streams, with watermarks; and running a stream to the end of its input."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.sources.tables import shared_dir


def source(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema that it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    """With a watermark, which needs a time stamp with zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if delay else df


def tumbling(df: DataFrame, ts: str, width: str, by: Sequence[str] = (), value: str | None = None, delay: str | None = None) -> DataFrame:
    return sliding(df, ts, width, None, by, value, delay)


def sliding(df: DataFrame, ts: str, width: str, slide: str | None, by: Sequence[str] = (), value: str | None = None, delay: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return late(df, ts, delay).groupBy(F.window(ts, width, slide).alias("w"), *by).agg(*aggs).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *(["total"] if value else []))


def sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str], delay: str | None = "1 day") -> DataFrame:
    """Runs of rows of a key that lie less than ``gap`` apart."""
    return late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(df: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """First rows of each key; within the watermark's delay if one is given, so that state is bounded."""
    return late(df, ts, delay).dropDuplicatesWithinWatermark(list(keys)) if ts and delay else df.select(*keys).dropDuplicates(list(keys))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream gives for the input that is there now.

    Batches go to Parquet in the shared folder, a folder each; in complete mode
    the last one holds the result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = {"k": -1}

    def keep(batch: DataFrame, k: int) -> None:
        last["k"] = max(last["k"], k)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    if last["k"] < 0:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{base}/out/batch={last['k']}") if mode == "complete" else rows.option("basePath", f"{base}/out").parquet(f"{base}/out").drop("batch")
