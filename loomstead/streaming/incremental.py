"""Streams of event rows: windowed counts with a watermark, and loads that skip keys already there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.sources.readers import new_rows_only


def windowed_counts(stream: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n, value): counts and sums per tumbling window; rows later than the watermark are left to a batch run."""
    rows = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "value")


def append_new_keys(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str):
    """Append to a Parquet table the rows whose key it does not have; a batch that runs twice adds nothing the second time."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(keys))
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            fresh = new_rows_only(fresh, spark.read.schema(batch.schema).parquet(path), keys)
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
