"""Incremental labelling and counts with Structured Streaming: available files are taken, state is in the checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import remove_at_exit, shared_dir


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over all files available now into a table in the shared folder, and reads that. Restarting with the same checkpoint
    folder continues after the last committed batch."""
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    else:

        def commit(batch: DataFrame, n: int) -> None:  # writing a batch again gives the same table
            batch.write.mode("overwrite").parquet(f"{path}/out")

        stream.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    remove_at_exit(spark, path)
    return spark.read.parquet(f"{path}/out")


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if _is_dir(spark, path) else f"{folder}/{name}*.parquet")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def new_digests(spark: SparkSession, folder: str, name: str, text_col: str) -> DataFrame:
    """Each text's digest once, however often and in whichever batch it comes; null texts are left out."""
    s = source(spark, folder, name).where(F.col(text_col).isNotNull()).select(F.md5(text_col).alias("digest")).dropDuplicates(["digest"])
    return drain(s, spark)


def windowed_counts(spark: SparkSession, folder: str, name: str, time_col: str, key: str, width: str = "1 day") -> DataFrame:
    """Counts by event-time window and key over the stream."""
    s = source(spark, folder, name).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n"))
    return drain(s.select(F.col("w.start").alias("day"), key, "n"), spark, "complete")
