"""Incremental ingest: files of records as a stream, chunks emitted when they are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources import records


def classified_stream(spark: SparkSession, path: str, most: int = records.MOST) -> DataFrame:
    """Record lines of new files as they arrive, classified."""
    lines = spark.readStream.schema(records.SCHEMA).option("recursiveFileLookup", True).json(path)
    shape = records.classify(F.col("raw"), F.col("meta.status"), most)
    return lines.select(shape.alias("class"), F.col("raw").alias("text"))


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """All new files of a folder to out/class=..., each once: where it stopped is in the checkpoint."""
    query = classified_stream(spark, source).writeStream.partitionBy("class").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def store_stream(results: DataFrame, path: str, buffer: str, checkpoint: str, size: int = store.SIZE):
    """Results (seq_id, ...) as they come: rows wait in the buffer table, and a chunk is written once all its sequences are there."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("chunk_id", store.chunk_id(size=size)).write.mode("append").parquet(buffer)
        waiting = spark.read.parquet(buffer).dropDuplicates(["seq_id"])
        full = waiting.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") == size)
        touched = batch.select(store.chunk_id(size=size).alias("chunk_id")).distinct()
        ready = full.join(touched, "chunk_id", "left_semi").select("chunk_id")
        store.write(waiting.join(ready, "chunk_id", "left_semi").drop("chunk_id"), path, size)

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush(spark: SparkSession, path: str, buffer: str, size: int = store.SIZE) -> None:
    """Writes the chunks that never became complete."""
    waiting = spark.read.parquet(buffer).dropDuplicates(["seq_id"])
    part = waiting.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") < size).select("chunk_id")
    store.write(waiting.join(part, "chunk_id", "left_semi").drop("chunk_id"), path, size)
