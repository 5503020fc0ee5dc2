"""Shared helpers: tables of the corpus, intermediate tables, keys of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BROADCAST_ROWS, discard, shared_dir, small
from ..shared import kept as stored

__all__ = ["BROADCAST_ROWS", "collected", "discard", "let", "released", "shared_dir", "shuffle_partitions", "small", "stored", "table", "text_key", "turn"]

_turn: tuple[str, Callable[[], None] | None] = ("", None)


def turn(operator: str, forget: Callable[[], None] | None = None) -> None:
    """A task's function calls this first. Python workers outlive a stage: where this one served another operator before,
    what that one remembers (its forget) goes, and freed memory goes back to the system."""
    global _turn
    if _turn[0] == operator:
        return
    if _turn[1]:
        _turn[1]()
    _turn = (operator, forget)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def released(spark: SparkSession) -> None:
    """Python workers that wait give back what the operators before remember: short tasks, several for each core, go round them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("")
        yield from batches

    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def collected(spark: SparkSession) -> None:
    """Executors collect their garbage, and so give heap that is free back to the system; no Python runs on them."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where a lambda inside body uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """struct<k1, k2> of two longs: the first 128 bits of a text's SHA-256 (null as the empty text), which stand for the text in joins and groups."""
    part = lambda hexed, at: F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")
    return let(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), lambda h: F.struct(part(h, 1).alias("k1"), part(h, 17).alias("k2")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
