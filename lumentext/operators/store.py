"""The chunked store: chunks of sequences as partitions, their manifest, gaps, integrity and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, kept, small
from ..sources.records import numbered

SIZE = 100


def chunk_id(seq_id: str | Column = "seq_id", size: int = SIZE) -> Column:
    return (F.floor((F.col(seq_id) if isinstance(seq_id, str) else seq_id) - 1) / size).cast("long") + 1


def manifest(results: DataFrame, size: int = SIZE) -> DataFrame:
    """chunk_id, range, counts and lengths; results: seq_id, n, and n_candidates where there are any."""
    given = "n_candidates" in results.columns
    found = F.col("n_candidates") if given else F.lit(0)
    return results.withColumn("chunk_id", chunk_id(size=size)).groupBy("chunk_id").agg(F.min("seq_id").alias("start_seq_id"), F.max("seq_id").alias("end_seq_id"), F.count("*").alias("sequence_count"), F.sum(found).alias("total_candidates"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.round(F.avg("n"), 6).alias("mean_length"))


def islands(ids: DataFrame, name: str = "seq_id") -> DataFrame:
    """start_id, end_id, n of runs of consecutive ids (ids: kept). An id without its predecessor starts a run, one without its successor ends it; both are numbered alike and meet, so no window holds all of them."""
    every = ids.select(F.col(name).alias("id")).distinct()
    lone = lambda step: every.join(every.select((F.col("id") + step).alias("id")), "id", "left_anti")
    starts, ends = numbered(lone(1), "id", "run").withColumnRenamed("id", "start_id"), numbered(lone(-1), "id", "run").withColumnRenamed("id", "end_id")
    return starts.join(ends, "run").select("start_id", "end_id", (F.col("end_id") - F.col("start_id") + 1).alias("n"))


def missing(every: DataFrame, done: DataFrame) -> DataFrame:
    return every.select("seq_id").join(done.select("seq_id"), "seq_id", "left_anti")


def gaps_by_chunk(gone: DataFrame, size: int = SIZE) -> DataFrame:
    return gone.withColumn("chunk_id", chunk_id(size=size)).groupBy("chunk_id").agg(F.count("*").alias("n_missing"), F.min("seq_id").alias("first_missing"), F.max("seq_id").alias("last_missing"))


def integrity(results: DataFrame, declared: DataFrame, size: int = SIZE) -> DataFrame:
    """chunk_id, declared, found, intact: counts in the store against the manifest, from either side."""
    found = results.withColumn("chunk_id", chunk_id(size=size)).groupBy("chunk_id").agg(F.count("*").alias("found"))
    joined = declared.select("chunk_id", F.col("sequence_count").alias("declared")).join(found, "chunk_id", "full")
    joined = joined.select("chunk_id", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("found", F.lit(0)).alias("found"))
    return joined.withColumn("intact", F.col("declared") == F.col("found"))


def write(results: DataFrame, path: str, size: int = SIZE) -> None:
    """Only the chunks in results are replaced; a chunk appears whole or not at all."""
    out = results.withColumn("chunk_id", chunk_id(size=size))
    out.repartition("chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("chunk_id").parquet(path)


def load(spark: SparkSession, path: str, seq_id: int, size: int = SIZE) -> DataFrame:
    """One sequence: the chunk follows from its id, so a single partition is read."""
    return spark.read.parquet(path).where((F.col("chunk_id") == (seq_id - 1) // size + 1) & (F.col("seq_id") == seq_id))


def load_chunk(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("chunk_id") == chunk)


def repair(spark: SparkSession, path: str, sequences: DataFrame, process, size: int = SIZE) -> DataFrame:
    """Computes what the store lacks with process(DataFrame) and rewrites the chunks concerned; gives their ids."""
    have = spark.read.parquet(path)
    gone = sequences.join(have.select("seq_id"), "seq_id", "left_anti")
    chunks = gone.select(chunk_id(size=size).alias("chunk_id")).distinct()
    fresh = process(gone)
    old = have.join(small(kept(chunks, "chunks")), "chunk_id", "left_semi").drop("chunk_id")
    write(kept(old.unionByName(fresh), "repaired"), path, size)
    return chunks


def orphans(listing: DataFrame, declared: DataFrame) -> DataFrame:
    """Files of a listing (file, chunk_id) that the manifest doesn't know."""
    return listing.join(declared.select("chunk_id"), "chunk_id", "left_anti")


def remove_orphans(spark: SparkSession, path: str, declared: DataFrame) -> list[int]:
    """Deletes the chunks of a store that the manifest doesn't know; gives their ids. One entry a chunk is listed, no sequence is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    listing = spark.createDataFrame([(f, int(f.split("=")[1])) for f in found if f.startswith("chunk_id=")], "file string, chunk_id long")
    gone = sorted((r.chunk_id, r.file) for r in orphans(listing, declared).collect())
    for _, file in gone:
        delete(spark, f"{path}/{file}")
    return [c for c, _ in gone]


def size_estimates(declared: DataFrame, bytes_by_chunk: DataFrame) -> DataFrame:
    """chunk_id, bytes_per_sequence, first and last sequence: the size of a chunk (chunk_id, bytes) shared among its sequences."""
    return declared.join(bytes_by_chunk, "chunk_id", "left").select("chunk_id", "start_seq_id", "end_seq_id", F.round(F.coalesce("bytes", F.lit(0)) / F.col("sequence_count"), 6).alias("bytes_per_sequence"))


def exported(results: DataFrame, vector: str = "context") -> DataFrame:
    """seq_id, pos, n, vector: the vectors of all positions of all sequences as one table."""
    return results.where(F.col(vector).isNotNull()).select("seq_id", "n", F.posexplode(vector).alias("pos", "vector")).select("seq_id", "pos", "n", "vector")


def joined_results(metadata: DataFrame, components: dict[str, DataFrame], every: bool = False) -> DataFrame:
    """metadata with a column for each component (seq_id, value): absent ones are null, or with every the sequence goes."""
    for name, df in components.items():
        metadata = metadata.join(df.select("seq_id", F.col("value").alias(name)), "seq_id", "inner" if every else "left")
    return metadata


def summary(results: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, n, n_spans, density of each sequence, for a report. lengths: seq_id, n; results: seq_id, start, end."""
    by = results.groupBy("seq_id").agg(F.count("*").alias("n_spans"))
    n = F.coalesce("n_spans", F.lit(0))
    return lengths.join(by, "seq_id", "left").select("seq_id", "n", n.alias("n_spans"), F.round(n / F.col("n"), 6).alias("density"))
