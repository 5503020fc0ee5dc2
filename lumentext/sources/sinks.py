"""Writers: corpora, kept and discarded records, vocabularies, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import numbered


def corpus_records(sequences: DataFrame, key: str, source: str | None = None) -> DataFrame:
    """raw, type, id, meta of numbered sequences."""
    rows = numbered(sequences, key)
    name = F.format_string("corpus-seq-%08d", F.col("seq_id"))
    meta = F.struct(F.lit("keep").alias("status"), F.col("seq_id").alias("sequence_number"), F.lit(source).alias("source"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    return rows.select(F.col("text").alias("raw"), F.lit("mixed").alias("type"), F.struct(name.alias("id")).alias("id"), meta.alias("meta"))


def write_corpus(sequences: DataFrame, key: str, path: str, source: str | None = None) -> None:
    corpus_records(sequences, key, source).write.mode("overwrite").json(path)


def write_split(records: DataFrame, path: str) -> None:
    """One folder for kept and one for discarded records; further runs add to them."""
    records.write.mode("append").partitionBy("status").json(path)


def unprocessed(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Segments whose text no finished record has."""
    return segments.join(done.select(F.col("raw").alias("text")), "text", "left_anti").select(*segments.columns)


def merge_jsonl(df: DataFrame, path: str, valid_only: bool = True) -> None:
    """The original lines of classified records (see read_jsonl) in one folder."""
    (df.where("class <> 'invalid'") if valid_only else df).select("line").write.mode("overwrite").text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.orderBy(F.desc("prob"), "piece").select("piece", "prob").write.mode("overwrite").json(path)


def frequency_lines(counts: DataFrame) -> DataFrame:
    """Counts in falling order, with line ends shown."""
    return counts.orderBy(F.desc("freq"), "piece").select(F.replace("piece", F.lit("\n"), F.lit("⏎")).alias("piece"), "freq")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at most, the same for the same seed, without replacement."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


def write_json_array(df: DataFrame, path: str) -> None:
    """df as one pretty-printed JSON array in a single file. For reports: the array is one value, as such a file is."""
    one = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    body = one.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    body.write.mode("overwrite").option("compression", "none").text(path)


def write_stats(stats: dict, spark, path: str) -> None:
    spark.createDataFrame([stats]).coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark, path: str) -> dict:
    return spark.read.json(path).first().asDict()


def batches_in_order(batches: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of several extractions (batch, row, ...) one after another, with the columns of the first."""
    return batches.orderBy("batch", "row").select(*columns)
