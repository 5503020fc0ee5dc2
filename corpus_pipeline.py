"""A corpus pipeline: language identification, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, further ones included, whatever their names; where a stage
changes a text, n_chars follows. An empty table gives an empty result in every stage; texts may be of any length; ties and
repeated rows have the results that the operators' modules state, and so have nulls in a column other than those named below.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentext.llm import langid, neardup, packing, pii, queries, suffix
from lumentext.llm.scratch import collected, released, stored, table

#: Rows that go to a Python worker at once, at most: those of whole texts take memory on both sides.
BATCH = 2000


def _lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun by executors and workers that hold nothing of the one before, with batches of BATCH rows."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH:
            spark.conf.set(rows, str(BATCH))
        released(spark)
        return _collected(stage)(spark, docs, sf_dir)

    return run


def _collected(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun by executors without the garbage of the one before: all that a stage of DataFrame functions needs, which runs no Python there."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return run


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, those without a letter and those far from every known language go. A null lang is not learnt from, nothing else of it matters."""
    model = langid.fit(docs, F.lit(True))
    return langid.recognised(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, nulls last. Texts without a word, null ones too, all stay, and so does a null doc_id whose text has no near-duplicate."""
    return neardup.deduplicated(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that repeat. Null texts stay null; no row goes; repeated rows are each other's copies."""
    out = _measured(suffix.cleaned(docs))
    released(spark)  # its workers are done, and the next stage, which has none, does not ask them
    return out


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. Null texts stay null; no row goes."""
    return _measured(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, its tokens' digest, its sequence and place there. A null text is an empty one; each row is packed for itself."""
    return packing.pack(stored(packing.tokenize(docs, queries.tokenizer("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("language", _lean(identify_language)),
    ("near_duplicates", _lean(drop_near_duplicates)),
    ("repeats", _lean(remove_repeats)),
    ("personal_data", _collected(redact_personal_data)),
    ("packing", _lean(pack)),
]

#: The stages use hashing, clustering and tokenizers that SQL can't express; tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
