"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, neardup, packing, pii, quality, sharding, suffix, topk, unigram
from .scratch import shared_dir, stored, table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; another folder can be named by the argument of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # a null doc_id has no remainder: it is not held out, and nothing is learnt from it
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    model = langid.fit(docs, F.coalesce(remainder != 2, F.lit(False)))
    found = langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve shards, dealt by the hash of the text, become sixteen: written, rewritten where they change, and read again."""
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(12))
    path = f"{shared_dir(spark)}/lumentext/shards-{uuid.uuid4().hex}"
    docs = sharding.dealt(table(spark, sf_dir, "documents"), old, path)
    placed = stored(sharding.reshard(docs, 16, F.col("shard")).drop("slot"), "shard-placed")
    sharding.rewrite(docs, placed, path, "shard")
    return sharding.read_back(spark.read.schema(docs.schema).parquet(path)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.crc32(unigram.encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(stored(packing.tokenize(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")), "pieces"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    columns = "conv_id long, turn long, role string, text string"
    planted = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], columns)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.rendered(rows.unionByName(planted)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_neardup": op3_neardup,
    "op4_langid": op4_langid,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_quality_rules": op10_quality_rules,
    "pipeline": pipeline,
}

SQL = {
    "op2_topk": """
WITH one AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM one),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
windows AS (SELECT doc_id, i, words[i:i + 4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
repeated AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeat_words AS (SELECT doc_id, sum(least(5, i - coalesce(prev, i - 5))) AS n FROM repeated GROUP BY doc_id),
lines AS (SELECT * FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
keyed AS (SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k FROM lines),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
frequent AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT doc_id) AS c FROM keyed GROUP BY host, k) JOIN hosts USING (host) WHERE c > 10 AND c > 0.01 * n),
lost AS (SELECT doc_id, sum(words) AS n FROM keyed JOIN frequent USING (host, k) GROUP BY doc_id),
lines_by_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM lines GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN lines_by_doc l ON w.doc_id = l.doc_id LEFT JOIN repeat_words r ON w.doc_id = r.doc_id LEFT JOIN lost x ON w.doc_id = x.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM m
""",
}
