"""Registered queries of reports, stores and readers, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embed, judge, spans, stats, store, vocab
from ..shared import fresh_path, kept
from ..sources import records, sinks
from . import catalog as C

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _within(name: str, base: str) -> str:
    """The SQL of a query of the catalogue as a subquery of one that has the base's tables already."""
    rest = C.SQL[name].strip().removeprefix(f"WITH {base}").lstrip(", \n")
    return f"({rest})" if rest.startswith("SELECT") else f"(WITH {rest})"


def _of_depth(name: str) -> str:
    return f"(WITH {C.SQL[name].strip().removeprefix(f'WITH {C._ALIGNED}, ')})"


_A = C._ALIGNED


@query(f"""WITH {C._DEPTH}, cov AS {_within("span_coverage", C._DEPTH)}, gap AS (SELECT seq_id, count(*) AS n_gaps FROM {_within("span_gaps", C._DEPTH)} GROUP BY seq_id), len AS {_of_depth("span_lengths")}, places_ AS {_of_depth("span_positions")},
over_ AS {_of_depth("span_overlaps")}, nest AS {_of_depth("span_hierarchy")}
SELECT q.seq_id, q.n, covered, uncovered, density, avg_depth, cov.max_depth, coalesce(n_gaps, 0) AS n_gaps, coalesce(len.n, 0) AS n_spans, min_len, max_len, len.mean_len, median_len, std_len, mean_start, std_start, mean_end, std_end, mean_centre, std_centre,
coalesce(over_.pairs, 0) AS overlap_pairs, coalesce(over_.total_len, 0) AS overlap_len, coalesce(nest.pairs, 0) AS nested_pairs, nest.max_depth AS max_nesting, nest.mean_depth AS mean_nesting, coalesce(roots, 0) AS roots, coalesce(leaves, 0) AS leaves
FROM seqs q LEFT JOIN cov ON q.seq_id = cov.seq_id LEFT JOIN gap ON q.seq_id = gap.seq_id LEFT JOIN len ON q.seq_id = len.seq_id LEFT JOIN places_ ON q.seq_id = places_.seq_id LEFT JOIN over_ ON q.seq_id = over_.seq_id LEFT JOIN nest ON q.seq_id = nest.seq_id""")
def span_report(spark, sf_dir):
    return spans.report(*C._aligned(spark, sf_dir))


@query(f'WITH {_A} SELECT seq_id, "end" - "start" AS length, count(*) AS n FROM sp GROUP BY 1, 2')
def span_length_counts(spark, sf_dir):
    return spans.length_counts(C._aligned(spark, sf_dir)[0])


@query(f'WITH {_A} SELECT "end" - "start" AS length, count(*) AS n FROM sp GROUP BY 1 ORDER BY n DESC, length LIMIT 10')
def span_common_lengths(spark, sf_dir):
    return spans.common_lengths(C._aligned(spark, sf_dir)[0])


@query(f"""WITH {_A} SELECT seq_id, pos, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM (SELECT seq_id, "start" AS pos, 1 AS s, 0 AS e FROM sp UNION ALL SELECT seq_id, "end" - 1, 0, 1 FROM sp) GROUP BY 1, 2""")
def span_position_counts(spark, sf_dir):
    return spans.position_counts(C._aligned(spark, sf_dir)[0])


@query(f"WITH {C._DEPTH} SELECT seq_id, d AS depth, count(*) AS n FROM depth GROUP BY 1, 2")
def span_depth_counts(spark, sf_dir):
    return spans.depth_counts(*C._aligned(spark, sf_dir))


@query(f"""WITH {_A} SELECT a.seq_id, b."start" AS "start", a."end" AS "end", count(*) AS n FROM sp a JOIN sp b ON a.seq_id = b.seq_id AND a."start" < b."start" AND b."start" < a."end" AND a."end" < b."end" GROUP BY 1, 2, 3""")
def span_overlap_regions(spark, sf_dir):
    return spans.overlap_regions(C._aligned(spark, sf_dir)[0])


@query(f"""WITH {_A} SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY "end" - "start", "start") - 1 AS INTEGER) AS row, "start", "end" FROM sp""")
def span_heat_rows(spark, sf_dir):
    return spans.heat_rows(C._aligned(spark, sf_dir)[0])


@query(f"""WITH {_A} SELECT sp.seq_id, "start", "end", substring(lower(text), "start" + 1, "end" - "start") AS span FROM sp JOIN seqs ON sp.seq_id = seqs.seq_id""")
def span_texts(spark, sf_dir):
    sequences = C._sequences(spark, sf_dir).withColumn("text", F.lower("text"))
    return spans.texts(C._aligned(spark, sf_dir)[0], sequences)


@query(f"""WITH {_A}, m AS (SELECT seq_id, count(*) AS m FROM sp GROUP BY seq_id), d AS (SELECT coalesce(m, 0) / n AS d FROM seqs LEFT JOIN m ON seqs.seq_id = m.seq_id)
SELECT count(*) AS n_sequences, round(avg(d), 6) AS mean_density, round(stddev_pop(d), 6) AS std_density, round(min(d), 6) AS min_density, round(max(d), 6) AS max_density FROM d""")
def candidate_density(spark, sf_dir):
    found, lengths = C._aligned(spark, sf_dir)
    d = F.coalesce("m", F.lit(0)) / F.col("n")
    rows = lengths.join(found.groupBy("seq_id").agg(F.count("*").alias("m")), "seq_id", "left").select(d.alias("d"))
    return rows.agg(F.count("*").alias("n_sequences"), *[F.round(f("d"), 6).alias(f"{name}_density") for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


@query(f"WITH {_A} SELECT seq_id, substring(text, 1, 100) AS shown, n FROM seqs ORDER BY seq_id LIMIT 10")
def first_sequences(spark, sf_dir):
    return C._sequences(spark, sf_dir).select("seq_id", F.substring("text", 1, 100).alias("shown"), "n").orderBy("seq_id").limit(10)


@query(f"""WITH {C._VOCAB} (SELECT 'single' AS kind, piece, freq FROM vocab WHERE length(piece) = 1 ORDER BY freq DESC, piece LIMIT 10) UNION ALL (SELECT 'multi', piece, freq FROM vocab WHERE length(piece) > 1 ORDER BY freq DESC, piece LIMIT 10)""")
def top_pieces(spark, sf_dir):
    table = kept(C._candidates(spark, sf_dir), "candidates")
    best = lambda kind, wanted: table.where(wanted).orderBy(F.desc("freq"), "piece").limit(10).select(F.lit(kind).alias("kind"), "piece", "freq")
    return best("single", F.length("piece") == 1).union(best("multi", F.length("piece") > 1))


@query(f"WITH {C._VOCAB} SELECT piece, prob FROM probs ORDER BY prob DESC, piece LIMIT 5")
def top_probabilities(spark, sf_dir):
    return C._probabilities(spark, sf_dir).orderBy(F.desc("prob"), "piece").limit(5).select("piece", "prob")


@query(f"WITH {C._VOCAB} SELECT piece, length(piece) AS length FROM vocab ORDER BY length(piece) DESC, piece LIMIT 1000")
def pieces_by_length(spark, sf_dir):
    return C._candidates(spark, sf_dir).select("piece", F.length("piece").cast("long").alias("length")).orderBy(F.desc("length"), "piece").limit(1000)


@query(f"""WITH {C._SOFT}, v AS (SELECT count(*) AS v FROM probs), t AS (SELECT CAST(sum(mult * length(run)) AS DOUBLE) AS t FROM runs),
rows_ AS (SELECT r.run, r.mult, r.pos, coalesce(s.total, 0) AS total FROM (SELECT run, mult, unnest(range(0, length(run))) AS pos FROM runs) r LEFT JOIN (SELECT run, pos, sum(p) AS total FROM soft GROUP BY run, pos) s ON r.run = s.run AND r.pos = s.pos),
m AS (SELECT sum(mult * total) / (SELECT t FROM t) AS row_mean FROM rows_),
c AS (SELECT sum(mult * p) AS s, sum(mult * p * p) AS ss, max(p) AS top, sum(mult) FILTER (WHERE p > 0) AS filled FROM soft)
SELECT round(s / (t * v), 9) AS mean, round(sqrt(ss / (t * v) - (s / (t * v)) * (s / (t * v))), 9) AS std, round(top, 6) AS max, round(1 - filled / (t * v), 9) AS sparsity, round(row_mean, 6) AS row_sums_mean,
round(sqrt((SELECT sum(mult * (total - row_mean) * (total - row_mean)) FROM rows_) / t), 6) AS row_sums_std FROM c, v, t, m""")
def soft_probability_stats(spark, sf_dir):
    """Statistics of the matrix of positions and pieces, of which only the cells above zero are kept: the others count as zeros."""
    runs, p = C._runs_and_vocabulary(spark, sf_dir)
    by = kept(vocab.soft_sums(runs, p), "sums").where("n > 0")
    row_mean = F.sum("row_sum") / F.sum("n")
    sums = by.agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max(F.when(F.col("top") >= 0, F.col("top"))).alias("top"), F.sum("filled").alias("filled"), F.sum("n").alias("t"), row_mean.alias("row_mean"), F.lit(len(p)).alias("v"))
    apart = F.col("row_sum") / F.col("n") - F.col("row_mean")  # of a batch's mean from that of all
    one = by.join(F.broadcast(sums.select("row_mean", "t"))).agg((F.sum(F.col("row_dev") + F.col("n") * apart * apart) / F.first("t")).alias("row_var")).join(sums)
    n = F.col("t") * F.col("v")
    mean = F.col("s") / n
    return one.select(F.round(mean, 9).alias("mean"), F.round(F.sqrt(F.col("ss") / n - mean * mean), 9).alias("std"), F.round("top", 6).alias("max"), F.round(1 - F.col("filled") / n, 9).alias("sparsity"), F.round("row_mean", 6).alias("row_sums_mean"), F.round(F.sqrt("row_var"), 6).alias("row_sums_std"))


@query("""SELECT o_orderkey, round(o_totalprice - o_totalprice * (o_orderkey % 3), 6) AS improvement, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE 100 * (o_totalprice - o_totalprice * (o_orderkey % 3)) / o_totalprice END, 6) AS improvement_percent, o_orderkey % 2 = 0 AS perfect,
printf('%.4f%%', CAST(o_orderkey % 2 AS DOUBLE) * 100) AS shown_oov FROM orders""")
def perplexity_improvement(spark, sf_dir):
    """The projection on numbers of another table: prices stand for perplexities."""
    key = F.col("o_orderkey")
    rows = C._read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("baseline_ppl"), (F.col("o_totalprice").cast("double") * (key % 3)).alias("final_ppl"), (key % 2).cast("double").alias("oov_rate"))
    made = stats.improvement(rows)
    return made.select("o_orderkey", F.round("improvement", 6).alias("improvement"), F.round("improvement_percent", 6).alias("improvement_percent"), "perfect", F.substring_index("shown", "OOV ", -1).alias("shown_oov"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type""")
def run_time_stats(spark, sf_dir):
    return stats.run_stats(C._read(spark, sf_dir, "events"), "event_type", "value")


# ---- readers and writers, through files ---------------------------------------------------------------------------------


@query(f"""WITH {C._CLASSES}, b AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'invalid' ELSE class END AS class FROM cls) SELECT class, count(*) AS n FROM b GROUP BY class""")
def jsonl_read(spark, sf_dir):
    """Records as files of JSON lines, a tenth of the lines broken, found and read again."""
    path = fresh_path(spark, "records")
    rows = C._classified(spark, sf_dir)
    line = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("raw"), F.struct("status").alias("meta")))
    lines = rows.select(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    lines.write.text(path)
    read = records.classified_lines(spark.read.text(records.discover(spark, path, ".txt")))
    return read.groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT text, 'one' AS file FROM (SELECT regexp_replace(text, '" + C._STRIP + "', '', 'g') AS text, conv_id FROM conversations WHERE text IS NOT NULL) WHERE conv_id % 2 = 0 AND text <> '' UNION ALL SELECT text, 'two' FROM (SELECT regexp_replace(text, '" + C._STRIP + "', '', 'g') AS text, conv_id FROM conversations WHERE text IS NOT NULL) WHERE conv_id % 2 = 1 AND text <> ''")
def csv_segments(spark, sf_dir):
    """Two CSV files with other headers, and one without the column, read as one table."""
    path = fresh_path(spark, "csv")
    rows = C._read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "role", T.strip(F.col("text")).alias("text")).where("text <> ''")
    out = lambda df, name: df.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/{name}")
    out(rows.where("conv_id % 2 = 0").select("text", "role"), "one")
    out(rows.where("conv_id % 2 = 1").select("role", "text", "conv_id"), "two")
    out(rows.select("role"), "three")
    one, two, none = (records.read_segments(spark, f"{path}/{k}") for k in ("one", "two", "three"))
    named = lambda df, name: df.select("text", F.lit(name).alias("file"))
    return named(one, "one").union(named(two, "two")).union(named(none, "three"))


@query(f"WITH {C._VOCAB} SELECT piece, prob FROM probs")
def vocabulary_file(spark, sf_dir):
    """The vocabulary written as lines and read again."""
    path = fresh_path(spark, "vocabulary")
    sinks.write_vocabulary(C._probabilities(spark, sf_dir), path)
    return records.read_vocabulary(spark, path).select("piece", "prob")


@query("""SELECT chunk_id, n AS sequence_count, first AS start_seq_id FROM (SELECT doc_id // 100 + 1 AS chunk_id, count(*) AS n, min(doc_id) + 1 AS first FROM documents GROUP BY 1) WHERE chunk_id % 2 = 1""")
def orphan_removal(spark, sf_dir):
    """Of a store's chunks those that a manifest of the odd ones doesn't know are deleted; what the store then holds."""
    path = fresh_path(spark, "store")
    store.write(C._read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("seq_id"), F.length("text").alias("n")), path)
    declared = kept(store.manifest(spark.read.parquet(path).select("seq_id", "n")).where("chunk_id % 2 = 1"), "declared")
    store.remove_orphans(spark, path, declared)
    return store.manifest(spark.read.parquet(path).select("seq_id", "n")).select("chunk_id", "sequence_count", "start_seq_id")


@query("""SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pos, len(embedding) AS n, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""")
def embedding_export(spark, sf_dir):
    """All positions of all results in one table; here a vector's numbers stand for its positions."""
    rows = C._vectors(spark, sf_dir).select(F.col("vec_id").alias("seq_id"), F.size("embedding").cast("long").alias("n"), F.col("embedding").alias("context"))
    return store.exported(rows).select(F.col("seq_id").alias("vec_id"), "pos", "n", F.col("vector").alias("value"))


@query()
def judge_pipeline(spark, sf_dir):
    """Filter, votes, threshold and consensus of every turn; the judge needs no model."""
    rows = C._read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("segment"), "text")
    return judge.judge_all(rows, "segment", judge.heuristic_judge, 3)


@query()
def sequence_pipeline(spark, sf_dir):
    """Each sequence with everything that belongs to it: vectors, soft probabilities (their sum is 1 at a position), spans."""
    p = vocab.as_dict(C._probabilities(spark, sf_dir))
    made = embed.encode(C._sequences(spark, sf_dir).withColumn("text", F.lower("text")), p, width=64)
    found = C._aligned(spark, sf_dir)[0].groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    covered = F.aggregate("soft", F.lit(0.0), lambda s, x: s + x["p"] * F.length(x["piece"]))
    return made.join(found, "seq_id", "left").select("seq_id", "n", "width", F.size("soft").alias("n_cells"), F.round(covered, 4).alias("covered"), F.size("context").alias("n_context"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), "error")
