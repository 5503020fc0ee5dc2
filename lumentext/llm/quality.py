"""Quality rules by cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, white space collapsed) and hashed; for each host the distinct documents that have a
line are counted; lines above the limit are removed, and documents that lose too much of their words are rejected.

Defined results: null text is an empty text; a null host is a host of its own; rows with equal doc_id and text are
judged alike, each for itself, and count as one document; an empty table gives an empty result; other columns of the
input, whatever their names, are not read. Null doc_ids are kept and judged as one more id, which adds to no line's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import let, small, stored

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOL = r"[#*$%&|<>]"
#: A window of so many words; a document needs so many words at least, and may have this share of repeated words at most.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20
#: A line is above the limit if more documents than this, and more than this share of the host's documents, have it.
LINE_DOCS, LINE_SHARE = 10, 0.01
#: A document is depleted if over this share of its words stands in removed lines.
DEPLETED = 0.5


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))))


def _repeated_words(windows: Column) -> Column:
    """Words in windows whose hash comes twice or more: repeated window starts in order, each adding what it covers anew."""

    def covered(ordered: Column) -> Column:
        twin = lambda e, i: (F.get(ordered, i - 1)["h"] == e["h"]) | (F.get(ordered, i + 1)["h"] == e["h"])
        starts = F.sort_array(F.transform(F.filter(ordered, lambda e, i: F.coalesce(twin(e, i), F.lit(False)) | ((i > 0) & F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False)))), lambda e: e["at"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"))
        return F.aggregate(starts, start, step)["n"]

    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(keyed, covered)).otherwise(F.lit(0))


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for each row, in one pass without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    # words is used more than once below, so the optimizer keeps it as a column of its own and computes it once
    words = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.expr(f"regexp_extract_all(text, r'{WORD}', 0)").alias("words"))
    word = lambda i: F.get("words", i)
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    made = words.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _lines(F.col("text")).alias("lines"),
        windows.alias("windows"),
    )
    return made.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
    )


def frequent_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, line_key, n_docs of the lines above the limit. Rows bound the documents from above; of the lines that pass by rows,
    each document is taken once in a step dealt by document too, and counts are summed before the shuffle, so a hot line or host costs no task more."""
    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = rows.select("host", "doc_id", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _line_key))).alias("line_key"))
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("host_docs")), "quality-hosts")
    above = lambda df: df.join(small(hosts), "host").where((F.col("n_docs") > line_docs) & (F.col("n_docs") > line_share * F.col("host_docs")))
    by_rows = stored(above(keys.groupBy("host", "line_key").agg(F.count("*").alias("n_docs"))).select("host", "line_key"), "quality-lines")
    once = keys.join(small(by_rows), ["host", "line_key"]).select("host", "line_key", "doc_id").distinct()
    return above(once.groupBy("host", "line_key").agg(F.count("doc_id").alias("n_docs"))).select("host", "line_key", "n_docs")


def removed_lines(docs: DataFrame, frequent: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, text_key, line_key, times, words: the lines of each document that are removed, and the words they hold."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", "host", F.xxhash64("text").alias("text_key"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    keyed = lines.select("doc_id", "host", "text_key", "at", _line_key(F.col("line")).alias("line_key"), F.regexp_count("line", F.lit(WORD)).alias("words"))
    return keyed.join(frequent.select("host", "line_key"), ["host", "line_key"]).select("doc_id", "text_key", "at", "line_key", "words").distinct()


def judge(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The measures of each document with n_removed_words, base_failed and kept."""
    frequent = stored(frequent_lines(docs, host, line_docs, line_share), "frequent-lines")
    lost = removed_lines(docs, small(frequent), host).groupBy("doc_id", "text_key").agg(F.sum("words").alias("n_removed_words"))
    made = text_measures(docs).alias("m")
    lost = lost.withColumnsRenamed({"doc_id": "lost_id", "text_key": "lost_key"})
    out = made.join(lost, F.col("m.doc_id").eqNullSafe(F.col("lost_id")) & (F.col("m.text_key") == F.col("lost_key")), "left").drop("lost_id", "lost_key", "text_key")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= depleted * F.col("n_words")))
