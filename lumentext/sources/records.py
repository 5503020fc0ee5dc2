"""Readers: record files (JSON lines), segment tables (CSV), vocabularies, code files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import kept, small

MOST = 512
SCHEMA = "raw STRING, type STRING, id STRUCT<id: STRING>, meta STRUCT<status: STRING, tags: ARRAY<STRING>, doc_language: STRING, extracted_by: STRING, confidence: DOUBLE, source_file: STRING, notes: STRING>"
#: Records of a bucket of ids are numbered together: no task ever holds all of them.
BUCKET = 10_000

# Fixed values.
SKIPPED_SUFFIXES = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".png", ".jpg", ".jpeg", ".gif", ".bmp",
    ".ico", ".tiff", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".wmv", ".flv", ".webm", ".mkv", ".pdf", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".xz", ".woff", ".woff2",
    ".ttf", ".eot", ".otf", ".class", ".jar", ".pyc", ".pyo", ".o", ".obj", ".a", ".lib", ".pickle", ".pkl", ".npy", ".npz",
    ".h5", ".hdf5", ".parquet",
]
CODE_SUFFIXES = [
    ".py", ".js", ".ts", ".java", ".cpp", ".c", ".h", ".rs", ".go", ".rb", ".php", ".cs", ".swift", ".kt", ".scala", ".clj",
    ".hs", ".ml", ".r", ".sql", ".sh", ".bat", ".ps1", ".yaml", ".yml", ".json", ".xml", ".md", ".rst", ".txt",
]
SKIPPED_FOLDERS = [
    ".git", ".svn", ".hg", ".bzr", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "node_modules", ".node_modules",
    "bower_components", ".vscode", ".idea", ".vs", ".vscode-test", "build", "dist", "target", "out", "bin", "obj", "release",
    "debug", ".next", ".nuxt", ".output", ".vercel", ".netlify", "coverage", ".nyc_output", ".coverage", "htmlcov", "venv",
    "env", ".env", ".venv", "virtualenv", ".virtualenv", "logs", "log", "tmp", "temp", ".tmp", ".temp", "cache", ".cache",
    "data", "dataset", "datasets", "models", "checkpoints", "vendor", "third_party", "external", "deps", "dependencies",
    "test_data", "test_files", "fixtures", "samples", "examples", "docs", "documentation", ".docs", "doc", "assets",
    "static", "public", "images", "img", "media",
]


def classify(text: Column, status: Column, most: int = MOST) -> Column:
    """discarded, invalid, too_long or valid, in that order of questions."""
    return F.when(status == "discard", "discarded").when(text.isNull() | T.is_blank(text), "invalid").when(F.length(T.strip(text)) > most, "too_long").otherwise("valid")


def classified_lines(lines: DataFrame, most: int = MOST) -> DataFrame:
    """line, class, text (stripped), record of each line (value); broken JSON and records without a string raw are invalid."""
    parsed = lines.select("value", F.expr("try_parse_json(value)").alias("v"))
    kind = lambda path: F.expr(f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))")
    typed = parsed.select("value", F.from_json("value", SCHEMA).alias("record"), kind("$.raw").alias("raw_kind"), kind("$.meta").alias("meta_kind"))
    good = (F.col("raw_kind") == "STRING") & ~F.coalesce(F.col("meta_kind") == "VOID", F.lit(False))
    shape = F.when(F.coalesce(good, F.lit(False)), classify(F.col("record.raw"), F.col("record.meta.status"), most)).otherwise("invalid")
    return typed.select(F.col("value").alias("line"), shape.alias("class"), T.strip(F.col("record.raw")).alias("text"), "record")


def read_jsonl(spark: SparkSession, *paths: str, most: int = MOST, recursive: bool = True) -> DataFrame:
    """The classified lines of files, or of all such files below folders."""
    files = [f for p in paths for f in discover(spark, p, ".jsonl", recursive)]
    return classified_lines(spark.read.text(files), most)


def scan_stats(classified: DataFrame) -> DataFrame:
    """class, n, chars, avg_len (cut to an integer), max_len, min_len."""
    n = F.length("text")
    return classified.groupBy("class").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.floor(F.avg(n)).alias("avg_len"), F.max(n).alias("max_len"), F.min(n).alias("min_len"))


def numbered(df: DataFrame, key: str, name: str = "seq_id") -> DataFrame:
    """df with numbers 1, 2, ... by a numeric key: counts by bucket of keys are summed up in two levels, rows are numbered within their bucket, so no task holds all rows or all buckets."""
    bucket, upper = F.floor(F.col(key) / BUCKET), F.floor(F.col("bucket") / BUCKET)
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("upper", upper)
    ahead = lambda part, order: F.coalesce(F.sum("n").over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = counts.groupBy("upper").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    above = above.select("upper", ahead("all", "upper").alias("above"))  # one row for BUCKET x BUCKET keys
    first = counts.withColumn("first", ahead("upper", "bucket")).join(above, "upper").select("bucket", (F.col("first") + F.col("above")).alias("first"))
    within = Window.partitionBy("bucket").orderBy(key)
    joined = df.withColumn("bucket", bucket).join(small(kept(first, "numbers")), "bucket")
    return joined.withColumn(name, F.col("first") + F.row_number().over(within)).drop("bucket", "first")


def discover(spark: SparkSession, path: str, suffix: str = ".jsonl", recursive: bool = True) -> list[str]:
    """Paths of a file or of the files below a folder, sorted. FileNotFoundError for a missing path or a folder without such files, ValueError for a file of another kind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        raise FileNotFoundError(path)
    if files.getFileStatus(at).isFile():
        if not path.endswith(suffix):
            raise ValueError(f"not a {suffix} file: {path}")
        return [path]
    found, listed = [], files.listFiles(at, recursive)
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    if not found:
        raise FileNotFoundError(f"no {suffix} file in {path}")
    return sorted(found)


def read_segments(spark: SparkSession, path: str, column: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """text, source_file of CSV files that have the column; nulls go, texts are stripped. Each file has its own header: files are read by groups of one header."""
    groups: dict[str, list[str]] = {}
    for file in discover(spark, path, ".csv"):
        head = spark.read.text(file).limit(1).collect()
        groups.setdefault(head[0][0] if head else "", []).append(file)
    file = F.col("_metadata.file_name")
    if names:
        file = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), file), file)
    out = spark.createDataFrame([], "text string, source_file string")
    for files in groups.values():
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        if column in df.columns:
            out = out.union(df.where(F.col(column).isNotNull()).select(T.strip(F.col(column).cast("string")).alias("text"), file.alias("source_file")))
    return out


def validate_lines(lines: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts (total, json, records) of lines of read_jsonl, and the first faults by line (line, fault), most of them at most."""
    good = F.expr("try_parse_json(line) IS NOT NULL")
    fault = F.when(~F.coalesce(good, F.lit(False)), "no JSON").when(F.col("class") == "invalid", "no record")
    counts = lines.agg(F.count("*").alias("total"), F.count_if(good).alias("json"), F.count_if(fault.isNull()).alias("records"))
    return counts, lines.select("line", fault.alias("fault")).where("fault IS NOT NULL").orderBy("line").limit(most)


def processed(spark: SparkSession, path: str, force: bool = False) -> DataFrame | None:
    """What write_split left below path, kept and discarded together; None if there is nothing, or if force asks to begin anew: then it is deleted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    if force:
        files.delete(at, True)
        return None
    return spark.read.json(path)


def vocabulary(lines: DataFrame) -> DataFrame:
    """piece, prob, position from line, piece, prob, probability: probabilities outside of (0, 1] go; the last of a piece counts, at the first's place."""
    value = F.coalesce(F.when(F.col("probability") != 0, F.col("probability")), F.col("prob"))
    good = lines.select("line", "piece", value.alias("p")).where("piece IS NOT NULL AND p > 0 AND p <= 1")
    return good.groupBy("piece").agg(F.max_by("p", "line").alias("prob"), F.min("line").alias("position"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """ValueError if no piece is left."""
    lines = spark.read.schema("piece STRING, prob DOUBLE, probability DOUBLE").json(path).withColumn("line", F.monotonically_increasing_id())
    found = vocabulary(lines)
    if found.isEmpty():
        raise ValueError(f"no piece in {path}")
    return found


def read_code(spark: SparkSession, path: str, suffixes: list[str] | None = None, skipped: list[str] | None = None, most: int = 50_000) -> DataFrame:
    """content, file_path, language, size_chars of the code files below a folder: not binary, not blank, not too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/").split("/")[-1]
    inner = F.slice(F.split(F.element_at(F.split("path", f"/{re.escape(root)}/", 2), -1), "/"), 1, 1000)
    wanted = T.extension(F.col("path")).isin(suffixes or CODE_SUFFIXES) & ~T.extension(F.col("path")).isin(SKIPPED_SUFFIXES)
    wanted &= ~F.arrays_overlap(inner, F.array(*map(F.lit, skipped or SKIPPED_FOLDERS)))
    text = files.where(wanted & (F.col("length") <= 2 * most)).select(F.expr("replace(make_valid_utf8(cast(content as string)), '�', '')").alias("content"), F.col("path").alias("file_path"))
    good = text.where((F.length("content") <= most) & ~T.is_likely_binary(F.col("content")) & ~T.is_blank(F.col("content")))
    return good.select("content", "file_path", T.file_language(F.col("file_path")).alias("language"), F.length("content").alias("size_chars"))


def page_counts(files: DataFrame) -> DataFrame:
    """path, pages of PDF files (path, content): page objects that lie open in the file; -1 where there are none, as in compressed or broken files."""
    n = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![a-zA-Z])"))
    return files.select("path", F.when(n > 0, n).otherwise(-1).alias("pages"))


def page_ranges(files: DataFrame, batch: int = 200, least: int = 400) -> DataFrame:
    """path, first, last of the page batches of files (path, pages) with more pages than least; others are one batch."""
    starts = F.when(F.col("pages") > least, F.sequence(F.lit(0), F.col("pages") - 1, F.lit(batch))).otherwise(F.array(F.lit(0)))
    step = F.when(F.col("pages") > least, F.lit(batch)).otherwise(F.col("pages"))
    return files.select("path", "pages", F.explode(starts).alias("first"), step.alias("step")).select("path", "first", (F.least(F.col("first") + F.col("step"), F.col("pages")) - 1).alias("last"))


def read_pdf_segments(spark: SparkSession, path: str, extract) -> DataFrame:
    """text, source_file of PDF files; extract(bytes) -> list of texts is supplied by the caller and called on the executors."""
    import pandas as pd

    def work(frames):
        for f in frames:
            rows = [(t, p) for p, c in zip(f["path"], f["content"], strict=True) for t in extract(bytes(c))]
            yield pd.DataFrame(rows, columns=["text", "source_file"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(work, "text string, source_file string")
