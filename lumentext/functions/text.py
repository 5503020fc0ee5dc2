"""Column expressions over text. Lengths and offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: The six ASCII white-space characters that decide whether a piece is coherent.
SPACES = r" \t\n\r\x0B\f"
#: What a strip removes: every Unicode white-space character.
STRIP = r"\x09-\x0D\x1C-\x20\x{85}\p{Z}"
#: The same characters one by one: ends are trimmed without a look at what lies between.
STRIPPED = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Programming language of a file extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".rs": "rust", ".go": "go", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".clj": "clojure", ".hs": "haskell", ".ml": "ocaml", ".r": "r",
    ".sql": "sql", ".sh": "bash", ".bash": "bash", ".bat": "batch", ".cmd": "batch", ".ps1": "powershell", ".yaml": "yaml",
    ".yml": "yaml", ".json": "json", ".xml": "xml", ".md": "markdown", ".rst": "rst", ".txt": "text",
}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def runs(text: Column) -> Column:
    """Maximal runs of white space or of anything else; no coherent piece crosses from one to the next."""
    return F.regexp_extract_all(text, F.lit(f"[{SPACES}]+|[^{SPACES}]+"), F.lit(0))


def is_coherent_piece(piece: Column) -> Column:
    """White space only, or none of it."""
    return (F.length(piece) <= 1) | ~(piece.rlike(f"[{SPACES}]") & piece.rlike(f"[^{SPACES}]"))


def is_whole_phrase(span: Column) -> Column:
    """Not blank, and one word, or cut at word ends, or made of alphanumeric words only."""
    core = strip(span)
    edges = ~F.substring(span, 1, 1).rlike(r"[\p{L}\p{N}]") & ~F.substring(span, -1, 1).rlike(r"[\p{L}\p{N}]")
    return ~is_blank(span) & (~F.contains(core, F.lit(" ")) | edges | core.rlike(rf"^[\p{{L}}\p{{N}}{STRIP}]+$"))


def shape(text: Column) -> Column:
    """text with a letter in place of each letter or digit, a tab of each other white-space character but the blank, and a point of all else: what `is_whole_phrase` looks at."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\p{L}\p{N}]", "a"), f"[{STRIP}&&[^ ]]", "\t"), r"[^a \t]", ".")


def is_likely_binary(content: Column) -> Column:
    """A NUL, or in texts of over 100 characters fewer than 70 % printable among the first 1000."""
    sample = F.substring(content, 1, 1000)
    bad = F.length(sample) - F.length(F.regexp_replace(F.regexp_replace(sample, r"[\x09-\x0D\x1C-\x1F\x{85}]", " "), r"[\p{Cc}\p{Cf}\p{Co}]", ""))
    return F.contains(content, F.lit("\0")) | ((F.length(content) > 100) & ((F.length(sample) - bad) / F.length(sample) < 0.7))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_language(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path)), F.lit("unknown"))


def repo_name(url: Column) -> Column:
    """owner__repository of a clone address."""
    bare = F.regexp_replace(url, r"\.git$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", ""), "^/+|/+$", "")
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -2), F.lit("__"), F.element_at(parts, -1))).otherwise(path)


def source_hash(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 8)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)
