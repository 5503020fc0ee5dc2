"""Splitting texts into segments of bounded length and merging short ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, LEAST = 512, 64
#: Characters of segments that a task holds before it gives them out.
HELD = 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _sliced(chunks: list[str], most: int) -> list[str]:
    return [c[i : i + most] for c in chunks for i in range(0, max(len(c), 1), most)]


def _packed(parts: list[str], glue: str, most: int) -> list[str]:
    """Parts joined while they fit; a part too long stands alone, and an empty line at a chunk's start is swallowed."""
    chunks, now = [], ""
    for part in parts:
        if len(now) + len(part) + 1 > most:
            chunks.append(now)
            now = part
        else:
            now = f"{now}{glue}{part}" if now else part
    return [c for c in [*chunks, now] if c]


def split_sentences(text: str, most: int = MOST) -> list[str]:
    """The text if it fits; else its sentences, long ones packed by words, and what is still too long in slices."""
    if len(text) <= most:
        return [text]
    chunks = []
    for sentence in _SENTENCE.split(text):
        if sentence.strip():
            chunks += [sentence] if len(sentence) <= most else _packed(sentence.split(), " ", most)
    return _sliced(chunks, most)


def split_code(text: str, most: int = MOST) -> list[str]:
    """The same by lines; never without a segment."""
    return [text] if len(text) <= most else _sliced(_packed(text.split("\n"), "\n", most), most) or [""]


class Merger:
    """Merges short segments of one source with those that follow, as they stream by; feed gives out finished ones."""

    def __init__(self, least: int = LEAST, most: int = MOST) -> None:
        self.least, self.most, self.open, self.source = least, most, None, None

    def feed(self, text: str, source: str | None) -> Iterator[tuple[str, str | None]]:
        text = text.strip()
        if not text:
            return
        joins = self.open is not None and source == self.source and len(text) < self.least and len(self.open) + 1 + len(text) <= self.most
        if joins:
            self.open = f"{self.open} {text}"
        else:
            yield from self.end()
            self.open, self.source = text, source
        if len(self.open) >= self.least:
            yield from self.end()

    def end(self) -> Iterator[tuple[str, str | None]]:
        if self.open is not None:
            yield self.open, self.source
        self.open = None


def split(df: DataFrame, key: str, text: str, code: bool = False, most: int = MOST) -> DataFrame:
    """key, position, segment of each text; no shuffle."""

    cut = split_code if code else split_sentences

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            made = zip(*rows, strict=True) if rows else ([], [], [])
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["id", "position", "segment"])
            rows.clear()
            return b

        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):  # one text at a time, whatever a batch holds
                k, t = k.as_py(), t.as_py()
                for i, s in enumerate(cut(t, most)):
                    rows.append((k, i, s))
                    held += len(s)
                    if held > HELD or len(rows) > HELD // 64:
                        yield out()
                        held = 0
        yield out()

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "id long, position int, segment string")


def merge(df: DataFrame, source: str, order: list[str], text: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """source, position, segment: the segments of each source in order, merged as a stream (sources may be of any size)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, count = Merger(least, most), {}
        last = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for segment, key in rows:
                count[key] = count.get(key, -1) + 1
                out.append((key, count[key], segment))
            made = zip(*out, strict=True) if out else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["source", "position", "segment"])

        for b in batches:
            rows: list[tuple] = []
            for key, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != last:
                    rows += merger.end()
                    last = key
                rows += merger.feed(segment, key)
            yield batch(rows)
            count = {last: count.get(last, -1)}
        yield batch(list(merger.end()))

    rows = df.where(F.col(text).isNotNull()).select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"), *order)
    dealt = rows.repartition("source").sortWithinPartitions("source", *order).select("source", "text")
    return dealt.mapInArrow(work, "source string, position int, segment string")
