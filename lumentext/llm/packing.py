"""Tokenizing documents and packing them into sequences by the sum-of-squares rule.

Documents become token ids and one end id; longer ones are cut into pieces, the first of which may be shorter. Pieces are
dealt to groups of bounded size, and each group is packed by one task, longest piece first: a piece goes to the open bin
for which the sum of squares of the numbers of open bins by residual gap becomes smallest (a new bin only if none has room).
Bins that end with more than a small gap are dissolved, and what they held is packed again in fewer groups, until one is left.

Defined results: null text is an empty text (a piece of the end id alone); rows with equal doc_id, and equal rows, are
packed each for itself; a null doc_id is one more id; texts of any length, also of one word or of white space alone, are
encoded whole; an empty table gives an empty result; other columns, whatever their names, are not read. A group is what
one hash of doc_id, piece, digest and a salt by row deals to it, so rows that repeat often lie in several groups.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored, turn

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs at most (about); a bin with a larger gap than this is dissolved while there is a next level; parts that equal rows of one input task are dealt in.
GROUP, GAP, FEWER, SALTS = 100_000, 16, 64, 64
#: Distinct words of one generation a worker remembers (it has two), and the longest it remembers; characters of texts that are encoded together.
KEPT, LONG, TOGETHER = 400_000, 64, 1 << 17

# Fixed value: the split of byte-level BPE into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def _ranges(belongs: Callable[[str], bool]) -> str:
    """What stands in the brackets of a character class for all of the first 65,536 code points that belong."""
    hits = np.flatnonzero([belongs(chr(c)) for c in range(1 << 16)])
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
    return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)


def narrow_pattern() -> re.Pattern:
    """PATTERN for texts of the first 65,536 code points, in the standard library's faster matcher."""
    letter, number = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    space = _ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    rest = f" ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)|{rest}")


class Encoder:
    """Ids of a byte-level BPE file, all of them from the tokenizers library's default call.

    The library's ids of a text are those of its words, one after another, so each distinct word is given to the library
    once and remembered. When a generation of words is full, the one before it is forgotten, so words in use stay.
    Texts that hold an added token (found in whole texts) or a character that Unicode tables of different age see
    differently go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(open(path, encoding="utf-8").read())
        split = made["pre_tokenizer"]
        if made["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("not a plain byte-level BPE file: words would depend on each other")
        self.added = [t["content"] for t in made["added_tokens"]]
        self.words, self.narrow, self.wide = regex.compile(PATTERN, regex.V1), narrow_pattern(), re.compile("[\U00010000-\U0010ffff]")
        self.known, self.older, self.assigned = {}, {}, set()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of an id: its token has a character for each
        self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def _plain(self, text: str) -> bool:
        if any(a in text for a in self.added):
            return False
        new = set() if text.isascii() else set(text) - self.assigned
        if any(unicodedata.category(c) in ("Cn", "Cs") for c in new):
            return False
        self.assigned |= new
        return True

    def _each(self, words: list[str]) -> dict[str, bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word; words of letters stay apart behind a space or line break, so they are encoded as one text."""
        apart = []
        for w in words:
            if w[0] == " " and w[1:].isalpha():
                apart.append(w)
            elif w.isalpha():
                apart += "\n", w
        text = "".join(apart)
        if not apart or any(a in text for a in self.added):
            return self._each(words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(w.encode()) for w in apart])
        reached = np.cumsum(self.width[ids])
        at = np.searchsorted(reached, ends)
        if at[-1] >= len(ids) or (reached[at] != ends).any():
            return self._each(words)
        stops, data = ((at + 1) * 4).tolist(), ids.tobytes()
        made = {w: data[i:j] for w, i, j in zip(apart, [0, *stops], stops, strict=False)}
        if rest := [w for w in words if w not in made]:
            made |= self._each(rest)
        return made

    def __call__(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(self.many([text])[0], "<u4")

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. What is remembered is asked once for a word of all the texts, and what is new is learnt at once."""
        split = [((self.words if not t.isascii() and self.wide.search(t) else self.narrow).findall(t) if self._plain(t) else None) for t in texts]
        here = dict.fromkeys(chain.from_iterable(w for w in split if w))
        here = dict(zip(here, map(self.known.get, here), strict=True))
        if new := [w for w, ids in here.items() if ids is None]:
            if len(self.known) + len(new) > KEPT:
                self.older, self.known = self.known, {w: ids for w, ids in here.items() if ids is not None}
            made = {w: self.older[w] for w in new if w in self.older}
            if len(made) < len(new):
                made |= self._learn([w for w in new if w not in made])
            here |= made
            # words that are too long are not remembered beyond these texts
            self.known |= made if max(map(len, made)) <= LONG else {w: ids for w, ids in made.items() if len(w) <= LONG}
        whole = lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if words is None else b"".join(map(here.__getitem__, words)) for t, words in zip(texts, split, strict=True)]


def forget() -> None:
    _encoders.clear()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens."""
    first = n % size or size
    return [(0, min(n, first)), *((at, size) for at in range(first, n, size))]


def _together(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty), in lists of about TOGETHER characters."""
    texts, size = [], 0
    for x in column:
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield texts
            texts, size = [], 0
    yield texts


def tokenize(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("packing", forget)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            encoded = chain.from_iterable(map(encode.many, _together(b.column(1))))
            for doc, made in zip(b.column(0).to_pylist(), encoded, strict=True):
                ids = memoryview(made + end)
                spans = cut(len(ids) // 4, size)
                out[0] += [doc] * len(spans)
                out[1] += range(len(spans))
                out[2] += [start for start, _ in spans]
                out[3] += [n for _, n in spans]
                out[4] += [zlib.crc32(ids[4 * start : 4 * (start + n)]) for start, n in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length in the order given, and the gap of each bin at the end."""
    count = np.zeros(size + 1, dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        # change of the sum of squares, halved and less one, if s goes to a bin with gap s, s+1, ...; a full bin is closed
        gain = count[: size - s + 1] - count[s:]
        gain[0] = -count[s]
        gain[count[s:] == 0] = np.iinfo(np.int64).max
        g = s + int(gain.argmin())
        if count[g]:
            b = bins[g].pop()
            count[g] -= 1
        else:
            b, g = len(gaps), size
            gaps.append(size)
        where[i], offset[i], gaps[b] = b, size - g, g - s
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return where, offset, np.array(gaps, np.int64)


def _level(pieces: DataFrame, groups: int, level: int, size: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("packing", forget)
        from pyspark import TaskContext

        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not rows:
            return
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset, gaps = sum_of_squares(rows["length"].to_numpy(), size)
        done = (gaps[where] <= GAP) | last
        ids = where + ((TaskContext.get().partitionId() + (level << 20)) << 32)
        rows = rows.append_column("sequence_id", pa.array(ids, mask=~done)).append_column("offset", pa.array(offset))
        yield from rows.combine_chunks().to_batches(max_chunksize=20_000)

    salted = pieces.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    dealt = salted.repartition(groups, "deal").drop("deal")
    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(pieces: DataFrame, size: int = 1024, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces should be stored: they are counted, then read once."""
    n = pieces.count()
    groups, level, out = max(1, -(-n // group)), 0, None
    while True:
        done = stored(_level(pieces, groups, level, size, groups == 1), f"packed-{level}")
        sure = done.where("sequence_id IS NOT NULL")
        out = sure if out is None else out.union(sure)
        if groups == 1:
            return out
        pieces = done.where("sequence_id IS NULL").drop("sequence_id", "offset")
        groups, level = -(-groups // FEWER), level + 1
