"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Spaces become markers, a marker is put before the text, and the marker starts every piece that has one, so the best
segmentation of a text is that of its marker-led segments, one by one. Distinct segments of a batch are segmented
together, a step of the trie for all of them at once; long ones one by one. Characters that no piece covers become byte
pieces. Of equal scores the one whose last piece is longest wins.

Defined results: null and empty texts have no pieces; a text that itself has the marker character decodes to a space
there (restored is false); rows with equal doc_id are encoded each for itself; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: What an unknown character costs beyond the worst piece; segments over LONG are done one by one; segments kept per worker.
PENALTY, LONG, KEPT = 10.0, 64, 200_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def load(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a SentencePiece model file."""
    out = []
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
    return out


class Trie:
    """Double array over character codes: from state s the code c leads to base[s] + c if check there is s; id and score of a state's piece."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        words = {p: (i, score) for i, (p, score, kind) in enumerate(pieces) if kind in (1, 4)}
        if any(MARK in p.lstrip(MARK) for p in words):
            raise ValueError("a piece has a marker after its start: segments would depend on each other")
        uses = Counter(c for p in words for c in p)
        letters = sorted(uses, key=lambda c: (-uses[c], c))  # frequent ones get low codes, so that states lie close together
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.bytes[int(p[3:5], 16)] = i
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.unknown_score = min(s for _, s in words.values()) - PENALTY
        size = 4 * len(letters) + 4 * sum(map(len, words))
        self.base, self.check, self.id, self.score = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -np.inf)
        nodes: dict[str, set[int]] = {"": set()}
        for p in words:
            for k in range(len(p)):
                nodes.setdefault(p[:k], set()).add(int(self.code[ord(p[k])]))
        place, free = {"": 0}, 1
        self.check[0] = -2
        for prefix in sorted(nodes, key=len):  # parents come first
            codes = np.array(sorted(nodes[prefix]))
            while self.check[free] != -1:
                free += 1
            base = self._room(codes, max(free, int(codes[0]) + 1))
            state = place[prefix]
            self.base[state] = base
            self.check[base + codes] = state
            for c in codes.tolist():
                word = prefix + letters[c - 1]
                if word in nodes:
                    place[word] = base + c
                if word in words:
                    self.id[base + c], self.score[base + c] = words[word]
        end = int(np.flatnonzero(self.check != -1)[-1]) + len(letters) + 2
        for name in ("base", "check", "id", "score"):
            setattr(self, name, np.resize(getattr(self, name), end) if end > size else getattr(self, name)[:end])

    def _room(self, codes: np.ndarray, start: int, window: int = 2048) -> int:
        """The first base from which all codes lead to free cells, the first of them at start or later."""
        while True:
            base = start + np.flatnonzero(self.check[start : start + window] == -1) - int(codes[0])
            for c in codes[1:]:
                base = base[self.check[base + c] == -1]
            if len(base):
                return int(base[0])
            start += window

    def many(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each of the words, none longer than LONG; -1-codepoint for a character that no piece covers."""
        n, width = len(words), max(map(len, words))
        points = np.zeros((n, width), np.int32)
        for i, w in enumerate(words):
            points[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
        codes, length = self.code[points], np.array([len(w) for w in words])
        codes[np.arange(width)[None, :] >= length[:, None]] = 0
        best, back, piece = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int64)
        best[:, 0] = 0
        for i in range(width):
            rows = np.flatnonzero(length > i)
            state, start = np.zeros(len(rows), np.int32), rows
            for j in range(i, width):
                to = self.base[state] + codes[rows, j]
                go = (self.check[to] == state) & (codes[rows, j] > 0)
                if j == i:
                    single = np.zeros(n, bool)
                    single[rows] = go & (self.id[to] >= 0)
                rows, state = rows[go], to[go]
                if not len(rows):
                    break
                score = best[rows, i] + self.score[state]
                up = score > best[rows, j + 1]
                r = rows[up]
                best[r, j + 1], back[r, j + 1], piece[r, j + 1] = score[up], i, self.id[state[up]]
            bare = start[~single[start]]
            score = best[bare, i] + self.unknown_score
            r = bare[score > best[bare, i + 1]]
            best[r, i + 1], back[r, i + 1], piece[r, i + 1] = best[r, i] + self.unknown_score, i, -1 - points[r, i]
        out, back, piece = [], back.tolist(), piece.tolist()
        for i, w in enumerate(words):
            at, ids = len(w), []
            while at:
                ids.append(piece[i][at])
                at = back[i][at]
            out.append(ids[::-1])
        return out

    def one(self, word: str) -> list[int]:
        """The same for a single word of any length."""
        n, base, check, ids, scores = len(word), self.base, self.check, self.id, self.score
        codes = self.code[np.frombuffer(word.encode("utf-32-le"), np.int32)].tolist()
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            state, single = 0, False
            for j in range(i, n):
                to = int(base[state]) + codes[j]
                if not codes[j] or check[to] != state:
                    break
                state = to
                if ids[state] >= 0:
                    single |= j == i
                    if (score := best[i] + float(scores[state])) > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = score, i, int(ids[state])
            if not single and (score := best[i] + self.unknown_score) > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = score, i, -1 - ord(word[i])
        out, at = [], n
        while at:
            out.append(piece[at])
            at = back[at]
        return out[::-1]

    def with_bytes(self, ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            else:
                fallback = self.bytes[list(chr(-1 - i).encode())].tolist()
                out += [self.unknown] if min(fallback) < 0 else fallback
        return out


def segments(text: str) -> list[str]:
    return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_batch(trie: Trie, texts: list[str | None], cache: dict[str, bytes]) -> list[np.ndarray]:
    """Ids of each text. cache keeps the ids of segments, little-endian, over batches."""
    parts = [segments(t or "") for t in texts]
    new = list({s for p in parts for s in p} - cache.keys())
    if len(cache) + len(new) > KEPT:
        cache.clear()
        new = list({s for p in parts for s in p})
    short = sorted((s for s in new if len(s) <= LONG), key=len)
    for at in range(0, len(short), 4096):
        chunk = short[at : at + 4096]
        for s, ids in zip(chunk, trie.many(chunk), strict=True):
            cache[s] = np.array(trie.with_bytes(ids), "<u4").tobytes()
    for s in new:
        if len(s) > LONG:
            cache[s] = np.array(trie.with_bytes(trie.one(s)), "<u4").tobytes()
    return [np.frombuffer(b"".join([cache[s] for s in p]), "<u4") for p in parts]


class Decoder:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(MARK, " ").encode() for p, _, kind in pieces]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.bytes[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_caches: dict[str, dict[str, bytes]] = {}  # a worker's, by model file


def encoded(docs: DataFrame, path: str, chunk: int = 200) -> DataFrame:
    """doc_id, ids, n_byte_pieces, restored (decoding gives the text again) for each row; no shuffle."""

    pieces = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((Trie(pieces), Decoder(pieces)))  # as large as the model file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (trie, decoder), cache = shared.value, _caches.setdefault(path, {})
        fallback = set(trie.bytes.tolist())
        low, high = min(fallback), max(fallback)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                b = batch.slice(at, chunk)
                texts = b.column(1).to_pylist()
                ids = encode_batch(trie, texts, cache)
                same = [decoder.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                n = [int(((i >= low) & (i <= high)).sum()) for i in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(same)], names=["doc_id", "ids", "n_byte_pieces", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, n_byte_pieces long, restored boolean")


def crc32(ids: DataFrame) -> DataFrame:
    """ids_crc32 of the ids as little-endian unsigned 32-bit numbers, beside n_pieces; the ids themselves go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            values, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            made = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(made, pa.int64()), b.column(2), b.column(3)], names=["doc_id", "n_pieces", "ids_crc32", "n_byte_pieces", "restored"])

    return ids.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_byte_pieces long, restored boolean")
