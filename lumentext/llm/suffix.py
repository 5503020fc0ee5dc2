"""Removal of passages that repeat anywhere in the corpus, by a hash-compared suffix sort over sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. The suffixes that are sorted are chosen
by content: of the hashes of all K-byte strings within a window of LENGTH bytes the smallest are anchors, so two equal
windows have an anchor at the same place. Only anchors whose string comes twice or more go on, with the bytes around them.
Where two anchors have the same surroundings all windows there repeat; the others of one anchor string are sorted as
suffixes, forwards and backwards from the anchor, by a mergesort whose comparisons find the common extension by binary
search over prefix polynomial hashes. Sorted neighbours tell how far windows can repeat; those are compared by hash and
then byte by byte.

Work is keyed by text (128 bits of its SHA-256), so copies of a text are worked on once (a text of LENGTH bytes or more that
comes twice is removed as a whole). Defined results: null text is an empty text; shorter texts keep everything; rows with
equal doc_id, and null ones, are judged each for itself, each as one more copy of its text; texts may be of any length; an
empty table gives an empty result; other columns, whatever their names, are kept by `cleaned` and not read elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, shuffle_partitions, stored, text_key, turn

LENGTH, K = 200, 64
#: Window starts that an anchor can serve; bytes hashed at a time; contexts sorted at a time.
REACH, CHUNK, SORTED = LENGTH - K + 1, 1 << 18, 8000
#: Powers that are remembered of a base, at most; beyond, one is the product of two.
TABLE = 1 << 22
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**61, 2**63)) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        full = np.full(max(n, 2 * CHUNK), base, np.uint64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def forget() -> None:
    _powers.clear()


class Hashes:
    """Prefix polynomial hashes of a buffer; `of` gives the hash of any part, alike for equal parts."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for at in range(0, len(data), CHUNK):  # besides the sums, memory is taken for a chunk alone
            part = self.sums[at + 1 : at + 1 + CHUNK]
            np.multiply(_BYTE[data[at : at + CHUNK]], _power(_BASE, len(part)), out=part)
            part *= np.uint64(pow(_BASE, at, 2**64))
            np.cumsum(part, out=part)
            part += self.sums[at]
        self.table = _power(_INVERSE, min(len(data) + 1, TABLE))
        self.tables = np.array([pow(_INVERSE, at, 2**64) for at in range(0, len(data) + 1, TABLE)], np.uint64)

    def shift(self, start: np.ndarray) -> np.ndarray:
        return self.table[start] if len(self.tables) == 1 else self.table[start % TABLE] * self.tables[start // TABLE]

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.shift(start)

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to most, by binary search."""
        got, step = np.zeros(len(a), np.int64), 1 << (most.bit_length() - 1)
        while step:
            longer = got + step
            rows = np.flatnonzero(longer <= most)
            same = self.of(a[rows] + got[rows], step) == self.of(b[rows] + got[rows], step)
            got[rows[same]] += step
            step >>= 1
        return got

    def less(self, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at a comes before that at b, and whether they agree in most bytes."""
        n = self.common(a, b, most)
        equal = n == most
        end = len(self.data) - 1
        return ~equal & (self.data[np.minimum(a + n, end)] < self.data[np.minimum(b + n, end)]), equal

    def equal(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Byte by byte, for what the hashes call equal."""
        out = np.ones(len(a), bool)
        for k in range(n):
            out &= self.data[a + k] == self.data[b + k]
        return out


def suffix_sort(hashes: Hashes, starts: np.ndarray, block: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes within each block (rows of a block lie together): a bottom-up mergesort, all merges of a level at once."""
    n = len(starts)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    begin, length = np.repeat(first, size), np.repeat(size, size)
    order, width = np.arange(n), 1
    while n and width < size.max():
        at = np.arange(n) - begin
        run = at // width
        sibling = run ^ 1
        low = sibling * width
        high = np.minimum(low + width, length)
        rows = np.flatnonzero(low < length)
        lo, hi = low[rows].copy(), high[rows].copy()
        right = run[rows] % 2 == 1  # of equals, those of the left run come first
        mine, base = starts[order[rows]], begin[rows]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            other = starts[order[base[open_] + mid]]
            before, same = hashes.less(other, mine[open_], most)
            before |= same & right[open_]
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        to = np.arange(n)
        pair = (run[rows] // 2) * 2 * width
        to[rows] = base + pair + (at[rows] - run[rows] * width) + (lo - low[rows])
        merged = np.empty(n, np.int64)
        merged[to] = order
        order, width = merged, 2 * width
    return order


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i : i + n] for each i."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in data, whose documents lie in [starts, ends) one after another, and the hashes of their strings."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = Hashes(data)
    key = hashes.sums[K:] - hashes.sums[:-K]
    for at in range(0, len(key), TABLE):
        part = key[at : at + TABLE]
        part *= hashes.table[: len(part)]
        part *= hashes.tables[at // TABLE]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    rank = (key >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = _slide(rank, REACH, np.minimum)  # by window start
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(ends - LENGTH + 1, starts), -1)
    low[np.cumsum(inside)[: len(low)] <= 0] = 0  # windows that leave their document
    padded = np.zeros(len(low) + 2 * (REACH - 1), np.uint32)
    padded[REACH - 1 : REACH - 1 + len(low)] = low
    at = np.flatnonzero(_slide(padded, REACH, np.maximum)[: len(rank)] == rank)
    return at, key[at]


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK bytes."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, to
        at = to


def anchor_rows(texts: DataFrame) -> DataFrame:
    """hash, h1, h2, at for each anchor of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix", forget)
        for b in batches:
            column = b.column(2).cast(pa.large_binary())
            _, offsets, raw = column.buffers()
            ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, z in _pieces(ends):
                start = ends[a : z + 1] - ends[a]
                at, key = anchors(data[ends[a] : ends[z]], start[:-1], start[1:])
                doc = np.searchsorted(start, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h1[a + doc]), pa.array(h2[a + doc]), pa.array((at - start[doc]).astype(np.int32))], names=["hash", "h1", "h2", "at"])

    return texts.select("h1", "h2", "text").mapInArrow(run, "hash long, h1 long, h2 long, at int")


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose hash comes twice or more: sorted by hash, each is compared with its neighbours as the stream passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix", forget)
        kept, said = None, False  # the last row so far, and whether it was given out
        for b in batches:
            t = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks()
            if not t.num_rows:
                continue
            key = t.column(0).to_numpy()
            same = key[1:] == key[:-1]
            twin = np.r_[False, same] | np.r_[same, False]
            give = twin.copy()
            give[0] &= not said
            said = bool(twin[-1]) or (said and t.num_rows == 1)
            kept = t.slice(t.num_rows - 1).to_batches()[0]
            yield from t.filter(pa.array(give)).to_batches()

    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, rows.schema)


def contexts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """hash, left, context, h1, h2, places: the bytes around each repeated anchor, one row for each text and context."""
    by_text = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("hash", "at")).alias("anchors"))
    joined = texts.select("h1", "h2", "text").join(by_text, ["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix", forget)
        schema = pa.schema([("hash", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("places", pa.list_(pa.int32()))])
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                out: list[tuple] = []
                for h1, h2, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                    raw, own = text.as_py().encode(), {}
                    found = places.values
                    for key, at in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                        left = min(at, REACH - 1)
                        own.setdefault((key, left, raw[at - left : at + LENGTH]), []).append(at)
                    out += [(*k, h1, h2, v) for k, v in own.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return joined.select("h1", "h2", "text", "anchors").mapInArrow(run, "hash long, left int, context binary, h1 long, h2 long, places array<int>")


def _neighbours(hashes: Hashes, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """For each suffix the longest extension, up to most, that it has in common with another of its group: a neighbour in sorted order has it."""
    order = suffix_sort(hashes, starts, group, most)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    n = hashes.common(starts[a[near]], starts[b[near]], most)
    out = np.zeros(len(starts), np.int64)
    for side in (a[near], b[near]):
        np.maximum.at(out, side, n)
    return out


def windows(group: np.ndarray, left: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and the greatest distance of a repeated window's start before its anchor (REACH, -1: none).

    group: the anchor string of each context; equal ones lie together and their contexts differ. Sorting the suffixes before
    and after the anchors tells how far each agrees with any other at most; from those bounds inwards, the windows of a
    group at one distance are compared by hash and then byte by byte.
    """
    size = np.array([len(d) for d in data])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    raw = np.frombuffer(b"".join(data), np.uint8)
    raw = np.concatenate([raw, np.zeros(LENGTH, np.uint8)])
    anchor = begin + left
    # one after the other: the hashes of one direction are gone before those of the other are made
    before = _neighbours(Hashes(np.concatenate([raw[: size.sum()][::-1], np.zeros(LENGTH, np.uint8)])), size.sum() - anchor, group, LENGTH)
    hashes = Hashes(raw)
    after = _neighbours(hashes, anchor, group, LENGTH)
    high = np.minimum(np.minimum(left, REACH - 1), before)
    low = np.maximum(0, LENGTH - np.minimum(size - left, after))
    first = np.searchsorted(group, group, "left")

    def search(distances: range, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first of the distances, from low to high, at which each context's window repeats; REACH if none does. A group is looked at once a distance at most."""
        found = np.full(len(left), REACH, np.int64)
        for d in distances:
            active = (found == REACH) & (low <= d) & (d <= high)
            if not active.any():
                continue
            asked = np.zeros(len(left), bool)
            asked[first[active]] = True
            row = np.flatnonzero(asked[first] & (d <= left) & (LENGTH - d <= size - left))
            start = anchor[row] - d
            value = hashes.of(start, LENGTH)
            order = np.lexsort((value, first[row]))
            a, b = order[:-1], order[1:]
            same = np.flatnonzero((first[row[a]] == first[row[b]]) & (value[a] == value[b]))
            same = same[hashes.equal(start[a[same]], start[b[same]], LENGTH)]
            twin = row[np.unique(np.r_[a[same], b[same]])]
            found[twin[active[twin]]] = d
        return found

    most = search(range(REACH - 1, -1, -1), low, high)
    some = most < REACH
    least = search(range(REACH), np.where(some, low, REACH), np.where(some, most, -1))
    return least, np.where(some, most, -1)


def covered(rows: DataFrame) -> DataFrame:
    """h1, h2, start, end of what repeats, from stored or fresh contexts: groups of one hash stream by, equal contexts as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix", forget)
        held: list[list] = []  # distinct contexts of whole groups and the open one: [hash, left, context, rows, many]
        spans: list[tuple] = []

        def flush(rows: list[list]) -> None:
            sizes: dict[int, int] = {}
            for r in rows:
                sizes[r[0]] = sizes.get(r[0], 0) + 1
            rest = [r for r in rows if sizes[r[0]] > 1]
            if rest:
                number = {h: i for i, h in enumerate(dict.fromkeys(r[0] for r in rest))}
                least, most = windows(np.array([number[r[0]] for r in rest]), np.array([r[1] for r in rest]), [r[2] for r in rest])
                for r, lo, hi in zip(rest, least.tolist(), most.tolist(), strict=True):
                    if not r[4] and hi >= 0:
                        spans.extend((h1, h2, p - hi, p - lo + LENGTH) for h1, h2, places in r[3] for p in places)

        def out() -> pa.RecordBatch:
            made = zip(*spans, strict=True) if spans else ([], [], [], [])
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types, strict=True)], names=["h1", "h2", "start", "end"])
            spans.clear()
            return b

        for b in batches:
            for key, left, context, h1, h2, places in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                whole = lambda row, left=left, n=len(context): [(row[0], row[1], p - left, p - left + n) for p in row[2]]
                last = held[-1] if held else None
                if last and last[0] == key and last[1] == left and last[2] == context:
                    if not last[4]:
                        last[4] = True
                        if len(context) >= LENGTH:
                            spans.extend(s for r in last[3] for s in whole(r))
                        last[3] = []
                    if len(context) >= LENGTH:
                        spans.extend(whole((h1, h2, places)))
                    continue
                if last and last[0] != key and len(held) >= SORTED:
                    flush(held)
                    held = []
                many = len(places) > 1
                if many and len(context) >= LENGTH:
                    spans.extend(whole((h1, h2, places)))
                held.append([key, left, context, [] if many else [(h1, h2, places)], many])
            yield out()
        flush(held)
        yield out()

    dealt = rows.repartition("hash").sortWithinPartitions("hash", "left", "context")
    return dealt.mapInArrow(run, "h1 long, h2 long, start int, end int")


def _keyed(docs: DataFrame, *others: str) -> DataFrame:
    """The named columns, text, h1 and h2: the key of the text."""
    rows = docs.select(*others, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
    return rows.select(*others, "text", F.col("key.k1").alias("h1"), F.col("key.k2").alias("h2"))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """h1, h2, text, copies, as a table bucketed by its key (it is joined twice, and the texts need no further shuffle), and its name."""
    spark = docs.sparkSession
    found = _keyed(docs.select("text")).groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    n = shuffle_partitions(spark)
    name = f"lumentext_texts_{uuid.uuid4().hex}"
    found.repartition(n, "h1", "h2").write.bucketBy(n, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
    return spark.table(name), name


def spans(texts: DataFrame) -> DataFrame:
    """h1, h2, spans of what repeats of each of the distinct texts that is no copy as a whole, stored."""
    long = texts.where(F.octet_length("text") >= LENGTH)
    found = stored(repeated(anchor_rows(long)), "suffix-anchors")
    made = stored(covered(contexts(long, found)), "suffix-spans")
    discard(found)
    out = stored(made.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "suffix-spans-by-text")
    discard(made)
    return out


def merge(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans_):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut(docs: DataFrame, texts_too: bool) -> DataFrame:
    """h1, h2, kept_sha256, n_bytes, n_removed, n_spans of each distinct text, stored, and if wanted the text that is left (of changed texts); what it was made from is removed."""
    texts, name = distinct_texts(docs)
    found = spans(texts)
    joined = texts.join(found, ["h1", "h2"], "left").select("h1", "h2", "text", "copies", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix", forget)
        names = ["h1", "h2", "kept_sha256", "text", "n_bytes", "n_removed", "n_spans"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b, out = batch.slice(start, 500), []
                for h1, h2, text, copies, found_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4), strict=True):
                    raw = text.as_py().encode()
                    if copies > 1 and len(raw) >= LENGTH:
                        gone = [(0, len(raw))]
                    elif found_.is_valid:
                        gone = merge(list(zip(found_.values.field(0).to_pylist(), found_.values.field(1).to_pylist(), strict=True)))
                    else:
                        gone = []
                    edges = [0, *(x for g in gone for x in g), len(raw)]
                    left = [raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)] if gone else [raw]
                    kept = b"".join(left)
                    # of a character that was cut in two, neither part is text
                    text = "".join([x.decode("utf-8", "ignore") for x in left]) if texts_too and gone else None
                    out.append((h1, h2, hashlib.sha256(kept).hexdigest(), text, len(raw), len(raw) - len(kept), len(gone)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    made = joined.mapInArrow(run, "h1 long, h2 long, kept_sha256 string, text string, n_bytes long, n_removed long, n_spans long")
    out = stored(made.where("n_removed > 0").select("h1", "h2", "text") if texts_too else made.drop("text"), "suffix-cut")
    discard(found)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    made = cut(docs, False)
    return _keyed(docs.select("doc_id", "text"), "doc_id").drop("text").join(made, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages; a character cut in two goes as a whole, null texts stay null, documents without text left stay as empty ones."""
    made = cut(docs, True)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_key(docs["text"]).alias("key"))
    joined = rows.join(made, (F.col("key.k1") == F.col("h1")) & (F.col("key.k2") == F.col("h2")), "left")
    text = F.when(F.col("h1").isNull() | F.col("row")["text"].isNull(), F.col("row")["text"]).otherwise(F.col("text"))
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
