"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document is the set of its 5-word shingles, and documents of equal sets are one node, so copies cost nothing. The forest
keeps TREES sorted orders of the signature: in each, nodes lie in the order of the values of one rotation of it. Nodes that
share the first DEPTH values are a region (nodes of different regions have less in common than a link needs in one tree).
First every node is compared with its neighbours in each order, which have the longest common prefix with it, and with the
first of its region; what is similar on full sets is linked, and links make components.

Then the depth is adapted to the region. Where one holds nodes of several components and few pairs across them, those whose
sizes and signatures allow the similarity are compared on full sets, where the region lies; only links come out. A crowded
region is itself a smaller forest: its members are sorted anew in BRANCHES orders of DEPTH further values each, and so on, up
to LEVELS levels, after which a region is compared whatever its size. A pair of the least similarity misses all regions of
the first level with odds of (1 - 0.75**3)**32, about 2 in 10**8, and those of a crowded one with (1 - 0.75**3)**16, about
2 in 10**4, in each of the 13 trees or so where it lies.

Defined results: null text, or text without a word, has an empty set and is linked with nothing; a text of fewer words than
a shingle is one shingle; rows with equal doc_id are one node if their sets are equal, else several; a null doc_id never
names a component unless all ids of it are null (component_id is null then) and is never `kept`; an empty table gives an
empty result; other columns, whatever their names, are not read. `deduplicated` drops only members of a group that another
row stands for: it keeps one row of each component, that of the smallest doc_id (nulls last), then of the smallest key of its
text, and all rows without a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, small, stored, text_key, turn

WORDS, PERCENT = 5, 75
TREES, DEPTH = 32, 3
#: Values of a signature beyond DEPTH that a region is sorted by.
FURTHER = 5
#: A region is crowded from so many members, or pairs across components, or characters of text on; its orders one level deeper; levels.
CROWD, PAIRS, CHARACTERS, BRANCHES, LEVELS = 10_000, 1 << 25, 1 << 26, 16, 3
VALUES = TREES * DEPTH
#: Of VALUES signature values so many must agree before a pair of a region is compared: 5.6 standard deviations below the mean at the least similarity.
AGREE = VALUES // 2
#: Pairs of a region that are gathered before their full sets meet.
AT_ONCE = 1 << 22
CHUNK = 1 << 18
_rng = np.random.default_rng(20240502)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**61, 2**63)) | 1
_STEP = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        full = np.full(max(n, 2 * CHUNK), base, np.uint64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and how many each has. ends: where documents begin and end in data."""
    data = _LOWER[data]
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    inner = ~gap[1:]
    inner[-1] = False
    starts = np.flatnonzero(inner[: len(data) + 1] & (gap[:-1] | edge))
    stops = np.flatnonzero(~gap[:-1] & (gap[1:] | edge))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    word = _mix((sums[stops] - sums[starts]) * _power(pow(_BASE, -1, 2**64), len(data) + 1)[starts] + (stops - starts).astype(np.uint64))
    first = np.searchsorted(starts, ends)  # of each document's words
    n = np.diff(first)
    pad = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    key = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        key += pad[k : k + len(word)] * _STEP[k]
    doc = np.repeat(np.arange(len(n)), n)
    left = first[1:][doc] - np.arange(len(word))
    few = (n < WORDS)[doc]
    if few.any():  # the whole sequence is one shingle
        at = np.flatnonzero(few)
        place = at - first[:-1][doc[at]]
        whole = np.zeros(len(n), np.uint64)
        np.add.at(whole, doc[at], word[at] * _STEP[place])
        head = at[place == 0]
        key[head] = whole[doc[head]] + n[doc[head]].astype(np.uint64)
        left[head] = WORDS
    use = left >= WORDS
    key, doc = _mix(key[use]), doc[use]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[fresh], np.bincount(doc[fresh], minlength=len(n))


def shingles_of(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return shingles(raw, np.array([0, len(raw)]))[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the text's key), n_shingles, s1, s2 (a hash of the set), signature (VALUES unsigned 32-bit numbers, null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        for b in batches:
            column = b.column(3).cast(pa.large_binary())
            _, offsets, raw = column.buffers()
            all_ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(all_ends, all_ends[at] + CHUNK, "right")) - 1)
                ends = all_ends[at : to + 1] - all_ends[at]
                key, n = shingles(data[all_ends[at] : all_ends[to]], ends)
                some, first = np.flatnonzero(n), np.r_[0, np.cumsum(n)[:-1]]
                s1, s2, sig = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), VALUES), ">u4")
                if len(key):
                    begin = first[some]
                    s1[some], s2[some] = np.add.reduceat(_mix(key), begin), np.add.reduceat(_mix(key * np.uint64(3)), begin)
                    for k in range(VALUES):
                        sig[some, k] = np.minimum.reduceat((key * _HASH[k]) >> np.uint64(32), begin)
                shown = [s.tobytes() if m else None for s, m in zip(sig, n.tolist(), strict=True)]
                made = [*[b.column(i).slice(at, to - at) for i in range(3)], pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(shown, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "signature"])
                at = to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs["text"]).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "key.k1", "key.k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, signature binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, VALUES)


def _order(level: int, branch: int) -> np.ndarray:
    """The places of the signature's values in one order: a rotation for each tree of the first level, a shuffle for each deeper branch."""
    if level == 0:
        return (np.arange(VALUES) + branch * DEPTH) % VALUES
    return np.random.default_rng((20240503, level, branch)).permutation(VALUES)


def _region(parent: np.ndarray, level: int, branch: int, sig: np.ndarray) -> np.ndarray:
    """The region of each node in one order: what lies above it, the order, and its first DEPTH values."""
    key = parent * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level * 64 + branch + 1)
    for k in _order(level, branch)[:DEPTH]:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k].astype(np.uint64))
    return key


def forest(nodes: DataFrame) -> DataFrame:
    """region, deeper (the values that follow in that order, as bytes that sort alike), id: a row for each node and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                sig, none = _signatures(b.column(1)), np.zeros(b.num_rows, np.uint64)
                for t in range(TREES):
                    after = np.ascontiguousarray(sig[:, _order(0, t)[DEPTH : DEPTH + FURTHER]])
                    deeper = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * FURTHER), len(after), [None, pa.py_buffer(after.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(_region(none, 0, t, sig).view(np.int64)), deeper, b.column(0)], names=["region", "deeper", "id"])

    return nodes.select("id", "signature").mapInArrow(run, "region long, deeper binary, id long")


def neighbours(rows: DataFrame) -> DataFrame:
    """region, a, b with a < b: pairs of neighbours in an order and of a region's first and each other member (region null); and a = b = id for each member of a region of three or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        head = before = None  # the first and the last member so far of the open region: (region, id), and how many it has
        count, waiting = 0, []
        for b in batches:
            key, ids = b.column(0).to_numpy(), b.column(2).to_numpy()
            if not len(key):
                continue
            a_, b_, region, member = [], [], [], []
            new = np.r_[before is None or key[0] != head[0], key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            # members of the open region, which began in an earlier batch
            edges = [0, *(first[first > 0]).tolist(), len(key)]
            for s, e in zip(edges, edges[1:], strict=False):
                mine = ids[s:e]
                if new[s]:
                    head, count, waiting = (key[s], mine[0]), 0, []
                    chain = mine
                else:
                    chain = np.r_[before, mine]
                a_.append(chain[:-1])
                b_.append(chain[1:])
                far = mine[2 - min(count, 2) :] if count < 2 else mine
                a_.append(np.full(len(far), head[1]))
                b_.append(far)
                count += len(mine)
                if count > 2:
                    shown = np.r_[np.array(waiting, np.int64), mine]
                    waiting = []
                    region.append(np.full(len(shown), head[0]))
                    member.append(shown)
                else:
                    waiting += mine.tolist()
                before = mine[-1]
            a, c = np.concatenate(a_), np.concatenate(b_)
            a, c = np.minimum(a, c)[a != c], np.maximum(a, c)[a != c]
            some = np.concatenate(member) if member else np.zeros(0, np.int64)
            key_ = np.concatenate(region) if region else np.zeros(0, np.int64)
            made = pa.array(np.r_[np.zeros(len(a), np.int64), key_], mask=np.r_[np.ones(len(a), bool), np.zeros(len(key_), bool)])
            yield pa.RecordBatch.from_arrays([made, pa.array(np.r_[a, some]), pa.array(np.r_[c, some])], names=["region", "a", "b"])

    dealt = rows.repartition("region").sortWithinPartitions("region", "deeper", "id")
    return dealt.mapInArrow(run, "region long, a long, b long")


def texts_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the nodes among ids (stored): a node's text is that of its key, whichever row has it; only these texts are shuffled."""
    wanted = stored(nodes.join(small(ids, 500_000), "id", "left_semi").select("id", "k1", "k2"), "neardup-wanted")
    keyed = docs.select(text_key(docs["text"]).alias("key"), F.col("text").cast("string").alias("text")).select("key.k1", "key.k2", "text")
    return keyed.join(small(wanted, 500_000), ["k1", "k2"]).groupBy("id").agg(F.first("text").alias("text"))


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on full sets. pairs: stored."""
    involved = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "neardup-involved")
    texts = stored(texts_of(docs, nodes, involved), "neardup-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        last, known = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                for a, z, ta, tb in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                    if a != last:
                        last, known = a, shingles_of(ta.as_py())
                    if similar(known, shingles_of(tb.as_py())):
                        out.append((a, z))
            made = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["a", "b"])

    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    out = stored(both.mapInArrow(run, "a long, b long").distinct(), "neardup-edges")
    discard(texts, involved)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id, component of every id in edges (a, b): large-star and small-star in turn until only stars around the smallest ids are left."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    while True:
        # stars: no id has two centres, and no centre is itself in another star
        ends = now.groupBy("u").agg(F.count("*").alias("n")).withColumn("v", F.col("u"))
        wrong = ends.join(now.select("v").distinct().withColumn("centre", F.lit(1)), "v", "left").where("n > 1 OR centre = 1")
        if wrong.isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        ways = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(star.where("u != v").distinct(), "star")


def shingled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and how many each has."""
    raw = [(t or "").encode() for t in texts]
    ends = np.r_[0, np.cumsum([len(x) for x in raw], dtype=np.int64)]
    made, at = [], 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        made.append(shingles(np.frombuffer(b"".join(raw[at:to]), np.uint8), ends[at : to + 1] - ends[at]))
        at = to
    return np.concatenate([key for key, _ in made]), np.concatenate([n for _, n in made])


def _agreeing(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many values of each row are those of one: the truth bytes are added up eight at a time."""
    words = (rows == one).view(np.uint64)
    return (words.sum(axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)


def links(comp: np.ndarray, ids: np.ndarray, size: np.ndarray, sig: np.ndarray, text: list[str]) -> Iterator[tuple[int, int]]:
    """Links that join different components within one region; each pair that sizes and signatures allow is compared on full sets, unless
    other links have joined its components. A set meets all that it may be similar to at once: its shingles are marked, theirs looked up."""
    order = np.argsort(size, kind="stable")
    comp, ids, size, sig = comp[order], ids[order].tolist(), size[order], np.ascontiguousarray(sig[order]).astype(np.uint32)
    text = [text[i] for i in order.tolist()]
    part = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while part[c] != c:
            part[c] = c = part[part[c]]
        return c

    named = comp.tolist()

    def among(waiting: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        place = np.full(len(ids), -1)
        used = np.unique(np.concatenate([x for i, other in waiting for x in ([i], other)]))
        place[used] = np.arange(len(used))
        keys, n = shingled([text[i] for i in used.tolist()])
        ends = np.r_[0, np.cumsum(n)]
        number = np.unique(keys, return_inverse=True)[1]
        sets_ = np.split(number, ends[1:-1])
        marked = np.zeros(len(keys), bool)
        for i, other in waiting:
            own, at = sets_[place[i]], place[other]
            marked[own] = True
            both = np.add.reduceat(marked[np.concatenate([sets_[k] for k in at.tolist()])], np.r_[0, np.cumsum(n[at])[:-1]], dtype=np.int64)
            marked[own] = False
            for j in other[100 * both >= PERCENT * (len(own) + n[at] - both)].tolist():
                if (x := find(named[i])) != (y := find(named[j])):
                    part[max(x, y)] = min(x, y)
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])

    waiting, pairs = [], 0
    for i in range(len(ids) - 1):
        to = int(np.searchsorted(size, size[i] * 100 // PERCENT, "right"))
        other = i + 1 + np.flatnonzero(comp[i + 1 : to] != comp[i])
        if 2 * len(other) > to - i - 1:  # a slice needs no copy
            other = other[_agreeing(sig[i + 1 : to], sig[i])[other - i - 1] >= AGREE]
        else:
            other = other[_agreeing(sig[other], sig[i]) >= AGREE]
        if len(other):
            waiting.append((i, other))
            pairs += len(other)
        if pairs > AT_ONCE:
            yield from among(waiting)
            waiting, pairs = [], 0
    if waiting:
        yield from among(waiting)


def mixed(members: DataFrame) -> DataFrame:
    """region, crowded of the regions (region, id, component, chars) that hold several components."""
    by = members.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    n, square = F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))
    sums = by.groupBy("region").agg(F.count("*").alias("parts"), n.alias("n"), ((n.cast("double") * n - square) / 2).alias("pairs"), F.sum("chars").alias("chars"))
    return sums.where("parts > 1").select("region", ((F.col("n") > CROWD) | (F.col("pairs") > PAIRS) | (F.col("chars") > CHARACTERS)).alias("crowded"))


def deepened(members: DataFrame, level: int) -> DataFrame:
    """The members (region, id, component, signature) of crowded regions, each in BRANCHES regions one level deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                sig, parent = _signatures(b.column(3)), b.column(0).to_numpy().view(np.uint64)
                for t in range(BRANCHES):
                    yield pa.RecordBatch.from_arrays([pa.array(_region(parent, level, t, sig).view(np.int64)), b.column(1), b.column(2), b.column(4)], names=["region", "id", "component", "chars"])

    return members.select("region", "id", "component", "signature", "chars").mapInArrow(run, "region long, id long, component long, chars long")


def compared(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: links across components within the regions of members (region, id, component), stored. From no region come more rows than it has components."""
    involved = stored(members.select("id").distinct(), "neardup-mixed-ids")
    texts = stored(texts_of(docs, nodes, involved), "neardup-mixed-texts")
    rows = members.join(nodes.select("id", "n_shingles", "signature").join(texts, "id"), "id").select("region", "component", "id", "n_shingles", "signature", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        held: list[pa.RecordBatch] = []
        open_ = None

        def out() -> pa.RecordBatch:
            made: list[tuple[int, int]] = []
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                made = list(links(t["component"].to_numpy(), t["id"].to_numpy(), t["n_shingles"].to_numpy(), _signatures(t["signature"].chunk(0)), t["text"].to_pylist()))
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else ([], []))], names=["a", "b"])

        for b in batches:
            key = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if key[s] != open_:
                        yield out()
                        open_ = key[s]
                    held.append(b.slice(s, e - s))
        yield out()

    made = stored(rows.repartition("region").sortWithinPartitions("region", "id").mapInArrow(run, "a long, b long").distinct(), "neardup-links")
    discard(involved, texts)
    return made


def leftover(docs: DataFrame, members: DataFrame, nodes: DataFrame, parts: DataFrame) -> list[DataFrame]:
    """Tables of a, b: confirmed links between nodes of one region (members: region, id) but different components (parts: id, component), level by level."""
    parts = parts.withColumnRenamed("id", "part_id")
    size = nodes.select(F.col("id").alias("size_id"), "chars")
    found: list[DataFrame] = []
    now = members.join(size, members["id"] == size["size_id"]).join(parts, members["id"] == parts["part_id"], "left").select("region", "id", F.coalesce("component", "id").alias("component"), "chars")
    for level in range(1, LEVELS + 1):
        now = stored(now, f"neardup-members-{level}")
        kind = stored(mixed(now), f"neardup-regions-{level}")
        crowded = kind.where("crowded").select("region")
        last = level == LEVELS or crowded.isEmpty()
        simple = kind.where(F.lit(last) | ~F.col("crowded")).select("region")
        found.append(compared(docs, nodes, stored(now.join(small(simple), "region", "left_semi"), f"neardup-simple-{level}")))
        if last:
            discard(now)
            return found
        rest = now.join(small(crowded), "region", "left_semi").join(nodes.select("id", "signature"), "id")
        now = deepened(rest, level)
    return found


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of each row (see sets), and s1, s2, component (any number), smallest (doc_id of it, null if all are null) of each set; both stored."""
    found = stored(sets(docs), "neardup-sets")
    full = found.where("n_shingles > 0")
    one = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("k1", "k2")).alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = stored(one.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", "doc_id", "key.k1", "key.k2", "n_shingles", (F.col("n_shingles") * 8).alias("chars"), "signature"), "neardup-nodes")
    near = stored(neighbours(forest(nodes)), "neardup-near")
    first = stored(near.where("region IS NULL").select("a", "b").distinct(), "neardup-first")
    edges = confirmed(docs, nodes, first)
    parts = stored(components(edges), "neardup-parts")
    extra = leftover(docs, near.where("region IS NOT NULL").select("region", F.col("a").alias("id")), nodes, parts)
    for e in extra:
        edges = edges.union(e)
    parts = stored(components(edges), "neardup-parts")
    named = nodes.join(parts, "id", "left").select("s1", "s2", "doc_id", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    out = stored(named.join(least, "component").select("s1", "s2", "component", "smallest"), "neardup-classes")
    discard(nodes, near, first)
    return found, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    found, by_set = classes(docs)
    named = found.drop("signature").join(by_set, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that another row of their component stands for."""
    found, by_set = classes(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    one = found.where("n_shingles > 0").join(by_set, ["s1", "s2"]).select("component", place.alias("place"))
    one = one.groupBy("component", "place").agg(F.count("*").alias("n")).groupBy("component").agg(F.min(F.struct("place", "n")).alias("best"))
    empty = found.where("n_shingles = 0").select("doc_id", "k1", "k2").distinct().withColumn("n", F.lit(1))
    stay = stored(one.select("best.place.doc_id", "best.place.k1", "best.place.k2", "best.n").unionByName(empty), "neardup-stay")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_key(docs["text"]).alias("key"), docs["doc_id"].cast("long").alias("own"))

    def those(wanted: DataFrame) -> DataFrame:
        named = wanted.select(F.col("doc_id").alias("stay_id"), "k1", "k2")
        return rows.join(named, F.col("own").eqNullSafe(F.col("stay_id")) & (F.col("key.k1") == F.col("k1")) & (F.col("key.k2") == F.col("k2")), "left_semi")

    repeated = small(stay.where("n > 1"))
    one = those(repeated).dropDuplicates(["own", "key"])
    return those(stay.where("n = 1")).union(one).select("row.*")
