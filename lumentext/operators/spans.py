"""Span candidates of sequences and statistics over spans [start, end)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import dealt

TAU_VOCAB, TAU_COMP, LONGEST_COMPOSED = 1e-4, 1e-6, 20


def enumerate_spans(sequences: DataFrame, w_max: int) -> DataFrame:
    """seq_id, start, end, span for every span of at most w_max characters."""
    at = sequences.where(F.length("text") > 0).select("seq_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("start"))
    most = F.least(F.lit(w_max), F.length("text") - F.col("start"))
    every = at.select("seq_id", "text", "start", F.explode(F.sequence(F.col("start") + 1, F.col("start") + most)).alias("end"))
    return every.select("seq_id", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))


def best_product(span: str, p: dict[str, float], longest: int) -> float:
    """The largest product of piece probabilities over all segmentations."""
    best = [1.0] + [0.0] * len(span)
    for j in range(1, len(span) + 1):
        for i in range(max(0, j - longest), j):
            if best[i] and (q := p.get(span[i:j])) and best[i] * q > best[j]:
                best[j] = best[i] * q
    return best[-1]


def aligned(spans: DataFrame, vocab: DataFrame, tau: float = TAU_VOCAB) -> DataFrame:
    """Spans that are pieces of probability tau at least. Few pieces can have it: 1 / tau."""
    return spans.join(F.broadcast(vocab.where(F.col("prob") >= tau).select(F.col("piece").alias("span"))), "span", "left_semi").select("seq_id", "start", "end", "span")


#: Characters of sequences, and rows, that a task works on at a time.
CHARS, ROWS = 1 << 16, 1 << 18


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of at most CHARS characters (column 1) at a time, or of one row."""
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        size = np.cumsum([0, *map(len, columns[1])])
        at = 0
        while at < len(size) - 1:
            to = max(at + 1, int(np.searchsorted(size, size[at] + CHARS, "right")) - 1)
            yield [c[at:to] for c in columns]
            at = to


def _rows(seq_id: np.ndarray, start: np.ndarray, end: np.ndarray, *more: pa.Array, names: tuple = ("seq_id", "start", "end")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seq_id, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *more], names=list(names))


def pieces_in(sequences: DataFrame, vocab: DataFrame, w_max: int, tau: float = TAU_VOCAB) -> DataFrame:
    """seq_id, start, end of the spans of at most w_max characters that are pieces of probability tau at least: `aligned`, without a row for any other span."""
    good = frozenset(vocab.where(F.col("prob") >= tau).select("piece").toArrow().column(0).to_pylist())
    shared, longest = sequences.sparkSession.sparkContext.broadcast(good), min(w_max, max(map(len, good), default=0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = shared.value
        for ids, texts in _slices(batches):
            found = [(i, s, s + k) for i, t in zip(ids, texts, strict=True) for k in range(1, longest + 1) for s in range(len(t) - k + 1) if t[s : s + k] in good]
            for at in range(0, len(found), ROWS):
                yield _rows(*np.array(found[at : at + ROWS], np.int64).T)

    return dealt(sequences.select("seq_id", "text"), "seq_id").mapInArrow(work, "seq_id long, start int, end int")


class Phrases:
    """Spans of texts that lie one after another, as `is_whole_phrase` sees their shapes: of those that start at s, all ends
    in (first[s], until[s]] make a phrase, and any later end after no letter or digit, if s has none either."""

    def __init__(self, shapes: list[str], w_max: int) -> None:
        size = np.fromiter(map(len, shapes), np.int64, len(shapes))
        kind = np.frombuffer("".join(shapes).encode("ascii"), np.uint8)
        n = len(kind)
        self.at, self.head = np.arange(n), np.cumsum(size) - size
        self.stop = np.cumsum(size).repeat(size)
        core, bare = (kind != 32) & (kind != 9), kind != 97

        def following(wanted: np.ndarray) -> np.ndarray:
            return np.minimum.accumulate(np.r_[np.where(wanted, self.at, n), n][::-1])[::-1]

        to_core = following(core)
        self.first = np.minimum(to_core[:-1], self.stop)
        blank = np.minimum(following(kind == 32)[self.first], self.stop)
        word = np.minimum(to_core[blank], self.stop)  # here a second word of the core begins
        plain = np.minimum(following(kind == 46)[:-1], self.stop)
        self.limit = np.minimum(self.at + w_max, self.stop)
        self.until = np.minimum(np.maximum(word, plain), self.limit)
        self.bare = bare

    def whole(self, k: int) -> np.ndarray:
        """For each place whether the k characters from there, which must lie in its text, are a whole phrase."""
        end = self.at + k
        last = np.r_[self.bare[k - 1 :], np.zeros(min(k - 1, len(end)), bool)][: len(end)]
        return (end <= self.limit) & (end > self.first) & ((end <= self.until) | (self.bare & last))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """How many spans that start at each place are whole phrases, and the sum of their lengths."""
        first, until = np.minimum(self.first, self.limit), self.until
        n = np.maximum(until - first, 0)
        length = (first + 1 + until - 2 * self.at) * n // 2
        later = np.maximum(until, first)
        bare, places = np.r_[0, self.bare.cumsum()], np.r_[0, np.where(self.bare, self.at + 1, 0).cumsum()]
        more = np.where(self.bare, bare[self.limit] - bare[later], 0)
        return n + more, length + np.where(self.bare, places[self.limit] - places[later], 0) - self.at * more


class Composed:
    """Spans of texts that lie one after another: which are a good piece, or pieces make with probability tau at least."""

    def __init__(self, texts: list[str], good: frozenset, p: dict[str, float], tau: float) -> None:
        self.good, self.tau = good, tau
        self.text = "".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.room = np.cumsum(size).repeat(size) - np.arange(len(self.text))
        self.longest = max(map(len, p), default=0)
        pad = LONGEST_COMPOSED
        self.p = [np.r_[np.where(self.room >= k, [p.get(self.text[i : i + k], 0.0) for i in range(len(self.text))], 0.0), np.zeros(pad)] for k in range(1, min(self.longest, pad) + 1)]
        self.best = [np.ones(len(self.text))]  # the largest product over all segmentations of the k characters from each place

    def has(self, k: int) -> np.ndarray:
        """For each place whether the k characters from there are such a span; k goes up from 1, one by one."""
        n = len(self.text)
        found = self.room >= k
        piece = np.fromiter((self.text[i : i + k] in self.good for i in range(n)), bool, n) if k <= max(map(len, self.good), default=0) else np.zeros(n, bool)
        if k <= LONGEST_COMPOSED:
            best = np.zeros(n)
            for last in range(1, min(self.longest, k) + 1):
                np.maximum(best, self.best[k - last] * self.p[last - 1][k - last : k - last + n], out=best)
            self.best.append(best)
            piece |= best >= self.tau
        return found & piece


def _candidate_work(sequences: DataFrame, vocab: DataFrame, probabilities: dict[str, float], w_max: int, tau_vocab: float, tau_comp: float):
    """What to read (seq_id, text, shape), and a function from texts and shapes to Phrases, Composed and the largest length that Composed may add."""
    good = frozenset(vocab.where(F.col("prob") >= tau_vocab).select("piece").toArrow().column(0).to_pylist())
    # probabilities only shrink a product: a piece below tau can be part of no span that reaches it
    shared = sequences.sparkSession.sparkContext.broadcast((good, {u: q for u, q in probabilities.items() if q >= tau_comp}))
    most = min(w_max, max(LONGEST_COMPOSED, max(map(len, good), default=0)))
    given = dealt(sequences.where(F.length("text") > 0).select("seq_id", "text"), "seq_id").select("seq_id", "text", T.shape(F.col("text")).alias("shape"))
    return given, most, lambda texts, shapes: (Phrases(shapes, w_max), Composed(texts, *shared.value, tau_comp))


def candidates(sequences: DataFrame, vocab: DataFrame, probabilities: dict[str, float], w_max: int, tau_vocab: float = TAU_VOCAB, tau_comp: float = TAU_COMP) -> DataFrame:
    """seq_id, start, end, span of the spans that are a piece, a whole phrase, or composable."""
    given, most, made = _candidate_work(sequences, vocab, probabilities, w_max, tau_vocab, tau_comp)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, shapes in _slices(batches):
            phrases, composed = made(texts, shapes)
            owner = np.arange(len(texts)).repeat([*map(len, texts)])
            ids = np.array(ids, np.int64)
            for k in range(1, min(w_max, max(map(len, texts))) + 1):
                at = np.flatnonzero(phrases.whole(k) | composed.has(k) if k <= most else phrases.whole(k))
                start = at - phrases.head[owner[at]]
                yield _rows(ids[owner[at]], start, start + k, pa.array([composed.text[i : i + k] for i in at.tolist()], pa.string()), names=("seq_id", "start", "end", "span"))

    return given.mapInArrow(work, "seq_id long, start int, end int, span string")


def _counted(seq_id: list, head: np.ndarray, n: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """n_spans and total_len of the sequences that have a span."""
    n, length = np.add.reduceat(n, head), np.add.reduceat(length, head)
    return pa.RecordBatch.from_arrays([pa.array(np.array(seq_id, np.int64)[n > 0]), pa.array(n[n > 0]), pa.array(length[n > 0])], names=["seq_id", "n_spans", "total_len"])


def phrase_counts(sequences: DataFrame, w_max: int) -> DataFrame:
    """seq_id, n_spans, total_len of the whole phrases of at most w_max characters: counted in time linear in the text, no span is formed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shapes in _slices(batches):
            phrases = Phrases(shapes, w_max)
            yield _counted(ids, phrases.head, *phrases.totals())

    given = dealt(sequences.where(F.length("text") > 0).select("seq_id", "text"), "seq_id").select("seq_id", T.shape(F.col("text")).alias("shape"))
    return given.mapInArrow(work, "seq_id long, n_spans long, total_len long")


def candidate_counts(sequences: DataFrame, vocab: DataFrame, probabilities: dict[str, float], w_max: int, tau_vocab: float = TAU_VOCAB, tau_comp: float = TAU_COMP) -> DataFrame:
    """seq_id, n_spans, total_len of `candidates`: whole phrases as in `phrase_counts`; what else is a candidate is looked for among the lengths that it may have."""
    given, most, made = _candidate_work(sequences, vocab, probabilities, w_max, tau_vocab, tau_comp)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, shapes in _slices(batches):
            phrases, composed = made(texts, shapes)
            n, length = phrases.totals()
            for k in range(1, most + 1):
                more = composed.has(k) & ~phrases.whole(k)
                n, length = n + more, length + k * more
            yield _counted(ids, phrases.head, n, length)

    return given.mapInArrow(work, "seq_id long, n_spans long, total_len long")


def valid(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    return spans.join(lengths, "seq_id").where("0 <= start AND start < end AND end <= n")


def depth(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, pos, depth of every position: a sweep over starts and ends, so no pair of spans is formed."""
    marks = spans.select("seq_id", F.col("start").alias("pos"), F.lit(1).alias("d")).union(spans.select("seq_id", F.col("end").alias("pos"), F.lit(-1).alias("d")))
    every = lengths.where("n > 0").select("seq_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("pos"))
    deltas = marks.groupBy("seq_id", "pos").agg(F.sum("d").alias("d"))
    sweep = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(deltas, ["seq_id", "pos"], "left").select("seq_id", "pos", F.sum(F.coalesce("d", F.lit(0))).over(sweep).alias("depth"))


def coverage(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, covered, uncovered, density, avg_depth, max_depth."""
    by = depth(spans, lengths).groupBy("seq_id").agg(F.count_if(F.col("depth") > 0).alias("covered"), F.count_if(F.col("depth") == 0).alias("uncovered"), F.avg("depth").alias("avg"), F.max("depth").alias("max_depth"))
    return by.select("seq_id", "covered", "uncovered", F.round(F.col("covered") / (F.col("covered") + F.col("uncovered")), 6).alias("density"), F.round("avg", 6).alias("avg_depth"), "max_depth")


def gaps(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, start, end of each run of positions without a span."""
    order = Window.partitionBy("seq_id").orderBy("pos")
    bare = depth(spans, lengths).where("depth = 0").withColumn("island", F.col("pos") - F.row_number().over(order))
    return bare.groupBy("seq_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


def lengths_stats(spans: DataFrame) -> DataFrame:
    n = F.col("end") - F.col("start")
    return spans.groupBy("seq_id").agg(F.count("*").alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"), F.median(n).alias("median_len"), F.round(F.stddev_pop(n), 6).alias("std_len"))


def position_stats(spans: DataFrame) -> DataFrame:
    centre = (F.col("start") + F.col("end")) / 2
    return spans.groupBy("seq_id").agg(*[F.round(f(c), 6).alias(f"{name}_{k}") for k, c in (("start", F.col("start")), ("end", F.col("end")), ("centre", centre)) for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


#: Cells of a grid of starts and ends that is summed at once; pairs beyond that are counted in blocks of so many.
GRID = 1 << 22


def _pairs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end, mult of the distinct spans of a sequence, and of each: spans that contain it, spans that it contains (itself not counted), spans that begin before it and end within it, and the sum of the ends of these."""
    (start, end), mult = np.unique(np.stack([start, end]), axis=1, return_counts=True)
    starts, s = np.unique(start, return_inverse=True)
    ends, e = np.unique(end, return_inverse=True)
    if (len(starts) + 1) * (len(ends) + 1) <= GRID:
        grid = np.zeros((len(starts) + 1, len(ends) + 1), np.int64)
        grid[s + 1, e + 1] = mult
        upto = grid.cumsum(axis=0)  # by starts
        by = upto.cumsum(axis=1)  # spans of at most this start and end
        total = by[-1]
        over = by[s + 1, -1] - by[s + 1, e]
        under = total[e + 1] - by[s, e + 1]
        low = np.searchsorted(ends, start, "right")
        crossing = by[s, e] - by[s, low]
        np.cumsum(upto * np.r_[0, ends], axis=1, out=by)
        return start, end, mult, over - 1, under - 1, np.where(e > low, crossing, 0), np.where(e > low, by[s, e] - by[s, low], 0)
    out = np.zeros((4, len(start)), np.int64)
    step = max(1, GRID // len(start))
    for t in range(0, len(start), step):
        a, b = start[t : t + step, None], end[t : t + step, None]
        out[0, t : t + step] = ((start <= a) & (end >= b)) @ mult - 1
        out[1, t : t + step] = ((start >= a) & (end <= b)) @ mult - 1
        cross = (start < a) & (end > a) & (end < b)
        out[2, t : t + step], out[3, t : t + step] = cross @ mult, cross @ (mult * end)
    return start, end, mult, *out


def _by_sequence(spans: DataFrame, kind: str, f) -> DataFrame:
    """Rows that f makes of seq_id, starts and ends of each sequence: columns of equal length."""
    names = [c.split()[0] for c in kind.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=names)
        for b in batches:
            for seq_id, start, end in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                made.append(f(seq_id, start.values.to_numpy().astype(np.int64), end.values.to_numpy().astype(np.int64)))
                n += len(made[-1][0])
                if n >= ROWS:
                    yield out()
                    made, n = [], 0
        if made:
            yield out()

    each = spans.groupBy("seq_id").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    return each.mapInArrow(work, kind)


def containers(spans: DataFrame) -> DataFrame:
    """seq_id, start, end, mult, depth (spans that contain it, itself not counted; equal spans contain each other), children.

    No pair is formed: within a sequence spans are counted on a grid of distinct starts and ends.
    """

    def rows(seq_id: int, start: np.ndarray, end: np.ndarray) -> tuple:
        start, end, mult, over, under, _, _ = _pairs(start, end)
        return np.full(len(start), seq_id), start.astype(np.int32), end.astype(np.int32), mult, over, under

    return _by_sequence(spans, "seq_id long, start int, end int, mult long, depth long, children long", rows)


def hierarchy(spans: DataFrame) -> DataFrame:
    """seq_id, pairs, max_depth, mean_depth, roots, leaves."""

    def row(seq_id: int, start: np.ndarray, end: np.ndarray) -> tuple:
        _, _, mult, over, under, _, _ = _pairs(start, end)
        return tuple(np.array([x], np.int64) for x in (seq_id, (mult * over).sum(), over.max(), mult.sum(), mult[over == 0].sum(), mult[under == 0].sum()))

    by = _by_sequence(spans, "seq_id long, pairs long, max_depth long, n long, roots long, leaves long", row)
    return by.select("seq_id", "pairs", "max_depth", F.round(F.col("pairs") / F.col("n"), 6).alias("mean_depth"), "roots", "leaves")


def overlaps(spans: DataFrame) -> DataFrame:
    """seq_id, pairs, total_len, mean_len of overlaps that are no containment; each counted from both sides."""

    def row(seq_id: int, start: np.ndarray, end: np.ndarray) -> tuple:
        start, _, mult, _, _, n, reach = _pairs(start, end)
        return tuple(np.array([x], np.int64) for x in (seq_id, 2 * (mult * n).sum(), 2 * (mult * (reach - n * start)).sum()))

    by = _by_sequence(spans, "seq_id long, pairs long, total_len long", row).where("pairs > 0")
    return by.select("seq_id", "pairs", "total_len", F.round(F.col("total_len") / F.col("pairs"), 6).alias("mean_len"))


def length_counts(spans: DataFrame) -> DataFrame:
    """seq_id, length, n."""
    return spans.groupBy("seq_id", (F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n"))


def common_lengths(spans: DataFrame, n: int = 10) -> DataFrame:
    """length, n of the most frequent lengths of all sequences, ties to the shorter."""
    return spans.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(n)


def position_counts(spans: DataFrame) -> DataFrame:
    """seq_id, pos, starts, ends: how many spans start at each position, and have their last character there. Positions without any are left out."""
    marks = spans.select("seq_id", F.col("start").alias("pos"), F.lit(1).alias("s"), F.lit(0).alias("e")).union(spans.select("seq_id", (F.col("end") - 1).alias("pos"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    return marks.groupBy("seq_id", "pos").agg(F.sum("s").alias("starts"), F.sum("e").alias("ends"))


def depth_counts(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, depth, n: how many positions of a sequence lie in so many spans."""
    return depth(spans, lengths).groupBy("seq_id", "depth").agg(F.count("*").alias("n"))


def overlap_regions(spans: DataFrame) -> DataFrame:
    """seq_id, start, end, n of the regions that two spans share without one holding the other; n counts the pairs."""
    a, b = spans.select("seq_id", F.col("start").alias("s"), F.col("end").alias("e")).alias("a"), spans.select("seq_id", F.col("start").alias("t"), F.col("end").alias("z")).alias("b")
    inside = (F.col("a.seq_id") == F.col("b.seq_id")) & (F.col("s") < F.col("t")) & (F.col("t") < F.col("e")) & (F.col("e") < F.col("z"))
    return a.join(b, inside).groupBy(F.col("a.seq_id").alias("seq_id"), F.col("t").alias("start"), F.col("e").alias("end")).agg(F.count("*").alias("n"))


def heat_rows(spans: DataFrame) -> DataFrame:
    """seq_id, row, start, end: the rows of a span-by-position picture, shorter spans first, then by start. A sequence is of bounded length, so its spans fit a window."""
    order = Window.partitionBy("seq_id").orderBy(F.col("end") - F.col("start"), "start")
    return spans.select("seq_id", (F.row_number().over(order) - 1).alias("row"), "start", "end")


def texts(spans: DataFrame, sequences: DataFrame) -> DataFrame:
    """seq_id, start, end, span: what each span says."""
    return spans.join(sequences.select("seq_id", "text"), "seq_id").select("seq_id", "start", "end", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))


def report(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """All measures of each sequence in one row; a sequence without spans has nulls where there is nothing to measure."""
    out = lengths.select("seq_id", "n").join(coverage(spans, lengths), "seq_id", "left")
    gap = gaps(spans, lengths).groupBy("seq_id").agg(F.count("*").alias("n_gaps"))
    crossing = overlaps(spans).select("seq_id", F.col("pairs").alias("overlap_pairs"), F.col("total_len").alias("overlap_len"))
    nested = hierarchy(spans).select("seq_id", F.col("pairs").alias("nested_pairs"), F.col("max_depth").alias("max_nesting"), F.col("mean_depth").alias("mean_nesting"), "roots", "leaves")
    for part in (gap, lengths_stats(spans).withColumnRenamed("n", "n_spans"), position_stats(spans), crossing, nested):
        out = out.join(part, "seq_id", "left")
    return out.fillna(0, ["n_gaps", "n_spans", "overlap_pairs", "overlap_len", "nested_pairs", "roots", "leaves"])


def statistics(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row over all sequences, those without spans included; density is all spans over all characters."""
    cover = depth(spans, lengths).groupBy("seq_id").agg((F.count_if(F.col("depth") > 0) / F.count("*")).alias("coverage"), F.avg("depth").alias("avg_depth"))
    gap = gaps(spans, lengths).groupBy("seq_id").agg(F.count("*").alias("n_gaps"))
    k = F.col("end") - F.col("start")
    size = spans.groupBy("seq_id").agg(F.count("*").alias("m"), F.avg(k).alias("k"), F.stddev_pop(k).alias("dev"))
    nested = hierarchy(spans).select("seq_id", "max_depth", "roots", "leaves")
    rows = lengths.select("seq_id", "n")
    for part in (cover, gap, size, nested):
        rows = rows.join(part, "seq_id", "left")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.agg(
        F.count("*").alias("n_sequences"), F.sum(zero("m")).alias("total_spans"), F.sum("n").alias("total_length"), F.round(F.sum(zero("m")) / F.sum("n"), 6).alias("span_density"),
        mean(F.col("coverage"), "mean_coverage"), mean(F.col("avg_depth"), "mean_depth"), mean(zero("n_gaps"), "mean_gaps"), mean(zero("max_depth"), "mean_nesting"),
        mean(zero("roots"), "mean_roots"), mean(zero("leaves"), "mean_leaves"), mean(F.col("k"), "mean_length"), mean(F.col("dev"), "mean_std"),
    )
