"""Vocabulary induction over distinct runs: substring counts, candidates, EM with Viterbi, pruning, soft probabilities.

Pieces are white space only or free of it, so counts, segmentations and probabilities of a text are those of its runs;
each distinct run is worked on once and weighted by how often it comes. A vocabulary is bounded by its parameter (the
largest number of pieces, plus one for each character), so it may be sent to every task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import dealt, kept

L_MAX, CANDIDATES, ITERATIONS = 8, 50_000, 5
MIN_PROB, DELTA_PERPLEXITY, DELTA_OOV = 1e-6, 0.01, 0.001


#: Distinct runs, and bytes of texts, that a task counts before it gives the counts out; characters whose pieces are counted at a time.
HELD, HELD_BYTES, AT_ONCE = 1 << 19, 1 << 26, 1 << 20
_WIDE = re.compile(rb" [ \t\n\r\x0b\f]+|[\t\n\r\x0b\f][ \t\n\r\x0b\f]*")  # white space that is more than one blank


def run_counts(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """run, mult: counted text by text where the texts lie (bytes split at the same six characters as `T.runs`), summed afterwards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()
        seen = 0

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64())], names=["run", "mult"])
            count.clear()
            return b

        for b in batches:
            for text in b.column(0):
                text = text.as_buffer().to_pybytes()
                words = text.split()
                count.update(words)
                wide = _WIDE.findall(text)
                count.update(wide)
                if words:
                    blanks = len(words) + 1 - (not text[:1].isspace()) - (not text[-1:].isspace()) - len(wide)
                else:
                    blanks = int(text == b" ")
                if blanks:
                    count[b" "] += blanks
                seen += len(text)
                if len(count) > HELD or seen > HELD_BYTES:
                    yield out()
                    seen = 0
        yield out()

    text = F.lower("text") if normalize else F.make_valid_utf8("text")
    return docs.where("text IS NOT NULL").select(text.alias("text")).mapInArrow(work, "run string, mult long").groupBy("run").agg(F.sum("mult").alias("mult"))


def _strings(points: np.ndarray) -> pa.StringArray:
    """Each row of code points as a string."""
    size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(np.r_[0, size.cumsum()].astype(np.int32)), pa.py_buffer(data))


def _counted(points: np.ndarray, ends: np.ndarray, weight: np.ndarray, l_max: int) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """Pieces and their weighted counts, length by length. points: code points of runs one after another, which end at ends[1:]."""
    letters, code = np.unique(points, return_inverse=True)
    room = ends[1:].repeat(np.diff(ends)) - np.arange(len(points))  # characters from each place to its run's end
    each = weight.repeat(np.diff(ends))
    narrow = len(letters) < 256
    code = code.astype(np.uint64)
    for n in range(1, min(l_max, int(room.max(initial=0))) + 1):
        at = np.flatnonzero(room >= n)
        if narrow and n <= 8:  # a piece is one number
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | code[at + k]
            order = np.argsort(key)
        else:
            key = np.ascontiguousarray(points[at[:, None] + np.arange(n)]).view(f"V{4 * n}").ravel()
            order = np.lexsort([points[at + k] for k in range(n)])
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        yield _strings(points[at[order[first]][:, None] + np.arange(n)]), np.add.reduceat(each[at[order]], first)


def substring_counts(runs: DataFrame, l_max: int = L_MAX) -> DataFrame:
    """piece, freq of every substring of at most l_max characters, at every position: counted batch by batch where the runs lie, summed afterwards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[str] = []
        mult: list[int] = []

        def out() -> Iterator[pa.RecordBatch]:
            points = np.frombuffer("".join(run).encode("utf-32-le"), np.uint32)
            for pieces, freq in _counted(points, np.cumsum([0, *map(len, run)]), np.array(mult, np.int64), l_max) if len(points) else ():
                yield pa.RecordBatch.from_arrays([pieces, pa.array(freq, pa.int64())], names=["piece", "freq"])
            run.clear()
            mult.clear()

        held = 0
        for b in batches:
            for r, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                run.append(r)
                mult.append(m)
                held += len(r)
                if held >= AT_ONCE:
                    yield from out()
                    held = 0
        yield from out()

    every = runs.select("run", F.col("mult").cast("long").alias("mult")).mapInArrow(work, "piece string, freq long")
    return every.groupBy("piece").agg(F.sum("freq").alias("freq"))


def candidates(counts: DataFrame, m: int = CANDIDATES) -> DataFrame:
    """piece, freq: the m most frequent longer pieces (ties by piece), and every single character. Counts are kept, as both halves read them."""
    counts = kept(counts, "counts")
    longer = counts.where(F.length("piece") > 1).orderBy(F.desc("freq"), "piece").limit(m)
    return longer.union(counts.where(F.length("piece") == 1))


def initial_probabilities(vocab: DataFrame) -> DataFrame:
    """piece, freq, prob = freq over the sum of all."""
    total = vocab.agg(F.sum("freq").alias("total"))
    return vocab.join(F.broadcast(total)).select("piece", "freq", (F.col("freq") / F.col("total")).alias("prob"))


def as_dict(vocab: DataFrame) -> dict[str, float]:
    """The vocabulary on the driver; its size is bounded by the number of candidates and of characters."""
    t = vocab.select("piece", "prob").toArrow()
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


def viterbi(run: str, logs: dict[str, float], longest: int) -> tuple[list[str], float] | None:
    """The most probable segmentation of a run; of equal ones that with the longest last piece. None if there is none."""
    n = len(run)
    best, back = [-math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            if best[i] > -math.inf and (log := logs.get(run[i:j])) is not None and best[i] + log > best[j]:
                best[j], back[j] = best[i] + log, i
    if best[n] == -math.inf:
        return None
    pieces, at = [], n
    while at:
        pieces.append(run[back[at] : at])
        at = back[at]
    return pieces[::-1], best[n]


#: Cells of a trie's table; a larger one is searched instead. Texts of one length that are worth being walked side by side.
TABLE, SIDE_BY_SIDE = 1 << 24, 4


class Trie:
    """Pieces as steps from state to state: 0 is dead, 1 the start. value[state] is the logarithm of a piece's probability, -inf where there is none; piece[state] its number."""

    def __init__(self, logs: dict[str, float]) -> None:
        self.pieces = list(logs)
        self.longest = max(map(len, logs), default=0)
        self.letters = np.unique(np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32))
        code = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        self.width = len(code) + 1
        steps: dict[int, int] = {}
        ends = []
        for u in self.pieces:
            state = 1
            for c in u:
                state = steps.setdefault(state * self.width + code[c], len(steps) + 2)
            ends.append(state)
        n = len(steps) + 2
        self.value, self.piece = np.full(n, -np.inf), np.full(n, -1)
        self.value[ends], self.piece[ends] = list(logs.values()), np.arange(len(ends))
        self.value[:2] = -np.inf
        self.key, self.to = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        if n * self.width <= TABLE:
            self.table = np.zeros(n * self.width, np.int32)
            self.table[self.key] = self.to
        else:
            self.table = None
            order = np.argsort(self.key)
            self.key, self.to = self.key[order], self.to[order]

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == points, at + 1, 0) if len(self.letters) else np.zeros(points.shape, np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state * np.int64(self.width) + code
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == key, self.to[at], 0) if len(self.key) else np.zeros(key.shape, np.int32)

    def states(self, codes: np.ndarray) -> list[np.ndarray]:
        """For texts of one length, row by row: for k = 1, 2, ... the state after the k characters from each place."""
        out, state = [], np.ones(codes.shape, np.int32)
        for k in range(1, min(self.longest, codes.shape[1]) + 1):
            state = self.step(state[:, : codes.shape[1] - k + 1], codes[:, k - 1 :])
            out.append(state)
        return out


def _by_length(runs: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Code points of runs one after another, where each run begins, and the numbers of the runs of each length."""
    points = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    return points, np.cumsum(size) - size, list(zip(lengths.tolist(), np.split(order, first[1:]), strict=True)) if len(runs) else []


def _best_ways(trie: Trie, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the best segmentations of texts of one length, and at which characters their pieces begin: `viterbi`, side by side."""
    rows, n = codes.shape
    logs = [trie.value[s] for s in trie.states(codes)]
    best, back = np.full((n + 1, rows), -np.inf), np.zeros((n + 1, rows), np.int64)
    best[0] = 0.0
    for j in range(1, n + 1):
        for i in range(max(0, j - len(logs)), j):
            way = best[i] + logs[j - i - 1][:, i]
            better = way > best[j]
            best[j] = np.where(better, way, best[j])
            back[j][better] = i
    begins, at, who = np.zeros((rows, n), bool), np.full(rows, n), np.arange(rows)
    alive = np.flatnonzero((best[n] > -np.inf) & (at > 0))
    while len(alive):
        at[alive] = back[at[alive], who[alive]]
        begins[alive, at[alive]] = True
        alive = alive[at[alive] > 0]
    return best[n], begins


def _segmented(trie: Trie, logs: dict[str, float], runs: list[str]) -> tuple[pa.ListArray, np.ndarray]:
    """Pieces and scores of the best segmentations (null and -inf where there is none)."""
    points, head, groups = _by_length(runs)
    codes, begins, score = trie.codes(points), np.zeros(len(points), bool), np.full(len(runs), -np.inf)
    for n, rows in groups:
        if len(rows) >= SIDE_BY_SIDE or n == 0:
            places = head[rows][:, None] + np.arange(n)
            score[rows], begins[places] = _best_ways(trie, codes[places])
        else:
            for r in rows.tolist():
                if found := viterbi(runs[r], logs, trie.longest):
                    score[r] = found[1]
                    begins[head[r] + np.cumsum([0, *map(len, found[0][:-1])], dtype=np.int64)] = True
    good = score > -np.inf
    size = np.diff(np.r_[head, len(points)])
    kept_ = good.repeat(size)
    chars, first = points[kept_], begins[kept_]
    width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    ends = np.r_[0, width.cumsum()]
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    pieces = pa.StringArray.from_buffers(int(first.sum()), pa.py_buffer(ends[np.r_[np.flatnonzero(first), len(chars)]].astype(np.int32)), pa.py_buffer(data))
    per = np.bincount(np.arange(len(runs)).repeat(size)[begins], minlength=len(runs)) * good
    offsets = pa.array(np.r_[0, per.cumsum()].astype(np.int32), mask=np.r_[~good, False])
    return pa.ListArray.from_arrays(offsets, pieces), score


def segmented(runs: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """run, mult, pieces, score; pieces are null where the vocabulary can't make the run. Runs of one length are walked side by side."""
    logs = {u: math.log(p) for u, p in probabilities.items() if p > 0}
    shared = runs.sparkSession.sparkContext.broadcast(logs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for b in batches:
            trie = trie or Trie(shared.value)
            pieces, score = _segmented(trie, shared.value, b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pieces, pa.array(score, mask=score == -np.inf)], names=["run", "mult", "pieces", "score"])

    return dealt(runs.select("run", "mult")).mapInArrow(work, "run string, mult long, pieces array<string>, score double")


def guarded_perplexity(logs: Column, n_pieces: Column) -> Column:
    """exp of the mean surprise: infinite without pieces, 1 for a mean of 0, 1e6 where the mean is over 500 or what comes out is not finite or over 1e100."""
    mean = -logs / n_pieces
    plain = F.exp(mean)
    sane = F.when(mean == 0, 1.0).when((mean > 500) | F.isnan(plain) | (plain > 1e100), 1e6).otherwise(plain)
    return F.when(F.coalesce(n_pieces, F.lit(0)) > 0, F.coalesce(sane, F.lit(1e6))).otherwise(float("inf"))


def corpus_metrics(segments: DataFrame) -> DataFrame:
    """perplexity, oov, coverage, n_pieces, n_chars in a single row. A run that can't be made is uncovered; an empty corpus is covered as a whole."""
    good = F.col("pieces").isNotNull()
    sums = segments.agg(
        F.sum(F.when(good, F.col("mult") * F.col("score"))).alias("logs"),
        F.sum(F.when(good, F.col("mult") * F.size("pieces"))).alias("n_pieces"),
        F.sum(F.col("mult") * F.length("run")).alias("n_chars"),
        F.coalesce(F.sum(F.when(good, F.col("mult") * F.length("run"))), F.lit(0)).alias("covered"),
    )
    coverage = F.coalesce(F.col("covered") / F.nullif("n_chars", F.lit(0)), F.lit(1.0))
    return sums.select(guarded_perplexity(F.col("logs"), F.col("n_pieces")).alias("perplexity"), (1 - coverage).alias("oov"), coverage.alias("coverage"), "n_pieces", "n_chars")


def covered_positions(segments: DataFrame) -> DataFrame:
    """run, mult, covered: how many characters of each run its pieces cover, piece by piece up to the first that doesn't match."""
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("on"))
    step = lambda s, x: F.struct((s["at"] + F.when(s["on"] & (F.substring("run", s["at"] + 1, F.length(x)) == x), F.length(x)).otherwise(0)).alias("at"), (s["on"] & (F.substring("run", s["at"] + 1, F.length(x)) == x)).alias("on"))
    return segments.select("run", "mult", F.coalesce(F.aggregate("pieces", start, step)["at"], F.lit(0)).alias("covered"))


def em_step(segments: DataFrame, vocab: DataFrame) -> DataFrame:
    """piece, count, prob: relative frequencies of pieces in the segmentations; pieces without use get 0, and no use at all changes nothing."""
    counts = segments.where("pieces IS NOT NULL").select("mult", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.sum("mult").alias("count"))
    joined = vocab.select("piece", F.col("prob").alias("old")).join(counts, "piece", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = joined.agg(F.sum("count").alias("total"))
    return joined.join(F.broadcast(total)).select("piece", "count", F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(F.col("old")).alias("prob"))


class Pruner:
    """Greedy pruning on distinct runs: taking a piece away only changes the runs that use it.

    Runs that use no piece that may go never change, so only their sums are needed: rest is (sum of scores, pieces, characters
    without a segmentation) of them, chars and letters are those of all runs.
    """

    def __init__(self, runs: list[tuple[str, int]], probabilities: dict[str, float], rest: tuple[float, int, int] = (0, 0, 0), chars: int | None = None, letters: set[str] | None = None) -> None:
        self.p = dict(probabilities)
        self.logs = {u: math.log(p) for u, p in self.p.items() if p > 0}
        self.longest = max(map(len, self.logs), default=0)
        self.mass = sum(self.p.values())
        self.runs, self.users, self.seg = runs, {}, []
        self.log_sum, self.pieces, self.missing = rest
        self.chars = sum(len(r) * m for r, m in runs) if chars is None else chars
        self.letters = {c for r, _ in runs for c in r} if letters is None else letters
        self.whole = self.letters <= self.p.keys()
        for k, (run, mult) in enumerate(runs):
            found = viterbi(run, self.logs, self.longest)
            self.seg.append(found)
            self._count(k, found, 1)
            for u in set(found[0]) if found else ():
                self.users.setdefault(u, set()).add(k)

    def _count(self, k: int, found, sign: int) -> None:
        run, mult = self.runs[k]
        if found:
            self.log_sum += sign * mult * found[1]
            self.pieces += sign * mult * len(found[0])
        else:
            self.missing += sign * mult * len(run)

    def perplexity(self) -> float:
        return math.exp(-(self.log_sum / self.pieces - math.log(self.mass))) if self.pieces else math.inf

    def try_without(self, u: str, perplexity: float, tau: float, delta: float) -> float | None:
        """Takes u away if that raises the perplexity by less than tau and leaves at most delta uncovered; the new perplexity, or None."""
        if len(self.p) == 1 or (len(u) == 1 and u in self.letters) or not self.whole:  # no letter is ever taken away
            return None
        log, prob = self.logs.pop(u), self.p.pop(u)
        state = self.log_sum, self.pieces, self.missing, self.mass
        self.mass -= prob
        changed = {}
        for k in self.users.get(u, ()):
            if self.seg[k] and u in self.seg[k][0]:
                changed[k] = viterbi(self.runs[k][0], self.logs, self.longest)
                self._count(k, self.seg[k], -1)
                self._count(k, changed[k], 1)
        new = self.perplexity()
        if new - perplexity < tau and self.missing <= delta * self.chars:
            for k, found in changed.items():
                self.seg[k] = found
                for v in set(found[0]) if found else ():
                    self.users.setdefault(v, set()).add(k)
            return new
        self.log_sum, self.pieces, self.missing, self.mass = state
        self.logs[u], self.p[u] = log, prob
        return None


def prune(runs: list[tuple[str, int]] | DataFrame, order: list[str], probabilities: dict[str, float], perplexity: float, eps: float = MIN_PROB, tau: float = DELTA_PERPLEXITY, delta: float = DELTA_OOV, keep_codepoints: bool = False) -> tuple[list[str], float]:
    """The vocabulary in order without pieces of no probability, then without rare ones that can be spared; and the perplexity after the last that went.

    Of a table (run, mult) only the runs that use a rare piece come to the driver: a rare piece makes less than eps of all pieces.
    """
    left = [u for u in order if probabilities[u] > 0 or (keep_codepoints and len(u) == 1)]
    if not any(probabilities[u] > 0 for u in left):
        return order, perplexity
    total = sum(probabilities[u] for u in left)
    p = {u: probabilities[u] / total for u in left}
    rare = [u for u in left if 0 < p[u] < eps]
    if isinstance(runs, list):
        pruner = Pruner(runs, p)
    elif rare:
        pruner = Pruner(*_prunable(runs, p, rare))
    else:
        return left, perplexity
    for u in rare:
        new = pruner.try_without(u, perplexity, tau, delta)
        perplexity = perplexity if new is None else new
    return [u for u in left if u in pruner.p], perplexity


def _prunable(runs: DataFrame, p: dict[str, float], rare: list[str]) -> tuple:
    """What a Pruner is made of."""
    shared = runs.sparkSession.sparkContext.broadcast(({u: math.log(q) for u, q in p.items() if q > 0}, frozenset(rare)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rest, chars, letters = None, [0.0, 0, 0], 0, set()
        logs, wanted = shared.value
        kind = pa.schema([("run", pa.string()), ("mult", pa.int64()), ("logs", pa.float64()), ("pieces", pa.int64()), ("missing", pa.int64()), ("chars", pa.int64())])
        for b in batches:
            trie = trie or Trie(logs)
            run, mult = b.column(0).to_pylist(), b.column(1).to_numpy()
            found, score = _segmented(trie, logs, run)
            good = score > -np.inf
            size = np.fromiter(map(len, run), np.int64, len(run))
            rows = np.repeat(np.arange(len(run)), np.where(good, found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0))
            uses = np.zeros(len(run), bool)
            uses[rows[pc.is_in(found.flatten(), pa.array(list(wanted))).to_numpy(zero_copy_only=False)]] = True
            chars += int((mult * size).sum())
            letters.update("".join(run))
            still = good & ~uses
            rest[0] += float((mult[still] * score[still]).sum())
            rest[1] += int((mult * np.bincount(rows, minlength=len(run)))[still].sum())
            rest[2] += int((mult * size)[~good].sum())
            out = pa.table([b.column(0).filter(pa.array(uses)), b.column(1).filter(pa.array(uses))], names=["run", "mult"])
            none = pa.nulls(len(out))
            yield from pa.table([out["run"], out["mult"], none.cast(pa.float64()), *[none.cast(pa.int64())] * 3], schema=kind).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array(["".join(sorted(letters))]), pa.array([None], pa.int64()), pa.array([rest[0]]), *[pa.array([x], pa.int64()) for x in (rest[1], rest[2], chars)]], schema=kind)

    made = dealt(runs.select("run", "mult")).mapInArrow(work, "run string, mult long, logs double, pieces long, missing long, chars long")
    some, rest, chars, letters = [], [0.0, 0, 0], 0, set()
    for r in made.toLocalIterator():
        if r.mult is not None:
            some.append((r.run, r.mult))
        else:
            letters.update(r.run)
            chars += r.chars
            rest = [rest[0] + r.logs, rest[1] + r.pieces, rest[2] + r.missing]
    return sorted(some), p, tuple(rest), chars, letters


def induce(docs: DataFrame, l_max: int = L_MAX, m: int = CANDIDATES, iterations: int = ITERATIONS, eps: float = MIN_PROB, tau: float = DELTA_PERPLEXITY, delta: float = DELTA_OOV, renormalize: bool = False) -> tuple[DataFrame, dict]:
    """The induced vocabulary (piece, prob) and its statistics. EM runs on the cluster; greedy pruning is a sequence by nature and runs on the driver, over the runs that use a rare piece."""
    spark = docs.sparkSession
    runs = kept(run_counts(docs), "runs")
    vocab = kept(initial_probabilities(candidates(substring_counts(runs, l_max), m)), "vocab")
    p = as_dict(vocab.orderBy(F.desc("freq"), "piece"))
    order = list(p)
    base = corpus_metrics(segmented(runs, p)).first()
    perplexity, pruned = base.perplexity, 0
    for _ in range(iterations):
        table = spark.createDataFrame(list(p.items()), "piece string, prob double")
        following = as_dict(em_step(segmented(runs, p), table))
        before = len(order)
        if any(0 < q < eps for q in following.values()):
            order, perplexity = prune(runs, order, following, perplexity, eps, tau, delta)
        else:
            order = [u for u in order if following[u] > 0] or order
        pruned += before - len(order)
        total = sum(following[u] for u in order) if renormalize else 1.0
        p = {u: following[u] / total for u in order}
    last = corpus_metrics(segmented(runs, p)).first()
    stats = {"total_pieces": len(order), "baseline_ppl": base.perplexity, "baseline_oov": base.oov, "final_ppl": last.perplexity, "oov_rate": last.oov, "coverage": last.coverage, "em_iterations": iterations, "pruned_pieces": pruned}
    return spark.createDataFrame(sorted(p.items(), key=lambda x: -x[1]), "piece string, prob double"), stats


def _log_sum(terms: list[float]) -> float:
    most = max(terms)
    return most + math.log(sum([math.exp(t - most) for t in terms])) if len(terms) > 1 else most


def soft_probabilities(run: str, p: dict[str, float], longest: int) -> tuple[float, list[tuple[int, str, float]]]:
    """Logarithm of a run's probability over all its segmentations (-inf if there is none), and (position, piece, share of segmentations by probability). Sums are kept as logarithms, so runs may be of any length."""
    n = len(run)
    into: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for j in range(1, n + 1):
        into[j] = [(i, u, math.log(q)) for i in range(max(0, j - longest), j) if forward[i] > -math.inf and (q := p.get(u := run[i:j], 0)) > 0]
        if into[j]:
            forward[j] = _log_sum([forward[i] + log for i, _, log in into[j]])
    if forward[n] == -math.inf:
        return -math.inf, []
    out: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, u, log in into[j]:
            out[i].append((j, u, log))
    for i in range(n - 1, -1, -1):
        if terms := [log + backward[j] for j, _, log in out[i] if backward[j] > -math.inf]:
            backward[i] = _log_sum(terms)
    total = forward[n]
    return total, [(i, u, math.exp(forward[i] + log + backward[j] - total)) for j in range(1, n + 1) for i, u, log in into[j] if backward[j] > -math.inf]


_RUN = re.compile(r"[ \t\n\r\x0b\f]+|[^ \t\n\r\x0b\f]+")


def soft_by_run(text: str, p: dict[str, float], longest: int) -> list[tuple[int, str, float]]:
    """The same for a whole text under a vocabulary of coherent pieces: run by run, so that no product gets too small."""
    return [(m.start() + i, u, q) for m in _RUN.finditer(text) for i, u, q in soft_probabilities(m[0], p, longest)[1]]


def _log_add(terms: list[np.ndarray]) -> np.ndarray:
    """Logarithms of the sums of what terms are the logarithms of, side by side; -inf for none."""
    most = np.maximum.reduce(terms)
    least = np.where(most > -np.inf, most, 0.0)
    total = np.zeros(len(most))
    for t in terms:
        total += np.exp(t - least)
    with np.errstate(divide="ignore"):
        return least + np.log(total)


def _joined(cells: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*cells, strict=True)] if cells else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]


def _soft(trie: Trie, codes: np.ndarray) -> tuple[np.ndarray, ...]:
    """`soft_probabilities` of texts of one length side by side: logarithms of their totals; and row, end, length, piece's number, p of the cells."""
    rows, n = codes.shape
    states = trie.states(codes)
    logs = [trie.value[s] for s in states]
    forward, backward = np.full((n + 1, rows), -np.inf), np.full((n + 1, rows), -np.inf)
    forward[0] = backward[n] = 0.0
    for j in range(1, n + 1):
        if terms := [forward[i] + logs[j - i - 1][:, i] for i in range(max(0, j - len(logs)), j)]:
            forward[j] = _log_add(terms)
    for i in range(n - 1, -1, -1):
        if terms := [logs[k - 1][:, i] + backward[i + k] for k in range(1, min(len(logs), n - i) + 1)]:
            backward[i] = _log_add(terms)
    cells = []
    for k in range(1, len(logs) + 1):
        way = forward[: n - k + 1].T + logs[k - 1] + backward[k:].T
        r, i = np.nonzero(way > -np.inf)
        cells.append((r, i + k, np.full(len(r), k), trie.piece[states[k - 1][r, i]], np.exp(way[r, i] - forward[n][r])))
    return forward[n], *_joined(cells)


def _soft_cells(trie: Trie, p: dict[str, float], runs: list[str]) -> tuple[np.ndarray, ...]:
    """The same for any runs: totals; and row, start, piece's number, p of the cells, ordered by row, end and start."""
    points, head, groups = _by_length(runs)
    codes, total, found = trie.codes(points), np.zeros(len(runs)), []
    number = None
    for n, rows in groups:
        if len(rows) >= SIDE_BY_SIDE and n:
            total[rows], r, *cell = _soft(trie, codes[head[rows][:, None] + np.arange(n)])
            found.append((rows[r], *cell))
        else:
            number = number or {u: i for i, u in enumerate(trie.pieces)}
            for r in rows.tolist():
                total[r], cells = soft_probabilities(runs[r], p, trie.longest)
                if cells:
                    at, size = np.array([c[0] for c in cells]), np.array([len(c[1]) for c in cells])
                    found.append((np.full(len(cells), r), at + size, size, np.array([number[c[1]] for c in cells]), np.array([c[2] for c in cells])))
    row, end, size, piece, q = _joined(found)
    order = np.lexsort([-size, end, row])
    return total, row[order], (end - size)[order], piece[order], q[order]


def _soft_work(runs: DataFrame, probabilities: dict[str, float], kind: str, f, last=None) -> DataFrame:
    """What f makes of each batch of runs, their multiplicities, the trie, and the cells; and last of nothing more, where it is given."""
    shared = runs.sparkSession.sparkContext.broadcast(probabilities)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, state = None, {}
        for b in batches:
            trie = trie or Trie({u: math.log(q) for u, q in shared.value.items() if q > 0})
            if (made := f(b, trie, state, *_soft_cells(trie, shared.value, b.column(0).to_pylist()))) is not None:
                yield made
        if last and trie:
            yield last(trie, state)

    return dealt(runs.select("run", "mult")).mapInArrow(work, kind)


def forward_backward(runs: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """run, mult, log_total, soft: array of struct<pos, piece, p>. Runs of one length are worked on side by side."""

    def rows(b: pa.RecordBatch, trie: Trie, state: dict, total, row, start, piece, q) -> pa.RecordBatch:
        offsets = np.r_[0, np.bincount(row, minlength=len(total)).cumsum()].astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(trie.pieces, pa.string()).take(pa.array(piece)), pa.array(q)], names=["pos", "piece", "p"])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), cells)], names=["run", "mult", "log_total", "soft"])

    return _soft_work(runs, probabilities, "run string, mult long, log_total double, soft array<struct<pos:int,piece:string,p:double>>", rows)


def piece_masses(runs: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """piece, mass: the sum of its soft probabilities over the corpus, for pieces with a cell. Tasks sum up by piece before anything is dealt."""

    def add(b: pa.RecordBatch, trie: Trie, state: dict, total, row, start, piece, q) -> None:
        n = len(trie.pieces)
        state["mass"] = state.get("mass", 0) + np.bincount(piece, q * b.column(1).to_numpy()[row], n)
        state["used"] = state.get("used", 0) + np.bincount(piece, minlength=n)

    def out(trie: Trie, state: dict) -> pa.RecordBatch:
        used = np.flatnonzero(state["used"])
        return pa.RecordBatch.from_arrays([pa.array(trie.pieces, pa.string()).take(pa.array(used)), pa.array(state["mass"][used])], names=["piece", "mass"])

    return _soft_work(runs, probabilities, "piece string, mass double", add, out).groupBy("piece").agg(F.sum("mass").alias("mass"))


_SUMS = ("n", "places", "best", "low", "high", "s", "ss", "top", "filled", "row_sum", "row_dev")


def soft_sums(runs: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Sums over places, weighted by multiplicity, a row for each batch: n of all places, places with a cell; of these the largest p, and how
    many have it below 0.1 or above 0.8; over cells the sums of p and its square, the largest p, those above 0; sums of p at a place, and the squares of how far these are from the batch's mean."""

    def sums(b: pa.RecordBatch, trie: Trie, state: dict, total, row, start, piece, q) -> pa.RecordBatch:
        mult, run = b.column(1).to_numpy(), b.column(0).to_pylist()
        size = np.fromiter(map(len, run), np.int64, len(run))
        place = (np.cumsum(size) - size)[row] + start
        weight, best = mult.repeat(size), np.full(size.sum(), -1.0)
        np.maximum.at(best, place, q)
        whole, each = np.bincount(place, q, len(weight)), mult[row]
        some, n = best >= 0, weight.sum()
        mean = (weight * whole).sum() / n if n else 0.0
        made = (n, weight[some].sum(), (weight * best)[some].sum(), weight[some & (best < 0.1)].sum(), weight[best > 0.8].sum(), (each * q).sum(), (each * q * q).sum(), q.max(initial=-1.0), each[q > 0].sum(), (weight * whole).sum(), (weight * (whole - mean) ** 2).sum())
        return pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in made], names=list(_SUMS))

    return _soft_work(runs, probabilities, ", ".join(f"{c} double" for c in _SUMS), sums)


def validate_probabilities(vocab: DataFrame) -> DataFrame:
    """n_pieces, n_invalid, total, valid in one row: not empty, each in [0, 1], together 1."""
    bad = F.col("prob").isNull() | F.isnan("prob") | (F.col("prob") < 0) | (F.col("prob") > 1)
    sums = vocab.agg(F.count("*").alias("n_pieces"), F.count_if(bad).alias("n_invalid"), F.sum("prob").alias("total"))
    return sums.select("n_pieces", "n_invalid", F.round("total", 6).alias("total"), ((F.col("n_pieces") > 0) & (F.col("n_invalid") == 0) & (F.abs(F.col("total") - 1) <= 1e-6)).alias("valid"))


def structure(vocab: DataFrame) -> DataFrame:
    """total, single, multi, average length, duplicates and empty pieces in one row."""
    by_piece = vocab.groupBy("piece").agg(F.count("*").alias("n"))
    return by_piece.agg(F.sum("n").alias("total"), F.sum(F.when(F.length("piece") == 1, F.col("n")).otherwise(0)).alias("single"), F.sum(F.when(F.length("piece") > 1, F.col("n")).otherwise(0)).alias("multi"), F.round(F.sum(F.col("n") * F.length("piece")) / F.sum("n"), 6).alias("avg_length"), F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.length("piece") == 0).alias("empty"))


def missing_characters(runs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Characters of the corpus that are no piece."""
    chars = runs.select(F.explode(F.split("run", "")).alias("piece")).where("piece <> ''").distinct()
    return chars.join(vocab.select("piece"), "piece", "left_anti")
