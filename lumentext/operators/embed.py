"""Embeddings: quality, similarity, pooling, seeds from soft probabilities, dilated convolutions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import dealt

KERNELS, DILATIONS = (3, 5, 7), (1, 2, 4)


def doubles(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, F.col(vector).cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def dimension_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """dim, mean, variance (population) of each dimension."""
    cells = doubles(df, vector).select(F.posexplode(vector).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def row_correlation(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """n, mean_corr, std_corr over all pairs of rows, without forming a pair.

    With rows centred and scaled to length 1 the correlations are the entries of Z Z'. Their sum is the square of the sum of
    rows, and the sum of their squares is that of the entries of Z'Z, whose size is the dimensions' alone.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for f in frames:
            if len(f):
                z = np.array(f[vector].tolist(), np.float64)
                z -= z.mean(axis=1, keepdims=True)
                z /= np.linalg.norm(z, axis=1, keepdims=True)
                n, total, gram = n + len(z), z.sum(axis=0) + (0 if total is None else total), z.T @ z + (0 if gram is None else gram)
        if n:
            yield pd.DataFrame({"n": [n], "sums": [np.r_[total, gram.ravel()].tolist()]})

    parts = doubles(df, vector).select(vector).mapInPandas(partial, "n long, sums array<double>")
    cells = parts.select("n", F.posexplode("sums").alias("at", "x"))
    sums = cells.groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    # d + d*d cells: the first d hold the sum of rows
    width = (F.sqrt(1 + 4 * F.col("m")) - 1) / 2
    by = sums.agg(F.count("*").alias("m"), F.max("n").alias("n"), F.collect_list(F.struct("at", "x")).alias("cells"))
    made = by.select("n", F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.when(c["at"] < width, c["x"] * c["x"]).otherwise(0.0)).alias("s1"), F.aggregate("cells", F.lit(0.0), lambda s, c: s + F.when(c["at"] >= width, c["x"] * c["x"]).otherwise(0.0)).alias("s2"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s1") - F.col("n")) / pairs
    return made.select("n", F.round(mean, 6).alias("mean_corr"), F.round(F.sqrt((F.col("s2") - F.col("n")) / pairs - mean * mean), 6).alias("std_corr"))


#: Ranges that values are counted in, and distinct values of a range that may come to the driver.
RANGES, VALUES = 1 << 12, 1 << 16


def quantiles(values: DataFrame, n: int, low: float, high: float, wanted: tuple[float, ...]) -> list[float]:
    """Exact quantiles of x, between neighbours in proportion, of n finite numbers from low to high: numbers are counted by range, and ranges that hold a rank are divided again, so no task holds all values."""
    ranks = sorted({r for q in wanted for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))})
    found: dict[int, float] = {}
    open_ = [(low, high, 0, n, ranks)]  # from, to, numbers before it, numbers in it, ranks in it
    while open_:
        low, high, before, size, inside = open_.pop()
        if low == high:
            found |= dict.fromkeys(inside, low)
            continue
        few = size <= VALUES or high - low <= 2 * RANGES * math.ulp(max(abs(low), abs(high)))
        part = F.col("x") if few else F.least(F.floor((F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * RANGES), F.lit(RANGES - 1))
        by = values.where(F.col("x").between(low, high)).groupBy(part.alias("part")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(by.collect(), key=lambda r: r.part):
            if some := [k for k in inside if before <= k < before + r.n]:
                open_.append((r.low, r.high, before, r.n, some))
            before += r.n
    out = []
    for q in wanted:
        at = q * (n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out


def similarity(a: Column, b: Column, method: str) -> Column:
    apart = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    if method == "cosine":
        return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))
    if method == "euclidean":
        return 1 / (1 + F.sqrt(apart(lambda x, y: (x - y) * (x - y))))
    if method == "manhattan":
        return 1 / (1 + apart(lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown similarity: {method}")


def group_means(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, centre: the mean vector of each group."""
    cells = doubles(df, vector).select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("x"))
    return cells.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias("centre"))


def pooled(positions: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """span_id, dim, value: mean, max or sum of the vectors at positions in [start, end); a span without a position gives zeros."""
    f = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    inside = spans.where("start < end").select("span_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    cells = doubles(positions).select("pos", F.posexplode("embedding").alias("dim", "x"))
    dims = cells.select("dim").distinct()
    made = inside.join(cells, "pos").groupBy("span_id", "dim").agg(f("x").alias("value"))
    return spans.select("span_id").crossJoin(F.broadcast(dims)).join(made, ["span_id", "dim"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def initial_std(vocab: DataFrame, width: int) -> DataFrame:
    """piece, std: sqrt(2 / (width + pieces)), for longer pieces over the root of the probability's root."""
    n = vocab.agg(F.count("*").alias("n"))
    base = F.sqrt(F.lit(2.0) / (F.lit(width) + F.col("n")))
    return vocab.crossJoin(F.broadcast(n)).select("piece", F.when(F.length("piece") == 1, base).otherwise(F.sqrt(base / F.sqrt("prob"))).alias("std"))


def receptive_fields(kernels=KERNELS, dilations=DILATIONS) -> list[tuple[int, int, int, int]]:
    """(kernel, dilation, padding, receptive field) of each pathway; ValueError unless kernels are odd and all are positive."""
    if not kernels or not dilations or any(not isinstance(k, int) or k < 1 or k % 2 == 0 for k in kernels) or any(not isinstance(d, int) or d < 1 for d in dilations):
        raise ValueError("kernels must be odd positive integers and dilations positive integers")
    return [(k, d, (k - 1) * d // 2, 1 + (k - 1) * d) for k in kernels for d in dilations]


# A rational approximation of the error function for x >= 0, off by 1.5e-7 at most.
_ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


#: Positions whose numbers stay in a core's cache from one step to the next.
BLOCK = 256


def erf(x: np.ndarray) -> np.ndarray:
    scale, *c = (np.float32(v) if x.dtype == np.float32 else v for v in _ERF)
    a = np.abs(x)
    t = a * scale
    t += 1
    np.reciprocal(t, out=t)
    tail = t * c[4]
    for v in reversed(c[:4]):
        tail += v
        tail *= t
    a *= a
    np.negative(a, out=a)
    tail *= np.exp(a, out=a)
    np.subtract(1, tail, out=tail)
    return np.copysign(tail, x, out=tail)


def _gelu(x: np.ndarray) -> np.ndarray:
    y = erf(x * x.dtype.type(math.sqrt(0.5)))
    y += 1
    y *= x
    y *= x.dtype.type(0.5)
    return y


class ConvEncoder:
    """Convolutions of several kernels and dilations, joined, projected, added to the input and normalised; weights come from a seed."""

    def __init__(self, width: int, kernels=KERNELS, dilations=DILATIONS, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.paths = receptive_fields(kernels, dilations)
        draw = lambda *shape, fan: (rng.uniform(-1, 1, shape) / math.sqrt(fan)).astype(np.float32)
        self.conv = [(draw(k, width, width, fan=k * width), draw(width, fan=k * width)) for k, _, _, _ in self.paths]
        fan = len(self.paths) * width
        self.out = draw(fan, width, fan=fan), draw(width, fan=fan)

    def __call__(self, seeds: np.ndarray) -> np.ndarray:
        return self.joined(np.r_[np.zeros((1, seeds.shape[1]), np.float32), seeds.astype(np.float32)], np.arange(len(seeds)) + 1, [len(seeds)])

    def joined(self, vectors: np.ndarray, at: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The same for texts one after another, whose seeds are vectors[at]: equal seeds meet the weights once. vectors[0] are zeros, as lie around each text."""
        apart = max(pad for _, _, pad, _ in self.paths)
        place = np.arange(len(at)) + apart * (np.arange(len(sizes)).repeat(sizes) + 1)
        which = np.zeros(len(at) + apart * (len(sizes) + 1), np.int64)
        which[place] = at
        width = vectors.shape[1]
        h = vectors[at] + self.out[1]
        for path, ((k, d, pad, _), (w, b)) in enumerate(zip(self.paths, self.conv, strict=True)):
            met = [vectors @ w[i] for i in range(k)]
            out = self.out[0][path * width : (path + 1) * width]
            for t in range(0, len(at), BLOCK):
                here = place[t : t + BLOCK] - pad
                x = met[0][which[here]]
                for i in range(1, k):
                    x += met[i][which[here + i * d]]
                x += b
                h[t : t + BLOCK] += _gelu(x) @ out
        for t in range(0, len(at), BLOCK):
            x = h[t : t + BLOCK]
            x -= x.mean(axis=1, keepdims=True)
            x /= np.sqrt((x * x).mean(axis=1, keepdims=True) + np.float32(1e-5))
        return h


def piece_vector(piece: str, std: float, width: int, seed: int = 0) -> np.ndarray:
    """The seeded vector of a piece: the same on every executor and in every run."""
    import zlib

    return np.random.default_rng((seed, zlib.crc32(piece.encode()))).normal(0, std, width)


#: Numbers of vectors that encode works on at a time, and of a kind that it holds before it gives them out.
AT_ONCE, NUMBERS = 1 << 24, 1 << 20


def encode(sequences: DataFrame, probabilities: dict[str, float], norms: bool = False, width: int = 64, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """seq_id, n, width, seed and context vectors and soft probabilities (pos, piece, p) of each sequence; an error in one is told in its own row. Sequences are dealt evenly first: the work is here, not where they were numbered.

    Vectors belong to a place of a run, so each distinct run of the texts at hand is worked on once. With norms there are, in place of
    vectors and probabilities, the means of their lengths (seed_norm, context_norm): vectors then stay where they are made.
    """
    from .vocab import _RUN, soft_probabilities

    shared = sequences.sparkSession.sparkContext.broadcast(probabilities)
    longest, base = max(map(len, probabilities), default=0), math.sqrt(2 / (width + len(probabilities)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, p, vectors = ConvEncoder(width, seed=seed), shared.value, {}
        std = lambda u: base if len(u) == 1 else math.sqrt(base / math.sqrt(p[u]))
        soft = pa.list_(pa.struct([("pos", pa.int32()), ("piece", pa.string()), ("p", pa.float64())]))
        lengths = lambda x: np.concatenate([np.sqrt(np.square(x[t : t + BLOCK], dtype=np.float64).sum(axis=1)) for t in range(0, len(x), BLOCK)] or [np.zeros(0)])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            made = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
            if norms:
                more = [pa.array([r[k] for r in rows], pa.float64()) for k in (3, 4)]
                return pa.RecordBatch.from_arrays([*made, *more, pa.array([r[6] for r in rows], pa.string())], names=["seq_id", "n", "width", "seed_norm", "context_norm", "error"])
            table = lambda k: pa.array([r[k] for r in rows], pa.list_(pa.list_(pa.float32())))
            return pa.RecordBatch.from_arrays([*made, table(3), table(4), pa.array([r[5] for r in rows], soft), pa.array([r[6] for r in rows], pa.string())], names=["seq_id", "n", "width", "seed", "context", "soft", "error"])

        def encoded(given: list[tuple[int, str]]) -> Iterator[tuple]:
            """Rows of texts that are worked on together."""
            known, seeds, used = {}, [np.zeros((1, width), np.float32)], 1
            for run in {m[0]: None for _, text in given for m in _RUN.finditer(text)}:
                cells = soft_probabilities(run, p, longest)[1]
                h = np.zeros((len(run), width), np.float32)
                for i, u, q in cells:
                    if u not in vectors:
                        vectors[u] = piece_vector(u, std(u), width, seed).astype(np.float32)
                    h[i] += np.float32(q) * vectors[u]
                known[run] = used, cells
                seeds.append(h)
                used += len(run)
            parts = [[(m.start(), m[0]) for m in _RUN.finditer(text)] for _, text in given]
            every = np.concatenate(seeds)
            at = np.concatenate([np.zeros(0, np.int64), *(known[run][0] + np.arange(len(run)) for part in parts for _, run in part)])
            context = encoder.joined(every, at, [len(text) for _, text in given])
            if norms:
                by_place, seed_norm = lengths(context), lengths(every)[at]
            first = 0
            for (seq_id, text), part in zip(given, parts, strict=True):
                here = slice(first, first + len(text))
                first += len(text)
                if norms:
                    mean = lambda x: float(x[here].sum()) / len(text) if text else None  # noqa: B023, E731
                    yield seq_id, len(text), width, mean(seed_norm), mean(by_place), None, None
                else:
                    yield seq_id, len(text), width, list(every[at[here]]), list(context[here]), [{"pos": start + i, "piece": u, "p": q} for start, run in part for i, u, q in known[run][1]], None

        def safe(given: list[tuple[int, str]]) -> Iterator[tuple]:
            try:
                yield from list(encoded(given))
            except Exception as e:  # one sequence's fault is not the job's
                if len(given) == 1:
                    yield given[0][0], len(given[0][1]), width, None, None, None, str(e)
                else:
                    for one in given:
                        yield from safe([one])

        def groups() -> Iterator[list[tuple[int, str]]]:
            given, size, most = [], 0, AT_ONCE if norms else NUMBERS
            for b in batches:
                for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if given and size + len(row[1]) * width > most:
                        yield given
                        given, size = [], 0
                    given.append(row)
                    size += len(row[1]) * width
            if given:
                yield given

        for given in groups():
            yield out(list(safe(given)))

    kind = "seed_norm double, context_norm double" if norms else "seed array<array<float>>, context array<array<float>>, soft array<struct<pos:int,piece:string,p:double>>"
    return dealt(sequences.select("seq_id", "text"), "seq_id", parts=partitions).mapInArrow(work, f"seq_id long, n int, width int, {kind}, error string")
