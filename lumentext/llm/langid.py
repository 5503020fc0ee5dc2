"""Language identification by nearest centroid.

A text is the vector of its letter n-grams (hashed), weighted by term and inverse document frequency and normalised; each
language has several centroids, found by spherical k-means; the nearest centroid by cosine gives the language, and a text
too far from all of them is rejected. How near is near enough follows from data: beginnings of several lengths of the sample
are held against what the model must not know, texts of each other language and letters in random order. The model is
fitted on a bounded sample: SAMPLE labelled texts a language, those of the smallest hashes; predictions see whole texts.
Centroids are found where the sample lies; the driver holds them alone, CENTROIDS x WIDTH numbers a language.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; without labelled texts all are;
rows with equal or null doc_id are predicted each for itself (in the sample each is one more text); an empty table gives an
empty result; other columns are kept as they are, whatever their names (`recognised`), or may not be named like the results
(`predict`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import shuffle_partitions, small, stored, turn

#: Labelled texts a language that the model is fitted on; hashed n-grams; centroids a language.
SAMPLE, WIDTH, CENTROIDS, NGRAMS = 500, 1 << 13, 3, 3
#: So many times the sample is drawn by hash before the smallest hashes are taken exactly.
DRAWN = 4
#: Beginnings of so many letters, of so many sampled texts a language, set the bars between genuine and strange cosines.
LETTERS, PROBES = tuple(2**k for k in range(3, 13)), 250
#: Bars are set by the distinct n-grams of a text (one that repeats itself is no longer for that), in powers of two; each needs LEAST probes.
KNOTS, LEAST = 14, 8
#: This share of the strange ones lies below a bar where the genuine ones allow it; a bar is at most this part of the least genuine cosine.
QUANTILE, SLACK = 0.99, 0.95
UNKNOWN = "und"
#: Bytes of text that are counted together.
TOGETHER = 1 << 19
_letters = np.zeros(0, bool)


def _is_letter() -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """texts x WIDTH counts of hashed n-grams of letters (other characters are one gap), and the letters of each."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n\n".join(lowered + [""]).encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in lowered])
    if len(points) < len(doc):  # no text at all
        doc = doc[: len(points)]
    letters = np.bincount(doc[letter], minlength=len(texts))
    code = np.where(letter, points, 32).astype(np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]  # a run of others is one gap
    code, doc, letter = code[keep], doc[keep], letter[keep]
    total = np.zeros(len(texts) * WIDTH, np.int64)
    hashed = np.zeros(len(code), np.uint32)
    for n in range(1, NGRAMS + 1):
        if len(code) < n:
            break
        hashed = hashed[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        at = doc[: len(hashed)] * WIDTH + (mixed >> np.uint32(32 - 13)).astype(np.int64)
        same = (doc[: len(hashed)] == doc[n - 1 :]) & (letter[: len(hashed)] | letter[n - 1 :])
        total += np.bincount(at[same], minlength=len(total))
    return total.reshape(len(texts), WIDTH), letters


def _parts(batch: pa.RecordBatch, at: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows, or of one long text, at most: what counting needs is some dozen bytes a character."""
    size = np.cumsum(np.r_[0, pc.binary_length(batch.column(at)).fill_null(0).to_numpy()])
    start = 0
    while start < batch.num_rows:
        stop = min(start + rows, max(start + 1, int(np.searchsorted(size, size[start] + TOGETHER, "right")) - 1))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # inverse document frequencies
    centroids: np.ndarray
    owner: np.ndarray  # language of each centroid
    bar: np.ndarray  # languages x KNOTS: cosine from which each language accepts a text of 2^(k + 1) distinct n-grams

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        x = np.log1p(counted).astype(np.float32) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counted, letters = counts(texts)
        lettered = letters > 0
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(counted) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64) * lettered
        names = [self.languages[self.owner[b]] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        at = np.log2(np.maximum((counted > 0).sum(axis=1), 1)) - 1
        bar = np.array([np.interp(k, range(KNOTS), self.bar[self.owner[b]]) for k, b in zip(at, best, strict=True)])
        return names, score, ~lettered | (score < bar)

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The knot of each text, and texts x languages: cosine to the nearest centroid of each."""
        counted, _ = counts(texts)
        near = self.vectors(counted) @ self.centroids.T
        knot = np.log2(np.maximum((counted > 0).sum(axis=1), 1)).astype(np.int32)
        return knot, np.stack([near[:, self.owner == i].max(axis=1) for i in range(len(self.languages))], axis=1)


def probes(text: str) -> Iterator[tuple[str, str]]:
    """Of each length in LETTERS that text has: text's beginning of so many letters, and the same with its letters in random order."""
    reach = 2 * LETTERS[-1]
    while True:  # no more of the text than holds the longest beginning
        points = np.array(list(text[:reach].lower()))
        at = np.flatnonzero([c.isalpha() for c in points])
        if len(at) >= LETTERS[-1] or reach >= len(text):
            break
        reach *= 4
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    for n in LETTERS:
        if len(at) >= n:
            begin = points[: at[n - 1] + 1]
            mixed = begin.copy()
            mixed[at[:n]] = rng.permutation(begin[at[:n]])
            yield "".join(begin), "".join(mixed)


def bars(genuine: dict, strange: dict, languages: int) -> np.ndarray:
    """The bar of each language at each knot. genuine: (language, knot) -> number and least cosine of its own probes; strange: -> the quantile of what came nearest to it though it is something else."""
    bar = np.zeros((languages, KNOTS))
    for i in range(languages):
        known = [k for k in range(KNOTS) if genuine.get((i, k), (0, 0))[0] >= LEAST]
        made = [min((genuine[i, k][1] + strange.get((i, k), 0.0)) / 2, SLACK * genuine[i, k][1]) for k in known]
        if known:
            bar[i] = np.interp(range(KNOTS), known, made)
    return bar


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from the mean and then the farthest rows."""
    chosen = [x.mean(axis=0)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[(x @ np.array(chosen).T).max(axis=1).argmin()])
    c = np.array(chosen)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _numbers(lists: pa.Array) -> Iterator[np.ndarray]:
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return (values[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True))


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """learn: which rows may be learnt from."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # an even draw by hash, some times as large as the sample, so that a common language lies in no single task; the smallest hashes are all within it
    size = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "langid-languages")
    part = F.xxhash64("doc_id") / F.lit(2.0**64) + F.lit(0.5)
    drawn = rows.join(small(size), "lang").where(part * F.col("n") < DRAWN * sample).drop("n")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    found = stored(drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample), "langid-texts")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("langid")
        for b in batches:
            for part in _parts(b, 2, 32):
                counted, _ = counts(part.column(2).to_pylist())
                at_, n = zip(*[(np.flatnonzero(c).astype(np.int32), c[c > 0].astype(np.int32)) for c in counted], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at_, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "n", "at", "count"])

    grams = stored(found.select("lang", "n", "text").mapInArrow(sparse, "lang string, n int, at array<int>, count array<int>").where(F.size("at") > 0), "langid-grams")
    total, have = grams.count(), np.zeros(WIDTH)
    for r in grams.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # WIDTH rows at most
        have[r["at"]] = r["count"]
    weights = (np.log((1 + total) / (1 + have)) + 1).astype(np.float32)
    model = Model([], weights, np.zeros((0, WIDTH), np.float32), np.zeros(0, int), np.zeros((0, KNOTS)))

    def centre(key: tuple, t: pa.Table) -> pa.Table:
        turn("langid")
        t = t.sort_by("n").combine_chunks()
        x = np.zeros((t.num_rows, WIDTH), np.float32)
        for row, at, n in zip(x, _numbers(t["at"].chunk(0)), _numbers(t["count"].chunk(0)), strict=True):
            row[at] = n
        c = cluster(model.vectors(x), centroids).astype("<f4")
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "centroid": pa.array([r.tobytes() for r in c], pa.binary())})

    made = sorted((r.lang, i, r.centroid) for i, r in enumerate(grams.groupBy("lang").applyInArrow(centre, "lang string, centroid binary").collect()))
    if made:
        model.languages = sorted({r[0] for r in made})
        model.centroids = np.stack([np.frombuffer(r[2], "<f4") for r in made])
        model.owner = np.array([model.languages.index(r[0]) for r in made])
        model.bar = _bars(found.where(F.col("n") <= PROBES).select("lang", "text"), model)
    return model


def _bars(texts: DataFrame, model: Model) -> np.ndarray:
    """Bars from probes of sampled texts; what comes to the driver is a number for each language and knot."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("langid")
        model = shared.value
        number = {x: i for i, x in enumerate(model.languages)}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some = [] if lang not in number else [x for begin, mixed in probes(text) for x in ((number[lang], begin), (-1, mixed))]
                if some:
                    own = np.array([x[0] for x in some], np.int32)
                    knot, near = model.cosines([x[1] for x in some])
                    mine, row = near[np.arange(len(own)), own].astype(np.float64), np.flatnonzero(own >= 0)
                    near[row, own[row]] = -1  # to the others, its language is unknown
                    to = near.argmax(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(knot), pa.array(own), pa.array(mine), pa.array(to), pa.array(near[np.arange(len(own)), to].astype(np.float64))], names=["knot", "own", "mine", "other", "near"])

    made = stored(texts.repartition(shuffle_partitions(spark)).mapInArrow(probed, "knot int, own int, mine double, other int, near double"), "langid-probes")
    genuine = {(r.own, r.knot): (r.n, r.least) for r in made.where("own >= 0").groupBy("own", "knot").agg(F.count("*").alias("n"), F.min("mine").alias("least")).collect()}
    strange = {(r.other, r.knot): r.most for r in made.where("own != other").groupBy("other", "knot").agg(F.percentile("near", QUANTILE).alias("most")).collect()}
    return bars(genuine, strange, len(model.languages))


def predict(docs: DataFrame, model: Model, chunk: int = 32) -> DataFrame:
    """The columns of docs (among them text) with lang_pred, score and rejected; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x WIDTH floats
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("langid")
        for batch in batches:
            for b in _parts(batch, at, chunk):
                names, score, rejected = shared.value.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names), pa.array(score), pa.array(rejected)], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model, chunk: int = 32) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("langid")
        for batch in batches:
            for b in _parts(batch, at, chunk):
                yield b.filter(pa.array(~shared.value.predict(b.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
