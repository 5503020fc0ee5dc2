"""Exact top-k search by columnar branch and bound.

Vectors are packed in blocks with a vertical layout (one run of memory for each dimension). For a block of queries and a
block of candidates, inner products grow by a few dimensions at a time; a candidate whose product so far plus the largest
that the remaining dimensions can add (the product of the remaining lengths) is below a query's k-th best score so far
is dropped, and the survivors are compacted. Scores are exact integers.

Candidates are dealt to slots of a bounded number of rows, each once, and stay there while the blocks of queries pass by. A
first look at the LEAD longest candidates gives every query a bar, so that all slots drop from the start.

Defined results: vectors that are null or hold a null or a non-finite component, and rows without an id, take no part; rows
of one vec_id count once, with the smallest of their vectors; shorter vectors count as padded with zeros; scores outside
of 64 bits are the nearest 64-bit number; ties go to the smaller vec_id; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import shuffle_partitions, stored

#: Candidates and queries in a block; dimensions in a step; the scale of components.
CANDIDATES, QUERIES, STEP, SCALE = 4096, 256, 16, 256.0
#: Candidates that a slot holds (about), and those that give the first bars.
SLOT, LEAD = 200_000, 2048
_LOW, _HIGH = -(2**63), 2**63 - 1


def usable(df: DataFrame, vector: str) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(~F.exists(vector, bad))


def pack(vectors: list[list[float]]) -> np.ndarray:
    """dimensions x rows of integers, as floats."""
    data = np.zeros((max(map(len, vectors), default=0), len(vectors)))
    for i, v in enumerate(vectors):
        data[: len(v), i] = np.floor(np.array(v, np.float64) * SCALE)
    return data


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, bar: np.ndarray | None = None) -> None:
        self.ids, self.k = ids, k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()

    def add(self, i: int, scores: list[int], ids: list[int]) -> None:
        rows = sorted([*self.rows[i], *zip([-s for s in scores], ids, strict=True)])[: self.k]
        self.rows[i] = rows
        if len(rows) == self.k:
            self.bar[i] = max(self.bar[i], float(-rows[-1][0]))


def search(best: Best, queries: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
    """Adds what a block of candidates (dimensions x rows) holds for a block of queries (dimensions x rows)."""
    width = max(len(queries), len(data))
    pad = lambda x: np.concatenate([x, np.zeros((width - len(x), x.shape[1]))]) if len(x) < width else x
    queries, data = pad(queries), pad(data)
    if width * float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) >= 2.0**53:  # too large for exact floats
        whole = [[int(x) for x in col] for col in data.T]
        for i, q in enumerate(queries.T):
            q = [int(x) for x in q]
            mine = [(min(max(sum(a * b for a, b in zip(q, c, strict=True)), _LOW), _HIGH), int(j)) for c, j in zip(whole, ids, strict=True) if j != best.ids[i]]
            best.add(i, [s for s, _ in mine], [j for _, j in mine])
        return
    ends = [*range(STEP, width, STEP), width]
    # lengths of what remains after each step, a little more than exact so that rounding never drops a candidate
    rest = lambda x: [np.sqrt((x[e:] ** 2).sum(axis=0)) * (1 + 1e-9) for e in ends]
    query_rest, data_rest = rest(queries), rest(data)
    first = queries[: ends[0]].T @ data[: ends[0]]
    order = np.arange(len(ids))
    for i in range(queries.shape[1]):
        part, alive, start = first[i], order, ends[0]
        if best.bar[i] == -np.inf:  # no bar yet: the candidates that lead after the first step set one
            lead = np.argpartition(-part, best.k + 1)[: best.k + 2] if len(part) > best.k + 2 else order
            lead = lead[ids[lead] != best.ids[i]]
            scores = part[lead] + queries[start:, i] @ data[start:, lead]
            if len(scores) >= best.k:
                best.bar[i] = np.sort(scores)[-best.k]
        for step, end in enumerate(ends):
            if end > start:
                part = part + queries[start:end, i] @ data[start:end][:, alive]
                start = end
            live = part + query_rest[step][i] * data_rest[step][alive] + 1e-6 >= best.bar[i]
            if not live.all():
                part, alive = part[live], alive[live]
        own = ids[alive] != best.ids[i]
        best.add(i, part[own].astype(np.int64).tolist(), ids[alive][own].tolist())


QUERY_BLOCK = "ids binary, data binary, bar binary, width int"


def _asked(rows: DataFrame, lead: list, k: int) -> DataFrame:
    """Blocks of queries (vec_id, vector) with a bar for each query: its k-th best score among the leading candidates."""
    first = rows.sparkSession.sparkContext.broadcast(lead)  # LEAD rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = np.array([r[0] for r in first.value], np.int64), pack([r[1] for r in first.value])
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                part = b.slice(at, QUERIES)
                best, queries = Best(part.column(0).to_numpy(), k), pack(part.column(1).to_pylist())
                if len(ids):
                    search(best, queries, ids, data)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (best.ids.astype("<i8").tobytes(), queries.tobytes(), best.bar.tobytes())] + [pa.array([len(queries)], pa.int32())], names=["ids", "data", "bar", "width"])

    return rows.mapInArrow(run, QUERY_BLOCK)


def top_k(vectors: DataFrame, is_query: Column, vector: str = "embedding", k: int = 5, slots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. Each slot of candidates sends k rows a query on."""
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query")), "vector")
    slots = slots or max(shuffle_partitions(spark), -(-rows.count() // SLOT))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    lead = [(r.vec_id, r.vector) for r in rows.orderBy(F.desc(length), "vec_id", "vector").select("vec_id", "vector").limit(LEAD).collect()]
    seen: dict[int, list[float]] = {}
    for i, v in lead:
        seen.setdefault(i, v)
    # a lead row may lose to a smaller vector of its id, which might score less: such ids set no bar
    twice = {r.vec_id for r in rows.where(F.col("vec_id").isin(list(seen))).groupBy("vec_id").count().where("count > 1").collect()} if seen else set()
    unique = rows.where("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = stored(_asked(unique.repartition(max(1, slots // 8), "vec_id"), [x for x in seen.items() if x[0] not in twice], k), "topk-queries")
    to = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    nothing = lambda kind: F.lit(None).cast(kind)
    passing = asked.select(to, F.lit(1).alias("turn"), nothing("long").alias("vec_id"), nothing("array<double>").alias("vector"), "ids", "data", "bar", "width")
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("turn"), "vec_id", "vector", *[nothing("binary").alias(c) for c in ("ids", "data", "bar")], nothing("int").alias("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors_, blocks = None, [], [], []  # the slot, rows that wait for their block, and the slot's blocks
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def close() -> None:
            if ids:
                blocks.append((np.array(ids, np.int64), pack(vectors_)))
                ids.clear()
                vectors_.clear()

        for b in batches:
            slot, turn = b.column("slot").to_numpy(), b.column("turn").to_numpy()
            for i in range(b.num_rows):
                if slot[i] != here:
                    here, last, blocks = slot[i], None, []
                    ids.clear()
                    vectors_.clear()
                if turn[i] == 0:  # in the order of ids and vectors: the first of an id counts
                    if (key := b.column("vec_id")[i].as_py()) != last:
                        last = key
                        ids.append(key)
                        vectors_.append(b.column("vector")[i].as_py())
                        if len(ids) == CANDIDATES:
                            close()
                    continue
                close()
                asked_, width = np.frombuffer(b.column("ids")[i].as_py(), "<i8"), b.column("width")[i].as_py()
                best = Best(asked_, k, np.frombuffer(b.column("bar")[i].as_py()))
                queries = np.frombuffer(b.column("data")[i].as_py()).reshape(width, len(asked_))
                for own, data in blocks:
                    search(best, queries, own, data)
                made = [(q, j, -s) for q, found in zip(asked_.tolist(), best.rows, strict=True) for s, j in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*made, strict=True) if made else ([], [], []))], schema=schema)

    dealt = held.unionByName(passing).repartition(slots, "slot").sortWithinPartitions("slot", "turn", "vec_id", "vector")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
