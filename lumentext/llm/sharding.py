"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the block transfers that move fewest bytes.

Documents of equal text form a group and a group stays together, at home in the old shard that holds most of its bytes; the
groups of one home are hashed to blocks, and a block is the unit of transfer. Sizes by home and block, bounded by shards x
blocks, go to the driver; a transport network from old to new shards (staying costs nothing, moving costs its bytes) gives
the flow of least cost. Each shard that has to give bytes gives the blocks whose sizes come nearest to them from below, so no
more moves than the flow of least cost does; those blocks alone are then dealt, and exchanged, to make the receiving shards
even, which costs nothing more. A group larger than a shard's share of all bytes is the exception: it is split by rows, as
no shard could hold it; the other groups of its block stay whole.

The query writes the old shards, rewrites those that lose or gain rows, and returns what the files then hold.

Defined results: null text has size 1 (its end mark) and CRC 0 and is of the group of null texts; rows with equal doc_id are
placed each for itself; null doc_ids are one more id; a null old shard is shard 0; an empty table gives an empty result;
other columns are kept where files are rewritten (but for `shard` and `from_shard`, which the files have themselves) and not
read elsewhere.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import delete
from .scratch import discard, small, stored

#: Blocks of groups, and parts of a divided block: shards x BLOCKS bounds what the driver holds, and 2 x PARTS for each divided block.
BLOCKS, PARTS = 1024, 8


def block_of(text: Column, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int")


def _keys(docs: DataFrame, old_shard: Column, blocks: int = BLOCKS) -> list[Column]:
    """old_shard, block, group, row_part: where a row lies, and what its new place follows from."""
    text = F.coalesce(docs["text"], F.lit(""))
    return [
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        block_of(docs["text"], blocks).alias("block"),
        F.xxhash64(docs["text"]).alias("group"),
        F.pmod(F.xxhash64(docs["doc_id"], text), F.lit(PARTS)).cast("int").alias("row_part"),
    ]


def measured(docs: DataFrame, old_shard: Column, blocks: int = BLOCKS, also: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, block, group, row_part of each row; no shuffle, and the text stays behind."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *_keys(docs, old_shard, blocks),
        *(also or []),
    )


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Flow of least cost that ships all of supply within capacity: successive shortest paths with potentials on a dense transport network."""
    n, m = len(supply), len(capacity)
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    while any(left):
        distance = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        parent = [-1] * (n + m)
        changed = True
        while changed:  # Bellman-Ford on the residual network: forward arcs are unbounded, backward arcs undo flow
            changed = False
            for i in range(n):
                for j in range(m):
                    if distance[i] + cost(i, j) < distance[n + j]:
                        distance[n + j], parent[n + j], changed = distance[i] + cost(i, j), i, True
                    if flow[i][j] and distance[n + j] - cost(i, j) < distance[i]:
                        distance[i], parent[i], changed = distance[n + j] - cost(i, j), n + j, True
        j = min((j for j in range(m) if room[j]), key=lambda j: distance[n + j])
        path, at = [n + j], n + j
        while parent[at] != -1:
            at = parent[at]
            path.append(at)
        amount = min(room[j], left[at])
        for b, a in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[b][a - n])
        for b, a in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[j] -= amount
    return flow


def _giving(mine: list[tuple[int, tuple]], out: int) -> set:
    """Blocks (size, key) whose sizes come near to out from below: the largest that still fit, then exchanges that close what is left."""
    gone, rest = {}, out
    for size, k in sorted(mine, reverse=True):
        if size <= rest:
            gone[k] = size
            rest -= size
    for _ in range(16):
        given, stay = sorted((s, k) for k, s in gone.items()), sorted((s, k) for s, k in mine if k not in gone)
        best, i = (0, None, None), -1
        for size, k in [(0, None), *given]:  # the exchange that adds most, but no more than rest
            while i + 1 < len(stay) and stay[i + 1][0] - size <= rest:
                i += 1
            if i >= 0 and (more := stay[i][0] - size) > best[0]:
                best = (more, k, stay[i])
        if not rest or best[2] is None:
            break
        gone.pop(best[1], None)
        gone[best[2][1]] = best[2][0]
        rest -= best[0]
    return set(gone)


def plan(sizes: dict[tuple[int, int], int], new: int) -> dict[tuple[int, int], int]:
    """(home, block) -> new shard. sizes: bytes of each block at its home. Old and new shards of one number are one place."""
    total = sum(sizes.values())
    old = max((o for o, _ in sizes), default=-1) + 1
    supply = [0] * old
    by_old: dict[int, list[tuple[int, tuple]]] = {}
    for k, size in sizes.items():
        supply[k[0]] += size
        by_old.setdefault(k[0], []).append((size, k))
    capacity = [total // new + (j < total % new) for j in range(new)]
    want = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    place: dict[tuple[int, int], int] = {}
    have, pool = [0] * new, []
    for o in sorted(by_old):
        gone = _giving(by_old[o], supply[o] - want[o][o]) if o < new else {k for _, k in by_old[o]}
        for size, k in by_old[o]:
            if k in gone:
                pool.append((size, k))
            else:
                place[k], have[o] = o, have[o] + size
    room = [(have[j] - capacity[j], j) for j in range(new)]
    heapq.heapify(room)
    for size, k in sorted(pool, reverse=True):  # the largest block to the shard that still lacks most
        lack, j = heapq.heappop(room)
        place[k] = j
        have[j] += size
        heapq.heappush(room, (lack + size, j))
    _even(place, sizes, have, [k for _, k in pool])
    return place


def _even(place: dict, sizes: dict, have: list[int], loose: list) -> None:
    """Moves or exchanges loose blocks between the fullest shard that has any and the emptiest while that brings them closer."""
    held: dict[int, list] = {}
    for key in loose:
        held.setdefault(place[key], []).append(key)
    for _ in range(8 * len(have) + 64):
        if not any(held.values()):
            return
        a, b = max((j for j in held if held[j]), key=have.__getitem__), min(range(len(have)), key=have.__getitem__)
        gap = have[a] - have[b]
        if gap < 2:
            return
        mine = sorted((sizes[k], k) for k in held[a])
        other = sorted([(0, None), *((sizes[k], k) for k in held.get(b, []))], key=lambda x: x[0])
        best, i = (gap, None, None), 0
        for size, k in mine:  # two pointers: the pair whose difference is nearest to half the gap
            while i + 1 < len(other) and size - other[i + 1][0] >= gap / 2:
                i += 1
            for x in other[i : i + 2]:
                if (after := abs(gap - 2 * (size - x[0]))) < best[0]:
                    best = (after, k, x[1])
        if best[1] is None:
            return
        for k, src, dst in ((best[1], a, b), (best[2], b, a)):
            if k is not None:
                place[k] = dst
                held[src].remove(k)
                held.setdefault(dst, []).append(k)
                have[src] -= sizes[k]
                have[dst] += sizes[k]


def _part(divided: list, hot: list) -> Column:
    """0 in a whole block. In a divided block, 1 and more for the rows of a hot group, by row, and below 0 for the others, by group. Both lists are shorter than the new shards are many."""

    def among(pairs: list, name: str, kind: str) -> Column:
        some = [F.struct(F.lit(o).cast("int"), F.lit(x).cast(kind)) for o, x in pairs]
        return F.struct("home", name).isin(some) if some else F.lit(False)

    split, over = among(hot, "group", "long"), among(divided, "block", "int")
    aside = -1 - F.pmod(F.xxhash64("group"), F.lit(PARTS)).cast("int")
    return F.when(split, F.col("row_part") + 1).when(over, aside).otherwise(0)


def _slotted(placed: DataFrame) -> DataFrame:
    """placed with slot in place of row_part: rows are numbered by shard, block and row_part, so that a hot text's rows lie in several tasks."""
    cell = ["shard", "block", "row_part"]
    before = Window.partitionBy("shard").orderBy("block", "row_part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy(*cell).orderBy("doc_id", "size", "text_crc32", "old_shard")
    rows = placed.join(F.broadcast(first), cell)
    return rows.withColumn("slot", F.col("first") + F.row_number().over(order) - 1).drop("first", "row_part")


def reshard(docs: DataFrame, new: int, old_shard: Column, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, home, block, group, part, shard, slot of each row. docs is read once; what goes on is its measures."""
    rows = stored(measured(docs, old_shard, blocks), "shard-rows")
    bytes_ = F.sum("size").alias("bytes")
    # groups that lie in several old shards are at home where most of their bytes are
    apart = rows.groupBy("group").agg(F.min("old_shard").alias("lo"), F.max("old_shard").alias("hi")).where("lo < hi").select("group")
    apart = stored(apart, "shard-apart")
    by = rows.join(small(apart), "group", "left_semi").groupBy("group", "old_shard").agg(bytes_)
    home = stored(by.groupBy("group").agg(F.max(F.struct("bytes", -F.col("old_shard"))).alias("most")).select("group", (-F.col("most.col2")).alias("home")), "shard-homes")
    rows = rows.join(small(home), "group", "left").withColumn("home", F.coalesce("home", "old_shard"))
    whole = {(r.home, r.block): r.bytes for r in rows.groupBy("home", "block").agg(bytes_).collect()}  # shards x BLOCKS at most
    share = sum(whole.values()) / new
    # a block over a shard's share is divided: the groups over a share by rows, all others by groups
    divided = [k for k, size in whole.items() if size > share]
    hot: list = []
    cells = {(o, b, 0): size for (o, b), size in whole.items() if size <= share}
    if divided:
        inside = rows.withColumn("part", _part(divided, [])).where("part != 0")
        hot = [(r.home, r.group) for r in inside.groupBy("home", "group").agg(bytes_).where(F.col("bytes") > share).collect()]
        inside = rows.withColumn("part", _part(divided, hot)).where("part != 0").groupBy("home", "block", "part").agg(bytes_)
        cells |= {(r.home, r.block, r.part): r.bytes for r in inside.collect()}
    key = lambda o, b, p: (o, b * (2 * PARTS + 1) + p + PARTS)
    place = plan({key(*c): cells[c] for c in sorted(cells)}, new)
    table = [(*c, place[key(*c)]) for c in sorted(cells)]
    moves = F.broadcast(docs.sparkSession.createDataFrame(table, "home int, block int, part int, shard int"))
    return _slotted(rows.withColumn("part", _part(divided, hot)).join(moves, ["home", "block", "part"]))


def transfers(placed: DataFrame) -> DataFrame:
    """from_shard, to_shard, n_blocks, n_rows, n_bytes of what moves. placed: rows of `reshard`."""
    moved = placed.where("old_shard != shard").groupBy("old_shard", "shard", "home", "block", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    by = moved.groupBy(F.col("old_shard").alias("from_shard"), F.col("shard").alias("to_shard"))
    return by.agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"))


def dealt(docs: DataFrame, old_shard: Column, path: str) -> DataFrame:
    """Writes docs to path/shard=N with from_shard, the shard a row is dealt to, and reads the files back."""
    shard = F.coalesce(old_shard.cast("int"), F.lit(0))
    rows = docs.withColumn("from_shard", shard).withColumn("shard", F.col("from_shard"))
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def rewrite(docs: DataFrame, placed: DataFrame, path: str, old_shard: str) -> DataFrame:
    """Writes docs (with its column old_shard) to path/shard=N; only shards that lose or gain rows are written. Returns shard and whether it was written.

    placed: what reshard gave for the same rows, stored. A row's cell follows from the row itself, so ids may repeat or be null.
    Files of untouched shards are left as they are, those of shards that lose every row are removed. docs may be read from path.
    """
    spark = docs.sparkSession
    changed = placed.groupBy("shard").agg(F.max((F.col("old_shard") != F.col("shard")).cast("int")).alias("gained"))
    lost = placed.where("old_shard != shard").select(F.col("old_shard").alias("shard")).distinct().withColumn("lost", F.lit(1))
    affected = stored(changed.join(lost, "shard", "full").select("shard", (F.greatest(F.coalesce("gained", F.lit(0)), F.coalesce("lost", F.lit(0))) == 1).alias("written"), F.col("gained").isNull().alias("emptied")), "affected")
    cells = stored(placed.groupBy("home", "block", "part").agg(F.max("shard").alias("shard")), "shard-cells")  # as many as the driver held
    divided = cells.where("part != 0").select("home", "block").distinct().collect()
    hot = placed.where("part > 0").select("home", "group").distinct().collect()
    away = stored(placed.where("home != old_shard").select("group", "old_shard", "home").distinct(), "shard-away")
    rest = [c for c in docs.columns if c != old_shard]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), *_keys(docs, docs[old_shard]))
    rows = rows.join(small(away), ["group", "old_shard"], "left").withColumn("home", F.coalesce("home", "old_shard"))
    rows = rows.withColumn("part", _part(divided, hot)).select("row", "home", "block", "part")
    to = cells.join(F.broadcast(affected.where("written").select("shard")), "shard", "left_semi")
    out = rows.join(F.broadcast(to), ["home", "block", "part"]).select("row.*", "shard")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for r in affected.where("emptied").collect():
        delete(spark, f"{path}/shard={r.shard}")
    discard(cells, away)
    return affected.select("shard", "written")


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, old_shard of each row of the shards' files (dealt, then rewritten), from what the files hold."""
    rows = measured(files, F.col("from_shard"), also=["shard"])
    rows = stored(rows.select("doc_id", "size", "text_crc32", "old_shard", "block", "row_part", "shard"), "shards-read")
    return _slotted(rows).select("doc_id", "size", "text_crc32", "shard", "slot", "old_shard")
