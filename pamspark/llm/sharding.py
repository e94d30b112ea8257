"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of hash cells; a key belongs to the first point at or after its cell.
A shard takes keys of its own arcs, in ring order, up to its capacity; what overflows continues clockwise to the
next point whose shard has room. Only the counts of hash cells come to the driver, at most 2^20 numbers however
many rows there are; there the ring is walked once, and the answer (from which rank of a cell on which shard
begins) is joined to the rows by their cell. Rows are ranked within cells, so no task needs more than a cell.

With capacity="even" capacities add up to the number of rows, so counts differ by one at most; with a number c
every shard may hold c times the mean, and fewer keys move when a shard is added.

Defined cases: nulls are hashed like values; repeated rows share a ring position and are told apart by their rank;
an empty table gives an empty result; columns named shard or slot are replaced, other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pamspark.llm.common import cells_for


def ring(shards: int, vnodes: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and shards of the virtual nodes in ring order; a shard's points do not depend on the other shards."""
    points = sorted(((xxhash.xxh64_intdigest(f"{s}/{v}") >> 1) * cells >> 63, s) for s in range(shards) for v in range(vnodes))
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def walk(counts: np.ndarray, capacity: list[int], at: np.ndarray, owner: np.ndarray) -> pd.DataFrame:
    """Pieces (cell, low, high, shard, slot): ranks low to high - 1 of a cell lie on the shard from the slot on."""
    cells = len(counts)
    point_of = np.searchsorted(at, np.arange(cells), "left") % len(at)
    # keys of an arc in ring order; the arc that runs over the end of the ring begins with its last cells
    ring_order = np.roll(np.arange(cells), -(int(at[-1]) + 1))
    arcs: list[list[list[int]]] = [[] for _ in at]
    for c in ring_order[counts[ring_order] > 0]:
        arcs[point_of[c]].append([int(c), 0, int(counts[c])])
    room, slot = list(capacity), [0] * len(capacity)
    pieces = []

    def take(queue: list, shard: int) -> list:
        for i, (c, low, high) in enumerate(queue):
            n = min(room[shard], high - low)
            if n:
                pieces.append((c, low, low + n, shard, slot[shard]))
                slot[shard] += n
                room[shard] -= n
            if n < high - low:
                return [[c, low + n, high], *queue[i + 1:]]
        return []

    over = [take(queue, int(s)) for queue, s in zip(arcs, owner)]
    carried: list[list[int]] = []
    for lap in range(2):
        for p, s in enumerate(owner):
            carried = take(carried, int(s)) if room[s] else carried
            carried += over[p]
            over[p] = []
    if carried:
        raise ValueError("the shards have less capacity than there are rows")
    return pd.DataFrame(pieces, columns=["_cell", "_low", "_high", "shard", "_slot"])


def place(docs: DataFrame, keys: list[str], shards: int = 16, vnodes: int = 64, capacity: float | str = "even") -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 within the shard)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    n = docs.count()
    cells = cells_for(n, least=4096)
    hashed = docs.withColumn("_at", F.shiftrightunsigned(F.xxhash64(*[docs[k] for k in keys]), 1))
    hashed = hashed.withColumn("_cell", F.shiftright("_at", 63 - (cells.bit_length() - 1)).cast("int"))
    counts = np.zeros(cells, np.int64)
    for cell, count in hashed.groupBy("_cell").count().toLocalIterator():
        counts[cell] = count
    if capacity == "even":
        room = [n // shards + (s < n % shards) for s in range(shards)]
    else:
        room = [int(np.ceil(capacity * n / shards))] * shards
    pieces = spark.createDataFrame(walk(counts, room, *ring(shards, vnodes, cells)),
                                   "_cell int, _low long, _high long, shard int, _slot long")
    order = [F.col("_at"), *[F.col(k).asc_nulls_first() for k in keys]]
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1)
    placed = ranked.join(pieces, "_cell").filter("_rank >= _low and _rank < _high")
    return placed.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_low")).drop(
        "_at", "_cell", "_rank", "_low", "_high", "_slot")
