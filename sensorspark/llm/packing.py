"""Variable-capacity best-fit packing of documents into training sequences.

Every document's tokens (its words and one end token) become one or more
pieces: whole pieces of the largest permitted length and a rest.  Pieces are
dealt to shards of bounded size and each shard is packed best-fit decreasing
over several permitted lengths at once: a piece goes to the open bin with the
least room that still holds it, else a bin of the size with the least cost per
token that it can still be filled with is opened, and at the end each bin
shrinks to the smallest permitted length that holds its contents.

Cases: NULL and empty texts hold the end token only; repeated rows are packed
once per row; NULL ids are kept; ties are broken by id, piece and row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import WORD, persist

CAPACITIES = (512, 1024, 2048, 4096)


def bin_cost(capacity: int) -> float:
    """Cost of training on one sequence: a fixed part, a linear part and attention."""
    return 64 + capacity + capacity * capacity / 16384


def pack(lengths, capacities=CAPACITIES, cost=bin_cost):
    """(bin, offset) of each length, which come in descending order, and the
    final capacity of each bin."""
    caps = sorted(capacities)
    left = sum(lengths)
    room: dict[int, list[int]] = {}      # open bins by free room
    rooms: list[int] = []                # the keys of room, sorted
    opened: list[int] = []               # capacity when opened
    used: list[int] = []
    placed = []
    for n in lengths:
        at = bisect_left(rooms, n)
        if at < len(rooms):
            free = rooms[at]
            b = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(at)
        else:
            size = min((c for c in caps if c >= n), key=lambda c: (cost(c) / min(c, left), c))
            b, free = len(opened), size
            opened.append(size)
            used.append(0)
        placed.append((b, used[b]))
        used[b] += n
        left -= n
        if free > n:
            if free - n not in room:
                room[free - n] = []
                insort(rooms, free - n)
            room[free - n].append(b)
    return placed, [next(c for c in caps if c >= u) for u in used]


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """(row, doc_id, piece, n_tokens): whole pieces of ``largest`` tokens and a rest."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") + 1
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("_n"))
    last = F.floor((F.col("_n") - 1) / largest)
    return (d.select("row", "doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
            .select("row", "doc_id", "piece",
                    F.least(F.lit(largest).cast("long"), F.col("_n") - F.col("piece") * largest).alias("n_tokens")))


def best_fit(docs: DataFrame, capacities=CAPACITIES, cost=bin_cost, shard_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, position, capacity, fill for every piece.

    ``shard_rows`` bounds the pieces that one task packs; a shard wastes at
    most its last open bins, a share that does not grow with the data.
    """
    caps = sorted(capacities)
    items = persist(pieces(docs, caps[-1]), "pieces")
    shards = max(1, -(-items.count() // shard_rows))

    def run(key, g):
        n, row, piece = (g.column(c).to_numpy() for c in ("n_tokens", "row", "piece"))
        ids = pc.fill_null(g.column("doc_id"), -1).to_numpy()
        order = np.lexsort((row, piece, ids, -n))
        g, n = g.take(order), n[order].tolist()
        placed, sizes = pack(n, caps, cost)
        bins = [b for b, _ in placed]
        fill = [0] * len(sizes)
        for b, k in zip(bins, n):
            fill[b] += k
        shard = key[0].as_py()
        return g.select(["doc_id", "piece", "n_tokens"]).append_column(
            "bin_id", pa.array([f"{shard}-{b}" for b in bins], pa.string())).append_column(
            "position", pa.array([o for _, o in placed], pa.int64())).append_column(
            "capacity", pa.array([sizes[b] for b in bins], pa.int64())).append_column(
            "fill", pa.array([fill[b] for b in bins], pa.int64()))

    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards))
    return items.withColumn("shard", shard).groupBy("shard").applyInArrow(
        run, "doc_id long, piece long, n_tokens long, bin_id string, position long, capacity long, fill long")
