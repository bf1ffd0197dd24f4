"""Centroid clustering of 64-component vectors by bit planes and popcounts.

A component x becomes the integer q = floor(256 x) in two's complement.  Bit b
of all 64 components is one unsigned 64-bit word, the plane b, which weighs
2^b (the last plane, the sign, weighs -2^b), so

    <u, v> = sum over planes a of u, b of v of w(a) w(b) popcount(u_a AND v_b)

is exact, and so are the squared distances |u|^2 + |v|^2 - 2 <u, v>.  A vector
holds as many planes as the values written with it need; it is widened by
repeating its sign plane.

The planes are packed once and stored in the shared folder.  Each round is a
map over them that returns, for every task, one row a centroid (count and
components' sums, from counts of the planes' bits); Spark adds these up, and
the ``k`` sums reach the driver for the exact floor of the mean.

Cases: vectors that are NULL, do not have exactly 64 components or hold a NULL,
NaN or infinite one are left out; with fewer than ``k`` vectors each is a
centroid; a NULL id is hashed as empty text; rows that repeat an id or a vector
count each; of equally near centroids the smaller number wins; an empty centroid
stays where it is; an empty table gives no rows; other columns are ignored.  A
component of 2^19 or more in size raises an error: its squared distance need
not fit in a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import persist

DIM = 64
SCALE = 256.0
LIMIT = 1 << 27
STEP = 2048


def weights(n_planes: int) -> np.ndarray:
    w = np.left_shift(np.int64(1), np.arange(n_planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(q: np.ndarray) -> np.ndarray:
    """(rows, planes) words of the integers ``q`` (rows, 64)."""
    largest = int(np.maximum(q, ~q).max(initial=0))
    n = largest.bit_length() + 1
    bits = (q[:, None, :] >> np.arange(n)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def unpack_counts(planes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the components (groups, 64) over the row groups beginning at ``starts``."""
    n, p = planes.shape
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, p, 8), axis=2, bitorder="little")
    return np.einsum("gpc,p->gc", np.add.reduceat(bits, starts, axis=0, dtype=np.int64), weights(p))


def read_planes(column: pa.Array) -> np.ndarray:
    """(rows, planes) of stored planes; shorter ones are widened by their sign."""
    rows = column.to_pylist()
    size = np.array([len(r) for r in rows], np.int64)
    out = np.empty((len(rows), int(size.max(initial=8)) // 8), np.uint64)
    for s in np.unique(size).tolist():
        at = np.flatnonzero(size == s)
        part = np.frombuffer(b"".join(rows[i] for i in at.tolist()), np.uint64).reshape(len(at), s // 8)
        out[at, :s // 8] = part
        out[at, s // 8:] = part[:, -1:]
    return out


def dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products (rows of u, rows of v) by weighted AND-popcounts."""
    wu, wv = weights(u.shape[1]), weights(v.shape[1])
    out = np.zeros((len(u), len(v)), np.int64)
    for a in range(u.shape[1]):
        inner = np.zeros_like(out)
        for b in range(v.shape[1]):
            inner += np.bitwise_count(u[:, a, None] & v[None, :, b]) * wv[b]
        out += wu[a] * inner
    return out


def squares(u: np.ndarray) -> np.ndarray:
    """Exact squared lengths of the rows by AND-popcounts of their own planes."""
    w = weights(u.shape[1])
    out = np.zeros(len(u), np.int64)
    for a in range(u.shape[1]):
        for b in range(u.shape[1]):
            out += np.bitwise_count(u[:, a] & u[:, b]) * (w[a] * w[b])
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of ``centroids`` (packed)."""
    cc = squares(centroids)
    number, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    for at in range(0, len(planes), STEP):
        v = planes[at:at + STEP]
        d = cc[None, :] - 2 * dot(v, centroids)
        k = d.argmin(axis=1)
        number[at:at + STEP] = k
        distance[at:at + STEP] = squares(v) + d[np.arange(len(v)), k]
    return number, distance


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == DIM) & fine


def planes_of(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, planes) of the usable rows of ``vectors``."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(_usable(F.col("v")))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = np.floor(SCALE * b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM))
            if np.abs(q).max() >= LIMIT:
                raise ValueError(f"a component of {LIMIT / SCALE:.0f} or more in size has no exact squared distance in a long")
            p = np.ascontiguousarray(pack(q.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in p], pa.binary())], ["vec_id", "planes"])

    return v.mapInArrow(run, "vec_id long, planes binary")


def _integers(planes: np.ndarray) -> np.ndarray:
    return unpack_counts(planes, np.arange(len(planes)))


def seeds(packed: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose "seed:vec_id" has the smallest SHA-256, in its order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = packed.select(h.alias("h"), "planes").orderBy("h", "planes").limit(k).collect()
    return _integers(read_planes(pa.array([bytes(r.planes) for r in rows], pa.binary()))) if rows else np.empty((0, DIM), np.int64)


def move(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""
    c = pack(centroids)
    k = len(centroids)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            p = read_planes(b.column("planes"))
            number, _ = nearest(p, c)
            order = np.argsort(number, kind="stable")
            own, starts = np.unique(number[order], return_index=True)
            count += np.bincount(number, minlength=k)
            total[own] += unpack_counts(p[order], starts)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own], pa.int64()), pa.array(total[own].tolist(), pa.list_(pa.int64()))],
                                         ["number", "n", "total"])

    parts = packed.mapInArrow(run, "number int, n long, total array<long>")
    sums = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(DIM)]
    new = centroids.copy()
    for r in parts.groupBy("number").agg(F.sum("n").alias("n"), *sums).collect():
        new[r.number] = [int(r[f"s{j}"]) // r.n for j in range(DIM)]
    return new


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of
    every usable vector, after ``rounds`` rounds from the seeds."""
    packed = persist(planes_of(vectors, vector_col, id_col), "planes")
    spark = packed.sparkSession
    centroids = seeds(packed, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = move(packed, centroids)
    c = pack(centroids)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            number, distance = nearest(read_planes(b.column("planes")), c)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    found = persist(packed.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    own = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(own.values())
    facts = spark.createDataFrame([(i, own.get(i, 0), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for i, v in enumerate(centroids.tolist())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")   # k rows
