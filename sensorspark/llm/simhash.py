"""SimHash near-duplicates by covering locality-sensitive hashing.

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its
word shingles.  Candidates come from 2^(r+1) - 1 structured bit masks: bit i
has a fixed non-zero vector m(i) over GF(2)^(r+1), and mask v keeps the bits
with <m(i), v> = 1.  For any r differing bits some v != 0 is orthogonal to all
their vectors, so every pair within r bits agrees on all kept bits of at least
one mask: no pair can be missed.

Only distinct fingerprints enter the tables, so copies cost one row.  Inside a
table bucket the pairs are compared in numpy blocks and only the links that
join two components of the bucket leave it (at most one a row).  A bucket
above ``bucket_limit`` rows is split by r + 1 blocks of the bits on which its members
need not agree, and its parts again, until none is above the limit: two members
within r bits agree on one block whole, so a split loses no pair either.

Cases: NULL texts count as empty; texts without words have fingerprint zero
and link like any other; repeated rows stay, one result each; NULL ids never
become a component id unless a component has no other; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import persist


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: runs of anything but ASCII white space,
    A-Z lower-cased (both are what ``bytes`` methods do)."""
    return (text or b"").lower().split()


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a word list (zero for no words)."""
    from xxhash import xxh64_intdigest
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxh64_intdigest(p, seed) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the signed 64-bit ``fp`` of every row."""
    def run(batches):
        for b in batches:
            fp = [fingerprint(words_of(t), shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks of 64 bits."""
    top = 1 << (radius + 1)
    m = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if bin(m[i] & v).count("1") % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks_of(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` blocks."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in rest[p::parts]) for p in range(parts)]


def local_links(fp: np.ndarray, radius: int, block: int = 2048) -> list[tuple[int, int]]:
    """Links (positions) that join the components of ``fp`` within ``radius``
    bits: a spanning forest, found by comparing blocks of rows."""
    n = len(fp)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a in range(0, n, block):
        for b in range(a, n, block):
            i, j = np.nonzero(np.bitwise_count(fp[a:a + block, None] ^ fp[None, b:b + block]) <= radius)
            keep = i + a < j + b
            for x, y in zip((i[keep] + a).tolist(), (j[keep] + b).tolist()):
                x0, y0 = find(x), find(y)
                if x0 != y0:
                    root[max(x0, y0)] = min(x0, y0)
                    out.append((x, y))
    return out


def links(fps: DataFrame, radius: int = 3, bucket_limit: int = 4096, group_rows: int = 300_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all
    pairs within ``radius`` bits."""
    free = [_signed(~m & (1 << 64) - 1) for m in covering_masks(radius)]      # bits on which a bucket's members need not agree
    key = F.col("fp").bitwiseAND(F.bitwise_not("free"))
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(x) for x in free])).alias("free")).withColumn("key", key)
    total, every = 0, None
    while True:
        sizes = persist(keyed.groupBy("free", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
        total += sizes.agg(F.sum("n")).first()[0] or 0
        over = [r.free for r in sizes.filter(F.col("n") > bucket_limit).select("free").distinct().collect()]        # at most the bit sets of a level
        parts = {x: _blocks_of(~x & (1 << 64) - 1, radius + 1) for x in over if bin(x & (1 << 64) - 1).count("1") > radius}
        shared = keyed.join(sizes, ["free", "key"])
        large = (F.col("n") > bucket_limit) & F.col("free").isin(list(parts))
        small = (shared.filter(~large) if parts else shared).select("fp", "free", "key")
        every = small if every is None else every.unionByName(small)
        if not parts:
            break
        rows = [(x, _signed(x & ~block & (1 << 64) - 1)) for x, blocks in parts.items() for block in blocks]
        finer = fps.sparkSession.createDataFrame(rows, "free long, finer long")
        keyed = persist(shared.filter(large).join(F.broadcast(finer), "free").select("fp", F.col("finer").alias("free")).distinct().withColumn("key", key), "parts")
    groups = max(1, -(-total // group_rows))

    def run(g):
        k = g[["free", "key"]].to_numpy()
        order = np.lexsort((k[:, 1], k[:, 0]))
        k, fp = k[order], g["fp"].to_numpy()[order].view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1), [True]]))
        found = []
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if e - s > 1:
                found += [(s + i, s + j) for i, j in local_links(fp[s:e], radius)]
        f = np.array(found, np.int64).reshape(-1, 2)
        v = fp.view(np.int64)
        return pd.DataFrame({"a": v[f[:, 0]], "b": v[f[:, 1]]})

    group = F.pmod(F.xxhash64("free", "key"), F.lit(groups))
    return every.withColumn("g", group).groupBy("g").applyInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps, each a grouped minimum joined
    back to the edges, until they change nothing; each round's tables are
    written to the shared folder.  The minima are, too, before the join: then
    both of its sides are plain rows, and Spark can split the root that a
    third of all edges may end at.
    """
    e = persist(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = persist(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = persist(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = persist(small, "edges")
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = (r[0], r[1])
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _components_of(fps: DataFrame, radius: int) -> DataFrame:
    """(f, root, component_id) of the distinct fingerprints of ``fps`` (doc_id, fp)."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comp = components(links(distinct.select("fp"), radius))
    roots = distinct.join(comp, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "first_id")
    ids = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return roots.select("f", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) and component_fp (a
    key of the component) of every row of ``docs``."""
    fps = persist(fingerprints(docs, shingle), "simhash")
    of = _components_of(fps, radius)
    return fps.join(of, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id", F.col("root").alias("component_fp"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: exactly one of each
    component, the first by doc_id (NULL last), then by the SHA-256 of its
    text.  Each row has a number of its own, stored with it, so rows that
    share an id or have none are judged each."""
    place = next(c for c in ("_place" + "_" * i for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    numbered = persist(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")

    def run(batches):
        for b in batches:
            fp = [fingerprint(words_of(t), shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("doc_id"), b.column("sha"), pa.array(fp, pa.int64())], ["place", "doc_id", "sha", "fp"])

    text = F.col("text").cast("string").cast("binary")
    fps = persist(numbered.select(F.col(place).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"),
                                  text.alias("text")).mapInArrow(run, "place long, doc_id long, sha string, fp long"), "simhash")
    of = _components_of(fps.select("doc_id", "fp"), radius)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha", "place")).alias("first")
    kept = fps.join(of, F.col("fp") == F.col("f")).groupBy("root").agg(first).select(F.col("first.place").alias(place))
    return numbered.join(kept, place, "left_semi").select(*docs.columns)
