"""Merkle manifest of a dataset: a postorder append log built by aligned builders.

Leaves are the rows of a source by ascending id.  While a tree has several
nodes, every ``FAN`` consecutive ones (the last run: fewer) become one; the
subroots of all sources, ordered by source, form one more tree in the same way.

A tree is cut into aligned blocks of ``FAN ** levels`` nodes, so that no task
ever holds more of a source than a block.  A block's builder appends its nodes
in the order in which they are complete: a node follows the last of its
children, which is the postorder of the tree.  Nothing is kept but the
unfinished runs.  The blocks' last nodes are the leaves of the next tier of
blocks, until each tree has one node.

A log needs no pointers.  In a tree of n leaves and height H the node j of level
h ends with leaf e = min((j + 1) FAN^h, n), and

    position(h, j) = sum over g <= h of ceil(e / FAN^g) + sum over g > h of floor(j FAN^h / FAN^g) - 1

counts the nodes that are complete before it (``address``).  Proofs read the
siblings at these positions, tier by tier from the top: a block inherits the
proof of its last node and hands every leaf its own.

Cases: NULL fields are hashed as ``-``; ids ascend with NULL first, rows of one
id by their leaf; the NULL source is one source and comes first; repeated rows are leaves
of their own; a NULL id is never tampered with; a row that tampering does not change is verified;
empty texts are texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.llm.common import crc_fold, persist

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ------------------------------------------------------------- the log
def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def address(level: int, index: int, n: int, top: int) -> int:
    """Position of a node in the postorder log of a tree with ``n`` leaves whose
    levels reach up to ``top``."""
    end = min((index + 1) * FAN ** level, n)
    return (sum(-(-end // FAN ** g) for g in range(level + 1)) +
            sum(index * FAN ** level // FAN ** g for g in range(level + 1, top + 1)) - 1)


def digest(parts) -> bytes:
    """SHA-256 of digests written as lowercase hex."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def append_log(leaves, top: int) -> list[bytes]:
    """The nodes over ``leaves`` up to level ``top``, in the order of completion."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def add(node, level):
        log.append(node)
        runs[level].append(node)
        if level < top and len(runs[level]) == FAN:
            close(level)

    def close(level):
        node, runs[level] = digest(runs[level]), []
        add(node, level + 1)

    for leaf in leaves:
        add(leaf, 0)
    for level in range(top):
        if runs[level]:
            close(level)
    return log


def path_in(log, index: int, n: int, top: int) -> list[tuple[bytes, bytes]]:
    """(digests to the left, digests to the right) of the node's run at each
    level from a leaf to the top."""
    out, count = [], n
    for level in range(top):
        first = index // FAN * FAN
        run = [(i, log[address(level, i, n, top) * 32:][:32]) for i in range(first, min(first + FAN, count)) if i != index]
        out.append((b"".join(d for i, d in run if i < index), b"".join(d for i, d in run if i > index)))
        index, count = index // FAN, -(-count // FAN)
    return out


# A path is stored as text: left.right; of every level.
def written(path) -> str:
    return "".join(f"{a.hex()}.{b.hex()};" for a, b in path)


def proof_of(path: str) -> str:
    """H of all siblings from the leaf to the root."""
    return sha256(path.replace(".", "").replace(";", "").encode()).hexdigest()


def fold(leaf: bytes, path: str) -> str:
    """The root that a leaf and its siblings give."""
    node = leaf.hex()
    for step in path.split(";")[:-1]:
        a, b = step.split(".")
        node = sha256(f"{a}{node}{b}".encode()).hexdigest()
    return node


# ------------------------------------------------------------- leaves
def field(c: Column) -> Column:
    """``-`` for NULL, else byte count, colon and value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text: Column | None = None) -> Column:
    """Digest of the fields of a row (with another ``text``, if given)."""
    return F.unhex(F.sha2(F.concat(*[field(text if text is not None and f == "text" else F.col(f)) for f in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): the tree key sorts like the source, NULL
    first; ``tampered`` is NULL where nothing is tampered with."""
    even = F.coalesce(crc_fold(F.col("doc_id"), 2) == 0, F.lit(False)) & F.contains(F.col("text"), F.lit("\n"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in FIELDS[1:]])
    return d.select(F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("tree"), "doc_id", leaf_hash().alias("leaf"),
                    F.when(even, leaf_hash(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"))


def numbered(df: DataFrame, order) -> DataFrame:
    """``df`` with ``pos``, its place in its tree by ``order``, and ``n``, the
    tree's size.

    A range-partitioned sort, also within one tree; places are the running
    number in a partition plus the counts of the partitions before it, which
    are one row a (tree, partition).
    """
    rows = persist(df.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    ranged = rows.repartitionByRange("tree", *order, "_row").sortWithinPartitions("tree", *order, "_row")
    placed = persist(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "ordered").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    return placed.join(parts, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


# ------------------------------------------------------------- tiers
BLOCK = "tree string, block long, n long, m long, root binary, log binary, ids array<long>, tampered array<binary>"


def build(items: DataFrame, n_items: int, levels: int, bundle_rows: int) -> DataFrame:
    """One row an aligned block of ``items`` (tree, n, pos, leaf, doc_id,
    tampered): its nodes as a postorder log of 32 bytes each and its last node.

    Blocks are dealt to bundles of about ``bundle_rows`` items.
    """
    size = FAN ** levels
    bundles = max(1, -(-n_items // bundle_rows))

    def run(g):
        g = g.sort_by([("tree", "ascending"), ("pos", "ascending")])
        tree, pos, n, leaf = (g.column(c).to_pylist() for c in ("tree", "pos", "n", "leaf"))
        ids, tampered = g.column("doc_id").to_pylist(), g.column("tampered").to_pylist()
        out, a = [], 0
        while a < len(tree):
            block = pos[a] // size
            b = a + min(size, n[a] - block * size)
            top = height(n[a]) if n[a] <= size else levels
            log = append_log(leaf[a:b], top)
            out.append({"tree": tree[a], "block": block, "n": n[a], "m": b - a, "root": log[-1], "log": b"".join(log), "ids": ids[a:b],
                        "tampered": tampered[a:b]})
            a = b
        return pa.Table.from_pylist(out, pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("root", pa.binary()),
                                                    ("log", pa.binary()), ("ids", pa.list_(pa.int64())), ("tampered", pa.list_(pa.binary()))]))

    block = F.floor(F.col("pos") / size)
    return items.withColumn("_b", F.pmod(F.xxhash64("tree", block), F.lit(bundles))).groupBy("_b").applyInArrow(run, BLOCK)


def tiers(items: DataFrame, levels: int, bundle_rows: int) -> list[DataFrame]:
    """The stored blocks of every tier, the leaves' first; in the last one each
    remaining tree is one block."""
    size, out = FAN ** levels, []
    while True:
        n = items.agg(F.count(F.lit(1)), F.max("n")).first()
        out.append(persist(build(items, n[0], levels, bundle_rows), "blocks"))
        if n[1] is None or n[1] <= size:
            return out
        items = out[-1].filter(F.col("n") > size).select(
            "tree", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("pos"), F.col("root").alias("leaf"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))


def roots(stored: list[DataFrame], levels: int) -> DataFrame:
    """(tree, root) of every tree: the last node of its last tier."""
    out = None
    for t in stored:
        done = t.filter(F.col("n") <= FAN ** levels).select("tree", "root")
        out = done if out is None else out.unionByName(done)
    return out


def _levels_of(n: int, levels: int) -> int:
    return height(n) if n <= FAN ** levels else levels


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):           # a row is a block: one at a time
            yield b.slice(i, 1).to_pylist()[0]


def _hand_down(batches, levels: int):
    """The path of every leaf of the blocks that hold ``path``, the path of their own last node."""
    for r in _rows(batches):
        top = _levels_of(r["n"], levels)
        yield r, top, [written(path_in(r["log"], i, r["m"], top)) + r["path"] for i in range(r["m"])]


def paths_down(stored: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path, subroot): the path of every leaf of the first of the
    ``stored`` tiers, from ``above`` (tree, path, subroot), the path of each tree's own root."""
    size = FAN ** levels

    def run(batches):
        for r, _, path in _hand_down(batches, levels):
            base = r["block"] * size
            yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * r["m"], pa.string()), pa.array(range(base, base + r["m"]), pa.int64()),
                                              pa.array(path, pa.string()), pa.array([r["subroot"]] * r["m"], pa.string())], ["tree", "block", "path", "subroot"])

    given = None
    for blocks in reversed(stored):
        given = persist(_with_paths(blocks, given, above, size).mapInArrow(run, "tree string, block long, path string, subroot string"), "paths")
    return given


def _with_paths(blocks: DataFrame, given: DataFrame | None, above: DataFrame, size: int) -> DataFrame:
    tops = blocks.filter(F.col("n") <= size).select("tree", "block").join(above, "tree")
    return blocks.join(tops if given is None else tops.unionByName(given), ["tree", "block"])


def proofs(stored: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256 and folded_root of every leaf."""
    def run(batches):
        for r, top, path in _hand_down(batches, levels):
            log, m = r["log"], r["m"]
            leaf = [log[at:at + 32] for at in (address(0, i, m, top) * 32 for i in range(m))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), pa.array([x.hex() for x in leaf], pa.string()), pa.array([r["subroot"]] * m, pa.string()),
                 pa.array([proof_of(p) for p in path], pa.string()), pa.array([fold(t or x, p) for t, x, p in zip(r["tampered"], leaf, path)], pa.string())],
                ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    given = paths_down(stored[1:], above, levels) if len(stored) > 1 else None
    return _with_paths(stored[0], given, above, FAN ** levels).mapInArrow(
        run, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, levels: int = 7, bundle_rows: int = 20_000) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of
    every row of ``docs``; blocks hold FAN ** ``levels`` leaves."""
    spark = docs.sparkSession
    own = tiers(numbered(leaves(docs), ["doc_id", "leaf"]), levels, bundle_rows)
    sources = persist(numbered(roots(own, levels).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("leaf")), ["source"]), "subroots")
    top = tiers(sources.select("tree", "n", "pos", "leaf", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")), levels, bundle_rows)
    last = roots(top, levels).first()
    if last is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = bytes(last.root).hex()
    paths = paths_down(top, spark.createDataFrame([("", "", "")], "tree string, path string, subroot string"), levels)
    above = sources.join(paths.select(F.col("block").alias("pos"), "path"), "pos").select(
        F.col("source").alias("tree"), "path", F.lower(F.hex("leaf")).alias("subroot"))
    return proofs(own, above, levels).select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                                             (F.col("folded_root") == F.lit(root)).alias("verified"))


def log_nodes(docs: DataFrame, levels: int = 7, bundle_rows: int = 20_000) -> DataFrame:
    """(source, position, level, index, digest) of every node of every source's
    tree: the whole append log, with positions in the tree's one log."""
    own = tiers(numbered(leaves(docs), ["doc_id", "leaf"]), levels, bundle_rows)
    size = FAN ** levels
    count = own[0].select("tree", F.col("n").alias("leaves")).distinct()
    out = None
    for depth, blocks in enumerate(own):
        def run(batches, depth=depth):
            for r in _rows(batches):
                top, n, rows = _levels_of(r["n"], levels), r["leaves"], []
                whole, source = height(n), r["tree"][1:] if r["tree"] != "0" else None
                for level in range(1 if depth else 0, top + 1):
                    for i in range(-(-r["m"] // FAN ** level)):
                        at, j = level + depth * levels, r["block"] * size // FAN ** level + i
                        p = address(level, i, r["m"], top) * 32
                        rows.append((source, address(at, j, n, whole), at, j, r["log"][p:p + 32].hex()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))],
                                                 ["source", "position", "level", "index", "digest"])
        part = blocks.join(count, "tree").select("tree", "block", "n", "m", "log", "leaves").mapInArrow(
            run, "source string, position long, level int, index long, digest string")
        out = part if out is None else out.unionByName(part)
    return out
