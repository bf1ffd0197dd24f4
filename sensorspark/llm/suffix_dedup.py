"""Removal of repeated byte strings by difference-cover suffix sorting.

Every byte covered by a ``window``-byte string that also starts anywhere else
goes.  Only suffixes to depth ``window`` matter, so suffixes are compared as
windows:

1. Each window is put into the suffix bucket of its anchor, the smallest hashed
   gram in it (leftmost of equal ones).  Equal windows have equal anchors at
   equal places, so a bucket holds all its suffixes' equals.  Successive
   windows with one anchor form a segment; its rows are (anchor, segment hash).
2. Hashes only deal out the work: two texts of each segment that occurs twice,
   and one of each other segment whose anchor has several, go to the anchor's
   bucket, where the two are compared byte by byte.  An anchor with over
   ``hot_segments`` segments is split by the text that all windows at one range
   of distances from it share.  Where over ``hot_segments`` pieces share that text
   too, the split goes on to single windows: of each window whose hash occurs
   twice two texts are compared.
3. The suffixes of one text of each segment are sorted with those of its bucket,
   a bounded bundle of buckets at a time (``bundle_windows``): first by a short prefix; ties, which are as long as
   the window, are resolved by ranks of the positions in a difference cover
   {0, 1, 3, 9} mod 13, computed before by doubling over the cover positions
   alone (4/13 of the memory).  For any two suffixes some shift below 13 puts
   both on the cover.  What the comparison and the sort find equal is repeated, and
   nothing else; further copies of a text follow the two that were compared.
4. The repeated ranges return to their documents, where the bytes are cut.

Texts cross the network compressed and never meet in one place but for the
bundles.  Cases: NULL texts count as empty; repeated rows are copies of each
other; NULL ids are kept; texts shorter than the window lose nothing; an empty
table gives no rows; other columns are ignored.  ``docs`` must be a stored
table (it is read three times under the same row numbers).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import persist

#: A perfect difference set: every residue mod 13 is a difference of two of its members (fixed values).
PERIOD, COVER = 13, (0, 1, 3, 9)

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse mod 2^64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any substrings of one byte string, by prefix sums."""

    def __init__(self, x: np.ndarray):
        up, self.down = _powers(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_TABLE[x] * up[:len(x)], out=self.sums[1:])

    def __call__(self, start, end):
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i, from running minima of blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def segments(x: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """(start, windows, lead, key, seg) of the segments of the texts that lie
    end to end in ``x`` between ``bounds``; lead is the anchor's distance from
    the start, key the anchor's hash, seg the hash of all the windows' bytes."""
    if len(x) < window:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    roll = Rolling(x)
    i = np.arange(len(x) - gram + 1)
    h = roll(i, i + gram)
    places = np.uint64((1 << 24) - 1)
    low = _sliding_min(h & ~places | i.astype(np.uint64), window - gram + 1)
    anchor = (low & places).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:len(low)]
    ok = np.flatnonzero(np.arange(len(low)) + window <= ends)
    if not len(ok):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    a = anchor[ok]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)]))
    start, n, a = ok[first], np.diff(np.append(first, len(ok))), a[first]
    lead = a - start
    seg = roll(start, start + n + window - 1) ^ (lead.astype(np.uint64) << np.uint64(20)) ^ n.astype(np.uint64)
    return start, n, lead, h[a], seg


def _groups(texts, limit: int, window: int):
    """The texts in runs of at most ``limit`` bytes: lists of (index, offset,
    bytes); a longer text comes in slices that overlap by window - 1."""
    run, size = [], 0
    for k, t in enumerate(texts):
        if len(t) < window:
            continue
        for at in range(0, max(1, len(t) - window + 1), limit):
            part = t[at:at + limit + window - 1]
            if size + len(part) > limit + window and run:
                yield run
                run, size = [], 0
            run.append((k, at, part))
            size += len(part)
    if run:
        yield run


def anchors(docs: DataFrame, window: int, gram: int, run_bytes: int = 1 << 21) -> DataFrame:
    """(row, at, n, lead, key, seg): the segments of every text."""
    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column("text").to_pylist()]
            rows = b.column("row").to_numpy()
            for group in _groups(texts, run_bytes, window):
                sizes = np.array([len(p) for _, _, p in group])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                x = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
                start, n, lead, key, seg = segments(x, bounds, window, gram)
                of = np.searchsorted(bounds, start, side="right") - 1
                offset = np.array([at for _, at, _ in group])[of] - bounds[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[np.array([k for k, _, _ in group])[of]]), pa.array(start + offset), pa.array(n.astype(np.int32)),
                     pa.array(lead.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64))],
                    ["row", "at", "n", "lead", "key", "seg"])
    return docs.mapInArrow(run, "row long, at long, n int, lead int, key long, seg long")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text"))


def _zipped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, z): the texts compressed, for the network."""
    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array([z.compress(x or b"") for x in b.column("text").to_pylist()], pa.binary())],
                ["row", "doc_id", "z"])
    return docs.mapInArrow(run, "row long, doc_id long, z binary")


def _unzip(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


PIECE = "key long, sub long, piece long, src_key long, src_seg long, copy int, off int, n int, text binary"


def _pieces(z: DataFrame, wanted: DataFrame, window: int, width: int) -> DataFrame:
    """The texts of the wanted segments: (key, sub, piece, src_key, src_seg,
    copy, off, n, text).  A segment of a hot anchor comes in parts, each with the
    hash of what the part's windows share; of equal parts in one task only
    the first two carry the text."""
    def run(batches):
        sent: dict = {}
        for b in batches:
            out = []
            for zipped, segs in zip(b.column("z").to_pylist(), b.column("segs").to_pylist()):
                t = _unzip(zipped)
                for s in segs:
                    at, n, lead, key, seg, copy = s["at"], s["n"], s["lead"], s["key"], s["seg"], s["copy"]
                    if not s["hot"]:
                        out.append((key, 0, seg, key, seg, copy, 0, n, t[at:at + n + window - 1]))
                        continue
                    for q in range((lead - n + 1) // width, lead // width + 1):
                        # windows at distances q * width .. (q + 1) * width - 1 before the anchor
                        first, last = max(0, lead - (q + 1) * width + 1), min(n - 1, lead - q * width)
                        mid = at + lead - q * width
                        core = t[mid:mid + window - width + 1]
                        text = t[at + first:at + last + window]
                        sub = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                        piece = int.from_bytes(hashlib.blake2b(text + b"%d" % (lead - first), digest_size=8).digest(), "little", signed=True)
                        seen = sent.get((key, sub, piece), 0)
                        sent[key, sub, piece] = seen + 1
                        out.append((key, sub, piece, key, seg, copy, first, last - first + 1, text if seen < 2 else None))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
            names = ["key", "sub", "piece", "src_key", "src_seg", "copy", "off", "n", "text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("at", "n", "lead", "key", "seg", "hot", "copy")).alias("segs"))   # at most two a byte of the text
    return z.join(lists, "row").select("z", "segs").mapInArrow(run, PIECE)


def _names(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of ranks below 2^32."""
    out = keys[0]
    for k in keys[1:]:
        out = np.unique(out.astype(np.uint64) << np.uint64(32) | k.astype(np.uint64), return_inverse=True)[1]
    return out


def _repeated(x: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_windows(texts: list[bytes], window: int) -> list[np.ndarray]:
    """For each text, which of its windows occurs at another place of the
    texts: the suffixes sorted to depth ``window``, ties by cover ranks."""
    v = PERIOD
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    n = int(bounds[-1])
    x = np.zeros(n + window + v, np.uint64)
    x[:n] = np.frombuffer(b"".join(texts), np.uint8)
    eight = np.zeros(n + window, np.uint64)
    five = np.zeros(n + window, np.uint64)
    for j in range(8):
        eight = eight << np.uint64(8) | x[j:j + n + window]
    for j in range(8, v):
        five = five << np.uint64(8) | x[j:j + n + window]
    head = np.unique(eight, return_inverse=True)[1].astype(np.uint64)
    if n < 1 << 24:                                                        # as in every bundle of the usual size
        prefix = np.unique(head << np.uint64(40) | five, return_inverse=True)[1]
    else:
        prefix = _names(head, five >> np.uint64(20), five & np.uint64((1 << 20) - 1))
    del eight, five, head                                                  # prefix: the rank of the first 13 bytes
    ends = np.repeat(bounds[1:], sizes)
    i = np.flatnonzero(np.arange(n) + window <= ends)
    base = _names(prefix[i], prefix[i + window - v], prefix[i + window - 2 * v])
    tied = _repeated(base)
    i, base = i[tied], base[tied]
    dup = np.zeros(n, bool)
    if len(i):
        # ranks of the cover positions to depth 13, 26, 52, ... and then to ``depth``
        depth = v * ((window - v + 1) // v)
        on = np.isin(np.arange(n + window) % v, COVER)
        place = np.flatnonzero(on)
        index = np.full(n + 2 * window + v, len(place), np.int64)
        index[place] = np.arange(len(place))
        rank, d = np.append(prefix[place], 0), v

        def joined(step):
            return np.append(_names(rank[:-1], rank[index[place + step]]) + 1, 0)
        rank[:-1] += 1                                                     # 0: beyond the end
        while 2 * d <= depth:
            rank, d = joined(d), 2 * d
        if d < depth:
            rank = joined(depth - d)
        for shift in range(v):
            here = np.isin((i + shift) % v, COVER)
            key = base[here].astype(np.uint64) << np.uint64(32) | rank[index[i[here] + shift]].astype(np.uint64)
            dup[i[here][_repeated(key)]] = True
    return [dup[a:max(a, b - window + 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _compare(pieces: DataFrame, window: int, bundles: int) -> DataFrame:
    """(key, sub, piece, s, e): the repeated ranges of windows of every piece.
    Two texts of a piece are compared byte by byte: if they are equal, the piece is
    repeated.  One text of each piece is sorted with the others of its bucket."""
    def run(_, g):
        g = g.combine_chunks()
        ids = np.stack([g.column(c).to_numpy() for c in ("key", "sub", "piece", "src_seg", "copy")])
        order = np.lexsort(ids[::-1])
        ids = ids[:, order]
        n = len(order)
        # the first and the second text of each piece
        new = np.concatenate([[True], (ids[:3, 1:] != ids[:3, :-1]).any(0)]) if n else np.zeros(0, bool)
        second = np.concatenate([[False], new[:-1]]) & ~new if n else new
        firsts, texts = np.flatnonzero(new), pc.take(g.column("text"), pa.array(order[new])).to_pylist()
        place = np.cumsum(new) - 1
        twice = np.zeros(len(firsts), bool)
        pair = np.flatnonzero(second)
        for k, t in zip(place[pair].tolist(), pc.take(g.column("text"), pa.array(order[pair])).to_pylist()):
            twice[k] = t == texts[k]
        ids = ids[:, firsts]
        # a bucket of one text has nothing to put in order
        alone = np.concatenate([[True], (ids[:2, 1:] != ids[:2, :-1]).any(0), [True]]) if len(firsts) else np.ones(1, bool)
        many = np.flatnonzero(~(alone[:-1] & alone[1:]))
        of, s, e = [], [], []
        for k in np.flatnonzero(twice).tolist():
            of.append(k)
            s.append(0)
            e.append(len(texts[k]) - window + 1)
        for k, dup in zip(many.tolist(), repeated_windows([texts[k] for k in many.tolist()], window) if len(many) else []):
            if twice[k]:
                continue
            step = np.diff(np.concatenate([[0], dup.view(np.int8), [0]]))
            a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            of += [k] * len(a)
            s += a.tolist()
            e += b.tolist()
        of = np.array(of, np.int64)
        return pa.table({"key": ids[0][of], "sub": ids[1][of], "piece": ids[2][of], "s": pa.array(s, pa.int32()), "e": pa.array(e, pa.int32())})
    return (pieces.filter("text IS NOT NULL").select("key", "sub", "piece", "src_seg", F.col("copy").cast("long").alias("copy"), "text",
                                                     F.pmod(F.xxhash64("key", "sub"), F.lit(bundles)).alias("b"))
            .groupBy("b").applyInArrow(run, "key long, sub long, piece long, s int, e int"))


def _bundles(pieces: DataFrame, bundle_windows: int) -> int:
    return max(1, -(-(pieces.agg(F.sum(F.length("text"))).first()[0] or 0) // bundle_windows))


def _by_window(pieces: DataFrame, window: int, bundle_windows: int) -> DataFrame:
    """(key, sub, piece, s, e): the windows of the pieces that another piece of
    their (key, sub) holds, too.  Hashes of single windows deal them out; of each
    hash that occurs twice two windows are compared.  A piece's own windows
    lie at different distances from the anchor, so no two of them are equal."""
    def hashed(batches):
        for b in batches:
            of, at, h = [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for i in range(len(t) - window + 1):
                    of.append(k)
                    at.append(i)
                    h.append(int.from_bytes(hashlib.blake2b(t[i:i + window], digest_size=8).digest(), "little", signed=True))
            ids = [pc.take(b.column(c), pa.array(of, pa.int64())) for c in ("key", "sub", "piece", "src_seg", "copy")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(h, pa.int64())], ["key", "sub", "piece", "src_seg", "copy", "s", "h"])

    def cut(batches):
        for b in batches:
            out = []
            for key, sub, src, copy, text, own in zip(*(b.column(c).to_pylist() for c in ("key", "sub", "src_seg", "copy", "text", "own"))):
                out += [(key, x["h"], sub, key, src, copy, 0, 1, text[x["s"]:x["s"] + window]) for x in own]
            kinds = [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             ["key", "sub", "piece", "src_key", "src_seg", "copy", "off", "n", "text"])
    one = ["key", "sub", "piece", "src_seg", "copy"]
    w = persist(pieces.select(*one, "text").mapInArrow(hashed, "key long, sub long, piece long, src_seg long, copy int, s int, h long"), "windows")
    text = F.struct("piece", "src_seg", "copy", "s")
    # stored, so that the joins read plain rows and Spark can split a window that very many pieces hold
    again = persist(w.groupBy("key", "sub", "h").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b"), "again")
    two = again.select("key", "sub", "h", F.explode(F.array("a", "b")).alias("t")).select("key", "sub", "t.piece", "t.src_seg", "t.copy", "h", "t.s")
    lists = two.groupBy(*one).agg(F.collect_list(F.struct("s", "h")).alias("own"))           # at most the windows of a piece
    texts = persist(pieces.join(lists, one).select("key", "sub", "src_seg", "copy", "text", "own").mapInArrow(cut, PIECE), "window-texts")
    equal = persist(_compare(texts, window, _bundles(texts, bundle_windows)).select("key", F.col("piece").alias("sub"), F.col("sub").alias("h")), "equal")
    return w.join(equal, ["key", "sub", "h"]).select("key", "sub", "piece", "s", (F.col("s") + 1).cast("int").alias("e")).distinct()


def repeated_ranges(docs: DataFrame, window: int = 400, gram: int = 32, hot_segments: int = 1000,
                    bundle_windows: int = 1_000_000) -> DataFrame:
    """(row, s, e): the ranges of window starts of each text (row as
    ``_numbered`` gives it) that are repeated."""
    a = persist(anchors(_numbered(docs).select("row", "text"), window, gram), "anchors")
    place = F.struct("row", "at", "n", "lead")
    segs = a.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.max(place).alias("last"))
    keys = segs.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all")).filter("all > 1")
    segs = segs.join(keys, "key").withColumn("hot", F.col("kinds") > hot_segments)
    sides = F.when(F.col("copies") > 1, F.array("first", "last")).otherwise(F.array("first"))
    wanted = segs.select("key", "seg", "hot", F.posexplode(sides).alias("copy", "t")).select("t.row", "t.at", "t.n", "t.lead", "key", "seg", "hot", "copy")
    width = -(-(window - gram + 1) // 16)
    p = persist(_pieces(_zipped(_numbered(docs)), wanted, window, width), "pieces")
    sent = p.filter("text IS NOT NULL")
    # over the limit even there: single windows
    crowded = persist(sent.filter("sub <> 0").select("key", "sub", "piece").distinct().groupBy("key", "sub").agg(F.count(F.lit(1)).alias("c"))
                      .filter(F.col("c") > hot_segments).select("key", "sub"), "crowded")
    few = sent.join(crowded, ["key", "sub"], "left_anti")
    found = _compare(few, window, _bundles(few, bundle_windows)).unionByName(
        _by_window(sent.join(crowded, ["key", "sub"], "left_semi"), window, bundle_windows))
    back = p.filter("copy = 0").select("key", "sub", "piece", "src_key", "src_seg", "off").join(found, ["key", "sub", "piece"]).select(
        F.col("src_key").alias("key"), F.col("src_seg").alias("seg"), (F.col("off") + F.col("s")).alias("s"), (F.col("off") + F.col("e")).alias("e"))
    ranges = back.groupBy("key", "seg").agg(F.collect_list(F.struct("s", "e")).alias("r"))   # at most one a window of the segment
    # stored, so that the join below reads plain rows and Spark can split the segments with very many copies
    ranges = persist(ranges, "ranges")
    return a.select("row", "at", "key", "seg").join(ranges, ["key", "seg"]).select("row", "at", F.explode("r").alias("x")).select(
        "row", (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"))


def covered(ranges, window: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows starting in the ranges cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        e += window - 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, window: int = 400, texts: bool = False, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with
    ``texts`` the bytes kept (``kept``) and the spans cut (``spans``), too."""
    r = repeated_ranges(docs, window, **how).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("r"))   # at most one a byte of the text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", kept binary, spans array<struct<s:long,e:long>>" if texts else "")

    def run(batches):
        for b in batches:
            rows = []
            for z, found in zip(b.column("z").to_pylist(), b.column("r").to_pylist()):
                t = _unzip(z)
                spans = covered([(x["s"], x["e"]) for x in found or ()], window)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(t[at:s])
                    at = e
                kept = b"".join([*kept, t[at:]])
                rows.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept,
                             [{"s": s, "e": e} for s, e in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            m = 6 if texts else 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([x[i] for x in rows], kinds[i]) for i in range(m)]], ["doc_id", *names[:m]])

    return _zipped(_numbered(docs)).join(r, "row", "left").select("doc_id", "z", "r").mapInArrow(run, schema)
