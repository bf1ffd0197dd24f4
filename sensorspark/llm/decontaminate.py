"""Benchmark decontamination by pigeonhole edit matching.

An item of L characters may be found with e = floor(rate * L) edits.  Split
into e + 1 pieces, at least one piece must occur unchanged, so the exact hits
of all pieces (one Aho-Corasick pass over each text) give every candidate
place; Myers' bit-parallel distance over that place decides.  Texts and items
are compared lower-cased with every run of other characters than letters and
digits as one blank.  An item that is allowed no edit (below two pieces of
``min_piece`` characters, however short) must occur unchanged between word
borders; with edits a cut word costs some.

The different item texts come in blocks of about ``block_chars`` characters, each
sent to all tasks and held against all documents; the documents never move.  The
matches of a text are joined with the items that have it.

Cases: NULL texts count as empty and match nothing; items without a letter or
digit, or a NULL text, are left out; an item without an id counts (its matches have a NULL
id); repeated items and rows count each;
an empty table on either side gives no matches; other columns stay (filter) or
are ignored (matches), whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W_]+")


def normalised(text) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float, min_piece: int = 8) -> int:
    """Edits allowed for an item: its share of the length, as far as every
    piece keeps ``min_piece`` characters."""
    return max(0, min(int(rate * length), length // min_piece - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors`` + 1 pieces of nearly equal length."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern_masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """(distance, end) of the best place of the pattern in ``text`` (the first
    of several), by Myers' bit-vector recurrence; distance limit + 1 if none
    is within ``limit``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = (m, 0) if m <= limit else (limit + 1, -1)
    for at, c in enumerate(text):
        eq = pattern_masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full          # a place may start anywhere: no border cost
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items, found = [], {}
        for item_id, text in items:
            t = normalised(text)
            if t:
                e = budget(len(t), rate)
                for offset, piece in pieces(t, e):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, masks(t), len(t), e))
        self.tree = ahocorasick.Automaton()
        for piece, where in found.items():
            self.tree.add_word(piece, (len(piece), where))
        self.tree.make_automaton()

    def __call__(self, text, first: bool = False) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) of each item that
        occurs, at its best place; with ``first`` at most one of them."""
        if not self.items:
            return []
        t = normalised(text)
        places: dict[int, list[int]] = {}
        for end, (n, where) in self.tree.iter(t):
            for k, offset in where:
                places.setdefault(k, []).append(end + 1 - n - offset)
        out = []
        for k, starts in sorted(places.items()):
            item_id, eq, m, e = self.items[k]
            best = (e + 1, -1)
            starts.sort()
            if e == 0:
                at = next((a for a in starts if t[a - 1:a] in ("", " ") and t[a + m:a + m + 1] in ("", " ")), None)
                if at is not None:
                    out.append((item_id, 0, at + m))
                    if first:
                        break
                continue
            i = 0
            while i < len(starts):
                a = b = starts[i]
                while i < len(starts) and starts[i] <= b + 2 * e + 1 and starts[i] - a <= 4 * m:
                    b = starts[i]
                    i += 1
                low = max(0, a - e)
                d, end = myers(eq, m, t[low:b + m + e], e)
                if d < best[0]:
                    best = (d, low + end)
                if d == 0:
                    break
            if best[0] <= e:
                out.append((item_id, *best))
                if first:
                    break
        return out


def item_blocks(benchmark: DataFrame, block_chars: int):
    """The different item texts with their MD5, one bounded block after the other."""
    b = benchmark.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for i in range(n):
        rows = b.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i).select(F.md5(F.col("text").cast("binary")).alias("key"), "text").collect()
        yield sorted((r.key, r.text) for r in rows)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.07, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, edits, end: every benchmark item found in a document,
    with the edits and (normalised) end of its best place."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, block_chars):
        def run(batches, items=items):
            find = Matcher(items, rate)
            for b in batches:
                rows = [(i, *m) for i, t in enumerate(b.column("text").to_pylist()) for m in find(t)]
                yield pa.RecordBatch.from_arrays(
                    [pc.take(b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()),
                     *[pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)]], ["doc_id", "key", "edits", "end"])
        part = d.mapInArrow(run, "doc_id long, key string, edits long, end long")
        out = part if out is None else out.unionByName(part)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.md5(F.col("text").cast("string").cast("binary")).alias("key"))
    return out.join(named, "key").select("doc_id", "item_id", "edits", "end")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.07, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no benchmark item is found."""
    schema = docs.schema
    for items in item_blocks(benchmark, block_chars):
        def run(batches, items=items):
            find = Matcher(items, rate)
            for b in batches:
                yield b.filter(pa.array([not find(t, first=True) for t in b.column("text").to_pylist()], pa.bool_()))
        docs = docs.mapInArrow(run, schema)
    return docs
