"""Secrets by patterns and by sliding-window Shannon entropy.

The patterns give the base spans.  Outside them, every maximal run of a
character class's letters is a candidate string.  A window of the class's
width slides along it; the counts of the characters in it, and with them
sum c log2 c, are kept up to date by the character that enters and the one
that leaves, so a string costs one step a character whatever the width.  (The
terms are whole numbers, c log2 c times 2^32, so that nothing drifts.)  A window counts when its
entropy log2 w - sum c log2 c / w reaches the class's threshold and it mixes
the kinds of characters that a random string of the class has: words, numbers
and identifiers do not.  Overlapping windows of one string become one span.

Allow-list: a string of which a pattern of ``allow`` fits the whole, or that
holds an ``allow_words`` word in any case, adds nothing (UUIDs, alphabets,
placeholders).  The allow-list never takes a base span away.

Cases: NULL and empty texts have no spans; texts are scanned whole, however
long; repeated rows and NULL ids get one result each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
BASE = 3
# Case folding stays in ASCII: the Kelvin sign is no k.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A match that is too short ends where its run ends, and so would any later start in the run.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


class CharClass(NamedTuple):
    """A class of characters: what a candidate looks like, the window's width,
    the least entropy (bits a character) and the kinds a window must mix."""
    name: str
    run: re.Pattern
    width: int
    threshold: float
    mix: tuple[str, ...]


def char_class(name: str, letters: str, width: int, threshold: float, mix) -> CharClass:
    return CharClass(name, re.compile(f"(?<![{letters}])[{letters}]{{{width},}}"), width, threshold, tuple(mix))


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    char_class("upper hex", "0-9A-F", 20, 3.0, (UPPER, DIGIT)),
    char_class("lower hex", "0-9a-f", 20, 3.0, (LOWER, DIGIT)),
    char_class("lower alphanumeric", "0-9a-z", 20, 3.5, (LOWER, DIGIT)),
    char_class("upper alphanumeric", "0-9A-Z", 20, 3.5, (UPPER, DIGIT)),
    char_class("base64", "0-9A-Za-z+/_-", 20, 3.7, (LOWER, UPPER, DIGIT)),
)
ALLOW = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[/_-](?:[A-Za-z]{2,}|[0-9]{1,4}))+",
)
ALLOW_WORDS = ("example", "placeholder", "dummy", "changeme", "abcdefghij", "0123456789abc", "1234567890abc")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The pattern spans (code points, end exclusive) of each base kind in order."""
    return [[m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6],
            [m.span() for m in _ACCESS.finditer(text)],
            [m.span() for m in _HEX.finditer(text)]]


_TERM: list[int] = [0]


def _terms(n: int) -> list[int]:
    while len(_TERM) <= n:
        c = len(_TERM)
        _TERM.append(round(c * log2(c) * (1 << 32)))
    return _TERM


def high_windows(string: str, cls: CharClass) -> list[tuple[int, int]]:
    """The union of the windows of ``string`` that pass, as spans."""
    w = cls.width
    if len(string) < w:
        return []
    term = _terms(w)
    most = int((log2(w) - cls.threshold) * w * (1 << 32))       # entropy >= threshold: sum of terms <= most
    kind = {c: i for i, letters in enumerate(cls.mix) for c in letters}
    kinds = [0] * (len(cls.mix) + 1)
    counts: dict[str, int] = {}
    total, out = 0, []
    for i, c in enumerate(string):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        kinds[kind.get(c, -1)] += 1
        if i >= w:
            gone = string[i - w]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
            kinds[kind.get(gone, -1)] -= 1
        if i >= w - 1 and total <= most and all(kinds[:-1]):
            if out and i - w + 1 <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - w + 1, i + 1))
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def entropy_spans(text: str, base, classes=CLASSES, allow=ALLOW, allow_words=ALLOW_WORDS) -> list[tuple[int, int]]:
    """Spans that the windows add outside the ``base`` spans."""
    gaps, at = [], 0
    for s, e in merged(x for own in base for x in own):
        gaps.append((at, s))
        at = e
    gaps.append((at, len(text)))
    fits = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None
    found = []
    for cls in classes:
        for a, b in gaps:
            if b - a < cls.width:
                continue
            for m in cls.run.finditer(text[a:b]):
                own = high_windows(m.group(), cls)
                if own and not (fits and fits.fullmatch(m.group())) and not any(x in m.group().lower() for x in allow_words):
                    found += [(a + m.start() + s, a + m.start() + e) for s, e in own]
    return merged(found)


def joined(spans) -> str:
    """kind:start:end of every span, by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, own in enumerate(spans) for s, e in own))


def find(text: str, **options) -> list[list[tuple[int, int]]]:
    """The spans of each kind of KINDS in a text."""
    base = base_spans(text)
    return [*base, entropy_spans(text, base, **options)]


def secret_spans(docs: DataFrame, classes=CLASSES, allow=ALLOW, allow_words=ALLOW_WORDS) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every row."""
    def run(batches):
        for b in batches:
            every = [find(t or "", classes=classes, allow=allow, allow_words=allow_words) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id")] + [pa.array([len(s[k]) for s in every], pa.int64()) for k in range(len(KINDS))]
            cols += [pa.array([hashlib.sha256(joined(s[:BASE]).encode()).hexdigest() for s in every], pa.string()),
                     pa.array([joined(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(docs: DataFrame, classes=CLASSES, allow=ALLOW, allow_words=ALLOW_WORDS) -> DataFrame:
    """``docs`` with every stretch of secret characters in ``text`` replaced by
    ``<SECRET>``; every row and every other column stays."""
    schema = docs.schema

    def hide(t):
        out, at = [], 0
        for s, e in merged(x for own in find(t, classes=classes, allow=allow, allow_words=allow_words) for x in own):
            out += [t[at:s], "<SECRET>"]
            at = e
        return "".join(out) + t[at:]

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            new = pa.array([t if t is None else hide(t) for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), new)

    return docs.mapInArrow(run, schema)
