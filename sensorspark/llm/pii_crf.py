"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans.  The CRF's nodes are the base spans, whose
labels are known, and outside them the candidates: runs of digits with the
marks that numbers are written with (blanks, dots, hyphens, slashes, brackets; a run of over 19
digits falls into its words), words that hold ``@``, and words that are the name or
the host of a mail address of the document.  Its potentials are node features, a
chain factor between neighbours and three skip factors that tie nodes anywhere
in the document, each occurrence to the one before: equal last seven digits,
equal text or mail name, equal mail host.
Loopy sum-product message passing over all documents of an Arrow batch at
once gives the marginals; a candidate becomes a span when its marginal passes
``min_probability``, so a number that is a phone number in one place is one in
its other spellings too.

The weights are trained by pseudo-likelihood on a bounded sample of documents
(``train_docs``) labelled by the patterns, and on some short texts by rule.  A candidate that a skip factor ties to a
base span has no label of its own there and does not count; instead every training document comes once
more with its base spans spelled in other ways, and with other numbers of the same
shapes that are tied to nothing: so it is the ties that tell them apart.

Cases: NULL and empty texts have no spans; repeated rows and NULL ids get one
result each; an empty table gives no rows; a corpus without candidates trains
an all-zero model that adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import WORD, hashed_sample

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start at the start of its digits: a later start would fail as the first one did.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
_TRIM = "\"'`()[]{}<>,.;:!?*$%&#|="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The pattern spans (code points, end exclusive) of each kind in order."""
    out: list[list[tuple[int, int]]] = [list(_emails(text)) if "@" in text else [], [], [], []]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split("."))):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out[3].append(m.span())
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, own in enumerate(spans) for s, e in sorted(own))


#: A number as it is written: digits with at most three marks between two of them.
_RUN = re.compile(r"[+(]?[0-9](?:[\x20().+/-]{0,3}[0-9])*")
CHAIN, DIGITS, NAME, HOST = range(4)
MOST_DIGITS = 19


def candidates(text: str, spans) -> list[tuple[int, int]]:
    """Spans outside the base ``spans`` that may be personal data."""
    mails = [text[s:e].lower() for s, e in spans[0]]
    names = {x for m in mails for x in m.split("@") if len(x) >= 4}
    out, at = [], 0
    for s, e in [*sorted((s, e) for own in spans for s, e in own), (len(text), len(text))]:
        if s > at:
            gap = text[at:s]
            runs = []
            for m in _RUN.finditer(gap):
                if len(_NO_DIGIT.sub("", m.group())) <= MOST_DIGITS:
                    runs.append(m.span())
                else:
                    runs += [(m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m.group()) if _DIGIT.search(w.group())]
            if names or "@" in gap:
                for m in _WORD.finditer(gap):
                    w = m.group()
                    core = w.strip(_TRIM)
                    if core and ("@" in w or core.lower() in names):
                        a = m.start() + w.index(core)
                        runs = [r for r in runs if r[1] <= a or r[0] >= a + len(core)] + [(a, a + len(core))]
            out += [(at + a, at + b) for a, b in sorted(runs)]
        at = max(at, e)
    return out


def links(text: str) -> list[tuple[int, str]]:
    """(kind of link, key) of a node's text."""
    digits, low = _NO_DIGIT.sub("", text), text.lower()
    out = [(DIGITS, digits[-7:])] if len(digits) >= 7 and "@" not in text else []
    if "@" in low:
        name, host = low.split("@")[:2]
        out += [(NAME, low), *([(NAME, name)] if len(name) >= 4 else []), *([(HOST, host)] if len(host) >= 4 else [])]
    elif len(low) >= 4:
        out += [(NAME, low), (HOST, low)]
    return out


def node_features(text: str, before: str) -> list[str]:
    digits = _NO_DIGIT.sub("", text)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda x: str(min(len(x.group()), 20)) + "d", text[:80]))
    f = [f"s={shape[:40]}", f"n={min(len(digits), 24)}", f"p={before[-12:].lower()}", f"c={text[:1] if not text[:1].isalnum() else 'x'}",
         f"dots={min(text.count('.'), 5)}", f"at={min(text.count('@'), 2)}", f"alpha={any(c.isalpha() for c in text)}", "bias"]
    if 13 <= len(digits) <= 19:
        f.append(f"luhn={luhn(digits)}")
    return f


class Tokens:
    """The nodes of a batch of documents as one graph."""

    def __init__(self):
        self.doc, self.start, self.end, self.features, self.label = [], [], [], [], []
        self.base, self.known = [], []          # is a base span; its label counts in training
        self.pairs = [[], [], [], []]           # edges by kind

    def add(self, doc: int, text: str, spans, more=()) -> None:
        """The document's nodes; ``more`` (start, end, kind) are further spans
        whose labels are known, but which no pattern finds."""
        named = {(s, e): k for s, e, k in more}
        nodes = [(s, e, k, True) for k, own in enumerate(spans) for s, e in own]
        nodes += [(s, e, named.get((s, e), OTHER), False) for s, e in candidates(text, spans)]
        nodes.sort(key=lambda n: (n[0], n[1], not n[3]))
        seen: dict = {}
        first, end = len(self.doc), -1
        for s, e, k, base in nodes:
            t = len(self.doc)
            own = text[s:e]
            gap = text[max(0, s - 40):s]
            if t > first and _WORD.search(text, max(end, 0), max(end, s)) is None:
                self.pairs[CHAIN].append((t - 1, t))
            tied = False
            for kind, key in links(own):
                if (kind, key) in seen:
                    u = seen[kind, key]
                    self.pairs[kind].append((u, t))
                    tied = tied or kind != HOST
                seen[kind, key] = t
            words = _WORD.findall(gap)
            named_here = (s, e) in named
            self.doc.append(doc)
            self.start.append(s)
            self.end.append(e)
            self.features.append(node_features(own, words[-1] if words else ""))
            self.label.append(k)
            self.base.append(base)
            self.known.append(base or named_here or not tied)
            end = e
        # a candidate before its base span is tied, too
        for kind in (DIGITS, NAME):
            for u, t in self.pairs[kind]:
                if u >= first and self.base[t] and not self.base[u] and (self.start[u], self.end[u]) not in named:
                    self.known[u] = False

    def edges(self):
        both = [np.array(x, np.int64).reshape(-1, 2) for x in self.pairs]
        kind = np.repeat(np.arange(len(both)), [len(x) for x in both])
        return np.concatenate(both), kind


def respelled(kind: int, text: str, rng) -> str | None:
    """Another way to write a base span, which no pattern finds."""
    if KINDS[kind] == "email":
        name = text.split("@")[0]
        return name if len(name) >= 4 and rng.random() < 0.5 else text.upper() if rng.random() < 0.5 else None
    digits = _NO_DIGIT.sub("", text)
    if KINDS[kind] == "phone":
        local = digits[-10:]
        return [digits, local, f"{local[:-7]}-{local[-7:-4]}-{local[-4:]}", f"({local[:-7]}) {local[-7:-4]}-{local[-4:]}", f"{local[:-7]} {local[-7:-4]} {local[-4:]}",
                f"{local[:-7]}.{local[-7:-4]}.{local[-4:]}"][int(rng.integers(0, 6))] if len(local) >= 8 else digits
    if KINDS[kind] == "card":
        return [".", "/", "  "][int(rng.integers(0, 3))].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return None


def spelled_again(text: str, spans, rng) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with other spellings of its base spans behind it and, as what is no
    personal data, numbers of the same shapes that nothing ties to a span and bare
    mail hosts; and where these are."""
    more = []
    for k, own in enumerate(spans):
        for s, e in own:
            for label in (k, OTHER):
                other = text[s:e]
                if label == k:
                    other = respelled(k, other, rng)
                elif KINDS[k] in ("card", "phone"):
                    other = respelled(k, re.sub("[0-9]", lambda _: str(rng.integers(0, 10)), other), rng)
                else:
                    other = other.split("@")[1] if "@" in other else None
                if other:
                    text += " ; "
                    more.append((len(text), len(text) + len(other), label))
                    text += other
    return text, more


#: Log odds of a given label.
GIVEN = 50.0


def _unary(features, index, weights):
    """Sum of the weights of each token's known features."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.array([index.get(x, -1) for f in features for x in f], np.int64)
    out = np.zeros((len(features), weights.shape[1]))
    np.add.at(out, rows[cols >= 0], weights[cols[cols >= 0]])
    return out


def fit(tokens: Tokens, rounds: int = 300, rate: float = 0.1, l2: float = 1e-3, masked: float = 0.3, seed: int = 7) -> dict:
    """Pseudo-likelihood weights: token features, chain and skip potentials."""
    k = OTHER + 1
    index = {x: i for i, x in enumerate(dict.fromkeys(x for f in tokens.features for x in f))}
    n = len(tokens.features)
    pair = np.zeros((4, k, k))
    w = np.zeros((len(index), k))
    if not n:
        return {"index": index, "weights": w, "pair": pair}
    y = np.array(tokens.label)
    one = np.eye(k)[y]
    known = np.array(tokens.known)
    e, kind = tokens.edges()
    around = np.zeros((4, n, k))        # the known labels of the neighbours, counted by kind of edge
    told = one * known[:, None]
    for t in range(4):
        np.add.at(around[t], e[kind == t, 0], told[e[kind == t, 1]])
        np.add.at(around[t], e[kind == t, 1], told[e[kind == t, 0]])
    rows = np.repeat(np.arange(n), [len(f) for f in tokens.features])
    cols = np.array([index[x] for f in tokens.features for x in f])
    hidden = (np.random.default_rng(seed).random(n) < masked) & (around[1:].sum((0, 2)) > 0)
    keep = ~hidden[rows] | (cols == index["bias"])
    rows, cols = rows[keep], cols[keep]
    share = 1.0 / max(1, known.sum())
    state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(pair), np.zeros_like(pair)]]
    for step in range(1, rounds + 1):
        z = np.zeros((n, k))
        np.add.at(z, rows, w[cols])
        z += sum(around[t] @ pair[t] for t in range(4))
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = (p - one) * share * known[:, None]
        gw = np.zeros_like(w)
        np.add.at(gw, cols, d[rows])
        gp = np.stack([around[t].T @ d for t in range(4)])
        gp = (gp + gp.transpose(0, 2, 1)) / 2     # an edge has no direction
        for x, g, (m, v) in ((w, gw + l2 * share * w, state[0]), (pair, gp + l2 * share * pair, state[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return {"index": index, "weights": w, "pair": pair}


def marginals(tokens: Tokens, model: dict, rounds: int = 30, damping: float = 0.5) -> np.ndarray:
    """Label marginals of all nodes by damped loopy sum-product in log space;
    the labels of base spans are given."""
    u = _unary(tokens.features, model["index"], model["weights"])
    given = np.flatnonzero(tokens.base)
    u[given] = -GIVEN
    u[given, np.array(tokens.label, np.int64)[given]] = 0
    e, kind = tokens.edges()
    src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    pot = model["pair"][np.concatenate([kind, kind])]
    half = len(e)
    back = np.concatenate([np.arange(half) + half, np.arange(half)])
    msg = np.zeros((2 * half, u.shape[1]))
    for _ in range(rounds if half else 0):
        belief = u.copy()
        np.add.at(belief, dst, msg)
        x = (belief[src] - msg[back])[:, :, None] + pot
        top = x.max(1, keepdims=True)
        new = np.log(np.exp(x - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        step = np.abs(new - msg).max()
        msg += (1 - damping) * (new - msg)
        if step < 1e-4:
            break
    np.add.at(u, dst, msg)
    u -= u.max(1, keepdims=True)
    p = np.exp(u)
    return p / p.sum(1, keepdims=True)


def add_spans(spans, tokens: Tokens, p: np.ndarray, min_probability: float):
    """``spans`` with the candidates whose marginal for a kind passes."""
    out = [[list(own) for own in s] for s in spans]
    if len(p):
        best, prob = p[:, :OTHER].argmax(1), p[:, :OTHER].max(1)
        for t in np.flatnonzero(~np.array(tokens.base) & (prob >= min_probability)).tolist():
            out[tokens.doc[t]][int(best[t])].append((tokens.start[t], tokens.end[t]))
    return [[sorted(own) for own in s] for s in out]


def examples(n: int, rng) -> list[str]:
    """``n`` short texts by rule with a span of each kind in turn and numbers
    that are none, so that a kind that the corpus's sample lacks is learned, too."""
    out = []
    for i in range(n):
        d = "".join(str(x) for x in rng.integers(0, 10, 40))
        card = d[:15]
        card += next(c for c in "0123456789" if luhn(card + c))
        own = (f"n{d[:3]}.{d[3:6]}@host{d[6:8]}.example", ".".join(str(int(x) % 256) for x in (d[8:11], d[11:14], d[14:17], d[17:20])),
               " ".join(card[k:k + 4] for k in range(0, 16, 4)), f"+{1 + int(d[20])} {d[21:24]} {d[24:27]} {d[27:31]}")[i % len(KINDS)]
        out.append(f"{own} ; {d[31:33]} , {d[33:39]} ; {d[33:39]}")
    return out


def train(docs: DataFrame, train_docs: int = 2000, train_chars: int = 100_000, n_examples: int = 200, seed: int = 7) -> dict:
    """Weights from at most ``train_docs`` different texts that hold a digit or
    ``@`` and at most ``train_chars`` characters (the first by a hash of the text, so
    that neither a source nor copies can crowd others out), and ``n_examples``
    texts by rule."""
    some = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= int(train_chars)))
    rows = sorted(r.text for r in hashed_sample(some, ["text"], train_docs).select("text").collect())
    return learn(rows, n_examples, seed)


def learn(texts: list[str], n_examples: int = 200, seed: int = 7) -> dict:
    """Weights from the texts, labelled by the patterns, and from examples."""
    tokens, rng = Tokens(), np.random.default_rng(seed)
    for i, text in enumerate([*texts, *examples(n_examples if texts else 0, rng)]):
        spans = base_spans(text)
        tokens.add(2 * i, text, spans)
        again, more = spelled_again(text, spans, rng)
        if more:
            tokens.add(2 * i + 1, again, base_spans(text), more)
    return fit(tokens)


def find(texts: list[str], model: dict, min_probability: float):
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    tokens = Tokens()
    for i, t in enumerate(texts):
        if "@" in t or _DIGIT.search(t):
            tokens.add(i, t, base[i])
    if not tokens.doc:
        return base, base
    return base, add_spans(base, tokens, marginals(tokens, model), min_probability)


def pii_spans(docs: DataFrame, min_probability: float = 0.95, train_docs: int = 2000) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and all spans of every row."""
    model = train(docs, train_docs)

    def run(batches):
        for b in batches:
            base, every = find([t or "" for t in b.column("text").to_pylist()], model, min_probability)
            cols = [b.column("doc_id")] + [pa.array([len(s[k]) for s in base], pa.int64()) for k in range(OTHER)]
            cols += [pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                     pa.array([joined(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans) -> str:
    """The text with every span replaced by its kind; overlapping spans become
    one, named after the first."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, own in enumerate(spans) for s, e in own):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, min_probability: float = 0.95, train_docs: int = 2000) -> DataFrame:
    """``docs`` with the spans replaced in ``text`` (and ``n_chars``, where it
    is a column, counted anew); every row and column stays."""
    model = train(docs, train_docs)
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            _, spans = find([t or "" for t in texts], model, min_probability)
            new = [t if t is None else redact_text(t, s) for t, s in zip(texts, spans)]
            cols = dict(zip(b.schema.names, b.columns))
            cols["text"] = pa.array(new, b.schema.field("text").type)
            if "n_chars" in cols:
                n = [old if t is None else len(t) for t, old in zip(new, cols["n_chars"].to_pylist())]
                cols["n_chars"] = pa.array(n, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, schema)
