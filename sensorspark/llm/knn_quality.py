"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed byte trigrams, hashed 4-grams of character classes
and a few binned style figures (share of repeated words, capitals, marks ...).
Square-rooted shares times inverse document frequency (counted over all
documents) are projected on the leading right singular vectors of a bounded
labelled sample.  The labelled vectors (at most ``max_labelled``, a fixed
number of small vectors) go to every task, which takes exact cosine products
of each block of documents with all of them; the ``neighbours`` most similar
(and all that tie with the last of them) vote with a power of their
similarity, labels of the rarer class weighted up.

Cases: NULL and empty texts have no terms but their style; a text that
resembles no labelled one gets the share of label 1; without labels every score
is 0.5; of labels that repeat an id each value counts once, of documents that
do one trains; rows with a NULL id or label
are no training rows but are scored; repeated rows are scored each; an empty
table gives no rows; ``documents`` columns other than text are never read by
the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import crc_fold, hashed_sample

TRIGRAMS, SHAPES, BINS = 2048, 512, 8
FIGURES = 7
DIM = TRIGRAMS + SHAPES + FIGURES * BINS


def _byte_classes() -> np.ndarray:
    c = np.full(256, 15, np.uint32)                      # other control characters
    for i in range(256):
        ch = chr(i)
        if i >= 128 or "a" <= ch <= "z":
            c[i] = 0
        elif "A" <= ch <= "Z":
            c[i] = 1
        elif "0" <= ch <= "9":
            c[i] = 2
        elif ch == " ":
            c[i] = 3
        elif ch in "\n\r\t\v\f":
            c[i] = 4
        elif ch in ".,;:'\"?-":
            c[i] = 5
        elif ch == "!":
            c[i] = 6
        elif ch == "|":
            c[i] = 7
        elif i > 32:
            c[i] = 8 + i % 7
    return c


CLASS = _byte_classes()


def _add_terms(out: np.ndarray, x: np.ndarray) -> None:
    """Counts of the hashed trigrams and class 4-grams of one run of bytes."""
    if len(x) >= 3:
        y = x.astype(np.uint32)
        h = ((y[:-2] << 16 | y[1:-1] << 8 | y[2:]) * np.uint32(2654435761)) >> np.uint32(21)
        out[:TRIGRAMS] += np.bincount(h, minlength=TRIGRAMS)
    if len(x) >= 4:
        y = CLASS[x]
        h = ((y[:-3] << 12 | y[1:-2] << 8 | y[2:-1] << 4 | y[3:]) * np.uint32(2654435761)) >> np.uint32(23)
        out[TRIGRAMS:TRIGRAMS + SHAPES] += np.bincount(h, minlength=SHAPES)


def features(texts: list[bytes], slice_bytes: int = 1 << 20) -> np.ndarray:
    """(texts x DIM) square-rooted term shares; long texts are counted in slices."""
    out = np.zeros((len(texts), DIM), np.float32)
    row = np.zeros(DIM)
    for i, t in enumerate(texts):
        x = np.frombuffer(t, np.uint8)
        row[:] = 0
        kinds = np.zeros(16, np.int64)
        for at in range(0, len(x), slice_bytes):
            _add_terms(row, x[max(0, at - 3):at + slice_bytes])
            kinds += np.bincount(CLASS[x[at:at + slice_bytes]], minlength=16)
        for a, b in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + SHAPES)):
            total = row[a:b].sum()
            if total:
                out[i, a:b] = np.sqrt(row[a:b] / total)
        words = t.split()
        n, letters = max(1, len(x)), max(1, kinds[0] + kinds[1])
        figures = (len(set(words)) / max(1, len(words)), kinds[1] / letters, kinds[6:].sum() / n * 4, kinds[2] / n * 4,
                   len(x) / max(1, len(words)) / 16, kinds[4] / max(1, len(words)) * 4, np.log1p(len(words)) / 10)
        for k, v in enumerate(figures):
            out[i, TRIGRAMS + SHAPES + k * BINS + min(BINS - 1, int(v * BINS))] = 0.5
    return out


def _texts(batch, column="text") -> list[bytes]:
    return [x or b"" for x in pc.cast(batch.column(column), pa.large_binary()).to_pylist()]


def _parts(batch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and their number: one vector
    of DIM sums from each task, added up by Spark."""
    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for p in _parts(b):
                df += (features(_texts(p)) > 0).sum(0)
                n += p.num_rows
        term = np.arange(DIM + 1)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.append(df, n), pa.int64())], ["term", "n"])
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r.term] = r.n
    return out[:DIM], int(out[DIM])


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``max_labelled`` labelled documents out
    of the held-out fold: the first by a hash of id and label.  Of documents
    that share an id the one whose text has the smallest hash trains."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(crc_fold(F.col("doc_id"), folds) != held)
             .select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")))
    ids = hashed_sample(known, ["_id", "_y"], max_labelled)

    def run(batches):
        for b in batches:
            for p in _parts(b):
                yield pa.RecordBatch.from_arrays(
                    [p.column("_id"), p.column("_y"), pa.array([zlib.compress(v.tobytes(), 1) for v in features(_texts(p))], pa.binary())],
                    ["id", "y", "x"])
    text = F.col("text").cast("string")
    rows = (docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))       # at most max_labelled pairs
            .groupBy("_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .mapInArrow(run, "id long, y int, x binary").collect())
    rows.sort(key=lambda r: (r.id, r.y, r.x))
    x = np.stack([np.frombuffer(zlib.decompress(r.x), np.float32) for r in rows]) if rows else np.zeros((0, DIM), np.float32)
    return x, np.array([r.y for r in rows], np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Projection, labelled vectors and the vote."""

    def __init__(self, x, y, df, n, dims: int = 64, neighbours: int = 15, power: float = 4.0, seed: int = 3):
        self.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
        self.prior = float(y.mean()) if len(y) else 0.5
        self.k, self.power = neighbours, power
        x = _unit(x * self.idf)
        q = np.random.default_rng(seed).standard_normal((DIM, min(dims + 16, DIM))).astype(np.float32)
        for _ in range(4):                          # subspace iteration towards the right singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0].astype(np.float32) if len(x) else q
        if len(x):
            s, v = np.linalg.eigh(q.T @ (x.T @ (x @ q)))
            q = (q @ v[:, ::-1])[:, :dims].astype(np.float32)
        self.axes = q[:, :dims]
        self.vectors, self.labels = _unit(x @ self.axes), y.astype(np.float32)
        rare = min(self.prior, 1 - self.prior)
        self.weight = np.where(self.labels == 1, 1.0, np.sqrt((1 - rare) / rare) if rare > 0 else 1.0).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        sim = _unit((features(texts) * self.idf) @ self.axes) @ self.vectors.T
        k = min(self.k, sim.shape[1])
        kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        # all that tie with the k-th vote (sums of 32-bit products differ in the last digits)
        near = np.where(sim >= kth[:, None] - 1e-5, np.maximum(sim, 0.0), 0.0).astype(np.float64)
        doc, labelled = np.nonzero(near)
        s = near[doc, labelled] ** self.power * self.weight[labelled]
        total = np.bincount(doc, s, len(texts))
        for_one = np.bincount(doc, s * self.labels[labelled], len(texts))
        return np.where(total > 0, for_one / np.maximum(total, 1e-300), self.prior).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_labelled: int = 4096, **how) -> Model:
    x, y = training_rows(docs, labels, folds, held, max_labelled)
    return Model(x, y, *document_frequency(docs), **how)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels, folds, held, **how)

    def run(batches):
        for b in batches:
            for p in _parts(b):
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(model.scores(_texts(p)), pa.float64())], ["doc_id", "score"])
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return s.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score reaches ``threshold``."""
    model = fit(docs, labels, **how)

    def run(batches):
        for b in batches:
            for p in _parts(b):
                yield p.filter(pa.array(model.scores(_texts(p)) >= threshold))
    return docs.mapInArrow(run, docs.schema)
