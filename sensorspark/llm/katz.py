"""Katz backoff language model, counted and evaluated as Spark jobs.

Counts of order r <= ``cutoff`` are discounted by Good-Turing; what the seen
followers of a history lose goes to the unseen ones in proportion to the lower
order, with backoff weights that make every distribution sum to one:

    p(w | h) = d(c) c(h w) / c(h)                             if c(h w) > 0
             = alpha(h) p(w | h')                             else
    alpha(h) = (1 - sum of the seen p(w | h)) / (1 - sum of their p(w | h'))

The lowest order leaves its lost mass to the unknown word.  An order whose
discounts cannot be computed keeps its counts whole; a history that then loses
nothing counts one token more, so that unseen words keep some mass.

Documents are packed into blocks of about ``block_tokens`` tokens with a local
vocabulary.  Once the words have ids, rising as their counts fall, a block keeps
its tokens by the rank of their ids and no words; what was stored before goes.
For each higher order the blocks send their distinct n-grams, once each,
to hashed buckets; a bucket adds up the training counts, writes its part of
the model table (partitioned by order) and answers each block in the order it
asked.  So a frequent n-gram costs a row a block, and no task holds more than
a bucket or a block.  From order 3 on, where the blocks need their answers to
ask, the buckets are asked in ``rounds``, so that only one round's requests are
on disk beside them.  Histories with more than ``hot_tokens`` tokens are split
over several buckets by the follower; their sums are added up by Spark and
joined to the blocks.  Blocks then evaluate the recursion for all their tokens.

Cases: NULL and empty texts are the end token alone; NULL ids belong to the
training rows (their fold is unknown) and are scored; repeated rows count and
are scored each; without training rows every word is unknown and has
probability one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import crc_fold, discard, free_shuffles, persist

END = b""               # words are never empty
UNKNOWN, START = 0, 1   # ids; words of the training rows have ids from 2
_U32 = np.uint64(32)


def put(x: np.ndarray) -> bytes:
    """An array, compressed; whole numbers in the least width that holds them,
    their bytes in planes (all lowest bytes, then all next ...)."""
    x = np.asarray(x)
    if x.dtype.kind in "iub":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    else:
        raw = x
    return x.dtype.char.encode() + zstandard.ZstdCompressor(level=3).compress(raw.tobytes())


def get(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    raw = zstandard.ZstdDecompressor().decompress(b[1:])
    if kind.kind == "f":
        return np.frombuffer(raw, kind)
    planes = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def put_rising(x: np.ndarray, new: np.ndarray | None = None) -> bytes:
    """Numbers that rise, everywhere or between the places ``new``, by their steps."""
    d = np.diff(x, prepend=0)
    return put(d if new is None else np.where(new, x, d))


def get_rising(b: bytes, new: np.ndarray | None = None) -> np.ndarray:
    d = get(b)
    if new is None:
        return np.cumsum(d)
    total = np.cumsum(d)
    head = np.flatnonzero(new)
    return total - np.repeat(total[head] - d[head], np.diff(np.append(head, len(d))))


def put_known(ident: np.ndarray, count: np.ndarray) -> bytes:
    """The ids of n-grams that have a count; in an answer they rise."""
    return put_rising(ident[count > 0])


def get_known(b: bytes, count: np.ndarray) -> np.ndarray:
    out = np.full(len(count), UNKNOWN, np.int64)
    out[count > 0] = get_rising(b)
    return out


def put_words(words) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def get_words(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b"\n")


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words (runs of anything but ASCII white space) each text (UTF-8)
    has, and all of them, A-Z lower-cased."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words = split.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)                     # white space at either end leaves an empty one
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    cut = split.offsets.to_numpy()
    cut = cut - cut[0]
    return ends[cut[1:]] - ends[cut[:-1]], words.filter(full).view(pa.binary())


def tokens_of(text) -> list[bytes]:
    """The words of a text as UTF-8, then the end."""
    return [*words_of(pa.array([text], pa.binary()))[1].to_pylist(), END]


def _hash(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U32)


def _steps(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in equal ones side by side."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers, which of them each number is, the order that sorts
    the numbers and where a new one begins there."""
    order = np.argsort(x)
    s = x[order]
    new = _steps(s)
    code = np.empty(len(x), np.int64)
    code[order] = np.cumsum(new) - 1
    return s[new], code, order, np.flatnonzero(new)


def discounts(n_r, cutoff: int) -> list[float]:
    """Good-Turing factors d_1 .. d_cutoff from the numbers n_1 .. n_(cutoff+1)
    of n-grams by count; 1 (no discount) where they cannot be had."""
    n = [0, *n_r]
    a = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, cutoff + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


def put_history(sums: np.ndarray, mass: np.ndarray, need: np.ndarray) -> tuple[bytes, bytes]:
    """What a block must know of its histories: of those whose backoff weight it needs,
    how many n-grams have each small count and their mass one order down; of the
    others, which small counts occur (so whether they lose anything)."""
    flags = ((sums > 0) << np.arange(sums.shape[1])).sum(1) | need.astype(np.int64) << sums.shape[1]
    return put(np.concatenate([flags, sums[need].ravel()])), put(mass[need])


def get_history(b: bytes, c: bytes, n: int, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, mass) of ``n`` histories; 1 stands for any number, and 0 for the mass, where neither is needed."""
    x = get(b)
    flags = x[:n]
    sums, mass = flags[:, None] >> np.arange(cutoff) & 1, np.zeros(n)
    need = flags >> cutoff > 0
    sums[need], mass[need] = x[n:].reshape(-1, cutoff), get(c)
    return sums, mass


@dataclass
class Stats:
    """What the whole training text says: tokens, documents, words, and by
    order the discounts."""
    tokens: int
    documents: int
    words: int
    cutoff: int
    factors: list[list[float]]

    def factor(self, order: int, c: np.ndarray) -> np.ndarray:
        table = np.array([1.0, *self.factors[order - 1], 1.0])
        return table[np.minimum(c, self.cutoff + 1)]

    def unigram(self, c: np.ndarray, lost: float) -> np.ndarray:
        """p(w) from the word's count; ``lost`` is the unknown word's mass."""
        if lost <= 0:
            return np.where(c > 0, c, 1.0) / (self.tokens + 1)
        return np.where(c > 0, self.factor(1, c) * c / max(1, self.tokens), lost)

    lost: float = 0.0


def make_blocks(docs: DataFrame, folds: int, held: int, block_tokens: int) -> DataFrame:
    """One row a block: ids and folds of its documents, their lengths, the
    tokens as numbers of the local vocabulary, and that vocabulary."""
    def row(parts):
        ids, held, sizes, words = zip(*parts)
        sizes = np.concatenate(sizes) + 1                                # each text's end is a token, too
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)                        # sorted, they compress better; the end comes first
        local = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.take(order)])
        ends = np.zeros(int(sizes.sum()), bool)
        ends[np.cumsum(sizes) - 1] = True
        code = np.zeros(len(ends), np.int64)
        code[~ends] = 1 + np.argsort(order.to_numpy())[coded.indices.to_numpy()]
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(local)], local), b"\n")[0].as_py()
        return pa.RecordBatch.from_arrays(
            [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([pa.concat_arrays(held).to_pylist()], pa.list_(pa.bool_())),
             pa.array([put(sizes)], pa.binary()), pa.array([put(code)], pa.binary()), pa.array([put_words([joined])], pa.binary()),
             pa.array([len(code)], pa.int64())],
            ["doc_id", "held", "sizes", "tokens", "words", "n"])

    def run(batches):
        parts, left = [], block_tokens
        for b in batches:
            # texts of about as many bytes as a block may have tokens at a time
            length = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(_steps(np.cumsum(length) // block_tokens))
            for lo, hi in zip(cut, [*cut[1:], len(length)]):
                sizes, words = words_of(b.column("text").slice(lo, hi - lo))
                upto, at, start = np.cumsum(sizes + 1), 0, 0
                while at < len(sizes):
                    # up to and with the document that fills the block
                    to = min(int(np.searchsorted(upto, left + (upto[at - 1] if at else 0))) + 1, len(sizes))
                    n = int(sizes[at:to].sum())
                    parts.append((b.column("doc_id").slice(lo + at, to - at), b.column("held").slice(lo + at, to - at), sizes[at:to], words.slice(start, n)))
                    left -= n + to - at
                    at, start = to, start + n
                    if left <= 0:
                        yield row(parts)
                        parts, left = [], block_tokens
        if parts:
            yield row(parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id array<long>, held array<boolean>, sizes binary, tokens binary, words binary, n long").withColumn(
        "block", F.monotonically_increasing_id())


ANSWER = "kind string, block long, part long, a binary, b binary, c binary, d binary, stat array<long>"
_ANSWER = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int64()), *[(c, pa.binary()) for c in "abcd"], ("stat", pa.list_(pa.int64()))])


def _answers(rows) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ANSWER.names, (*r, *[None] * (8 - len(r))))) for r in rows], _ANSWER)


def _by_count(c: np.ndarray, cutoff: int) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= cutoff + 1)], minlength=cutoff + 2)[1:cutoff + 2].tolist()


def _word_parts(words: list[bytes], buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], np.int64) % buckets


class Block:
    """A block's tokens, with what the answers say about them.  Ids rise with
    the local number of the words."""

    def __init__(self, row: dict):
        self.held, self.sizes, self.token = np.array(row["held"], bool), get(row["sizes"]), get(row["tokens"])
        self.word_id, self.word_count = get_rising(row["ids"]), get(row["counts"])
        self.ends = np.cumsum(self.sizes)
        self.place = np.arange(len(self.token)) - np.repeat(self.ends - self.sizes, self.sizes)     # in the document
        self.train = np.repeat(~self.held, self.sizes)

    def start(self, stats: Stats) -> None:
        """Order 1 of every token: the n-gram's local number, id, count, and p."""
        self.order = 1
        self.p = stats.unigram(self.word_count[self.token], stats.lost)
        self.gram, self.gram_id, self.gram_count = self.token, self.word_id, self.word_count
        # what p = factor(c) c / total divides by, for each n-gram
        self.gram_total = np.full(len(self.word_id), stats.tokens + 1 if stats.lost <= 0 else max(1, stats.tokens), np.int64)

    def next_order(self, stats: Stats, hot: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Number the distinct n-grams of the next order and put those with a known
        history in the order of the request (part, history, word): the part of
        each and whether its history is split."""
        k = self.order + 1
        at = np.flatnonzero(self.place >= k - 2)
        # the history is the n-gram that ends one token before; at a document's start it is the start sign
        ids, counts = np.append(self.gram_id, START), np.append(self.gram_count, stats.documents)
        by_id = np.argsort(ids)
        rank = np.empty(len(ids), np.uint64)
        rank[by_id] = np.arange(len(ids), dtype=np.uint64)
        history = rank[np.where(self.place[at] == 0, len(ids) - 1, self.gram[np.maximum(at - 1, 0)])]
        distinct, self.pair, order, new = _distinct(history << _U32 | self.token[at].astype(np.uint64))
        self.at, self.one = at, at[order[new]]
        history = by_id[(distinct >> _U32).astype(np.int64)]
        self.ctx, self.ctx_count = ids[history], counts[history]
        self.follower = self.word_id[(distinct & np.uint64((1 << 32) - 1)).astype(np.int64)]
        known = np.flatnonzero(self.ctx_count > 0)
        ctx, splits = self.ctx[known], 1 + self.ctx_count[known] // hot
        sub = np.zeros(len(known), np.int64)
        split = splits > 1
        sub[split] = (_hash(self.follower[known[split]], 1) % splits[split].astype(np.uint64)).astype(np.int64)
        part = (_hash(ctx, sub) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        by_part = np.argsort(part, kind="stable")
        self.sent = known[by_part]
        return part[by_part].astype(np.int64), split[by_part]

    def request(self) -> tuple[np.ndarray, ...]:
        """Of the n-grams to send: history, word, training count here, and the count of the
        n-gram without its first word (where it is trained here) with the total it
        is divided by, which is one number a history."""
        seen = np.bincount(self.pair[self.train[self.at]], minlength=len(self.ctx))[self.sent]
        lower = self.gram[self.one[self.sent]]
        return self.ctx[self.sent], self.follower[self.sent], seen, np.where(seen > 0, self.gram_count[lower], 0), self.gram_total[lower]

    def learn(self, stats: Stats, answers: dict, hot_sums: tuple | None, hot: int, buckets: int) -> None:
        """One order up: counts, ids, history sums and p of every token."""
        part, split = self.next_order(stats, hot, buckets)
        k, n = self.order + 1, len(self.ctx)
        ctx = self.ctx[self.sent]
        weights = np.arange(1, stats.cutoff + 1) * (1 - np.array(stats.factors[k - 1]))
        count, ident = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lost, low = np.zeros(n), np.zeros(n)
        head = np.flatnonzero(_steps(part))
        for a, b in zip(head, [*head[1:], len(part)]):
            r, o = answers[int(part[a])], self.sent[a:b]
            count[o] = counted = get(r["a"])
            if r["d"] is not None:
                ident[o] = get_known(r["d"], counted)
            of = np.cumsum(_steps(ctx[a:b])) - 1
            sums, mass = get_history(r["b"], r["c"], int(of[-1]) + 1, stats.cutoff)
            lost[o], low[o] = (sums * weights).sum(1)[of], mass[of]
        if split.any():
            # the sums of all the buckets of a split history
            of, sums, mass = hot_sums
            order = np.argsort(of)
            i = order[np.searchsorted(of, ctx[split], sorter=order)]
            lost[self.sent[split]], low[self.sent[split]] = (sums * weights).sum(1)[i], mass[i]
        total = np.maximum(self.ctx_count, 1).astype(float)
        spare = lost <= 0                                               # nothing discounted: one token more
        total[spare] += 1                                               # as ``get_history`` says, right for all histories
        alpha = np.where(spare, 1.0, lost) / total / np.maximum(1 - low, 1e-300)
        alpha[self.ctx_count == 0] = 1.0
        p = np.where(count > 0, stats.factor(k, count) * count / total, 0.0)
        here = p[self.pair]
        new = self.p.copy()
        new[self.at] = np.where(here > 0, here, alpha[self.pair] * self.p[self.at])
        gram = np.zeros(len(self.token), np.int64)
        gram[self.at] = self.pair
        self.order, self.p, self.gram, self.gram_id, self.gram_count, self.gram_total = k, new, gram, ident, count, total.astype(np.int64)


def _block_of(row: dict, rows: list[dict], plan: dict, upto: int) -> Block:
    """A block evaluated up to an order from its answers (``part`` holds the
    order in its high bits)."""
    block = Block(row)
    answers: dict[int, dict] = {}
    hot: dict[int, tuple] = {}
    for r in rows:
        order, part = r["part"] >> 40, r["part"] & (1 << 40) - 1
        if r["kind"] == "reply":
            answers.setdefault(order, {})[part] = r
        else:
            hot[order] = get(r["a"]), get(r["b"]).reshape(-1, plan["stats"].cutoff), get(r["c"])
    block.start(plan["stats"])
    for order in range(2, upto + 1):
        block.learn(plan["stats"], answers.get(order, {}), hot.get(order), plan["hot"], plan["buckets"])
    return block


def _with_answers(blocks: DataFrame, answers: DataFrame | None, run, ddl: str) -> DataFrame:
    """The tables that ``run`` makes of every block (a row) and its answers (rows)."""
    if answers is None:
        def each(batches):
            for b in batches:
                for row in b.to_pylist():
                    yield from run(row, []).to_batches()
        return blocks.mapInArrow(each, ddl)

    def both(left, right):
        # a block has one row
        return run(left.to_pylist()[0], right.to_pylist())
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, ddl)


def _count_words(blocks: DataFrame, buckets: int, cutoff: int) -> DataFrame:
    """Order 1: ask for the words of every block and answer id and count."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                held, words = np.array(row["held"], bool), get_words(row["words"])
                train = np.repeat(~held, get(row["sizes"]))
                seen = np.bincount(get(row["tokens"])[train], minlength=len(words))
                part = _word_parts(words, buckets)
                order = np.argsort(part, kind="stable")
                which, cut = np.unique(part[order], return_index=True)
                # documents and tokens of the training rows, for the sums
                rows = [{"part": -1, "block": row["block"], "a": b"", "b": put(np.array([int((~held).sum()), int(train.sum())]))}]
                rows += [{"part": p, "block": row["block"], "a": put_words([words[i] for i in o]), "b": put(seen[o])}
                         for p, o in zip(which.tolist(), np.split(order, cut[1:]))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    def answer(key, g):
        part, rows = key[0].as_py(), g.to_pylist()
        if part < 0:
            return _answers([("sum", None, r["block"], None, None, None, None, get(r["b"]).tolist()) for r in rows])
        words = [get_words(r["a"]) for r in rows]
        sizes = [len(w) for w in words]
        code, distinct = pd.factorize(np.array([*(x for w in words for x in w), None], object)[:-1])
        count = np.bincount(code, np.concatenate([get(r["b"]) for r in rows]), len(distinct)).astype(np.int64)
        ident = np.zeros(len(count), np.int64)
        known = np.argsort(-count, kind="stable")[:int((count > 0).sum())]              # ids rise as counts fall, so small ones are frequent
        ident[known] = 2 + np.arange(len(known)) * buckets + part
        out = [("reply", r["block"], 1 << 40 | part, put(ident[c]), put(count[c])) for r, c in zip(rows, np.split(code, np.cumsum(sizes)[:-1]))]
        known = known[np.argsort(distinct[known], kind="stable")]
        out.append(("model", None, 1 << 40 | part, put_words(distinct[known]), put(ident[known]), put(count[known])))
        out.append(("stat", None, 1 << 40 | part, None, None, None, None, [len(known), *_by_count(count, cutoff)]))
        return _answers(out)

    asked = blocks.mapInArrow(ask, "part long, block long, a binary, b binary")
    # the sums are one row a block: spread them, the words go by bucket
    spread = F.when(F.col("part") < 0, -1 - F.pmod(F.col("block"), F.lit(buckets))).otherwise(F.col("part"))
    return persist(asked.withColumn("part", spread).groupBy("part").applyInArrow(answer, ANSWER), "katz-1", ["kind"])


def _numbered(raw: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """The blocks with the ids and counts of their words instead of the words,
    their tokens as ranks by id."""
    def run(left, right):
        row = left.to_pylist()[0]
        part = _word_parts(get_words(row["words"]), buckets)
        ident, count = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for r in right.to_pylist():
            o = np.flatnonzero(part == r["part"] & (1 << 40) - 1)
            ident[o], count[o] = get(r["a"]), get(r["b"])
        order = np.argsort(ident, kind="stable")
        row |= {"tokens": put(np.argsort(order)[get(row["tokens"])]), "ids": put_rising(ident[order]), "counts": put(count[order])}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                        *[(c, pa.binary()) for c in ("sizes", "tokens", "ids", "counts")]])
    return raw.drop("n").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(
        run, "block long, doc_id array<long>, held array<boolean>, sizes binary, tokens binary, ids binary, counts binary")


def _count_grams(blocks: DataFrame, answers: DataFrame | None, plan: dict, order: int) -> DataFrame:
    """Order 2 and up: ask for the distinct n-grams of every block, of a share of the buckets a round."""
    rounds = 1 if answers is None else min(plan["rounds"], plan["buckets"])
    buckets, cutoff, hot, last, stats = plan["buckets"], plan["stats"].cutoff, plan["hot"], plan["order"], plan["stats"]

    def ask(row, answered, turn):
        block = _block_of(row, answered, plan, order - 1)
        part, split = block.next_order(plan["stats"], hot, buckets)
        ctx, word, seen, lower, total = block.request()
        starts = np.flatnonzero(_steps(part))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            if part[a] % rounds != turn:
                continue
            o = slice(a, b)
            new = _steps(ctx[o])
            head = np.flatnonzero(new)
            rows.append({"part": int(part[a]), "block": row["block"], "ctx": put_rising(ctx[o][head]), "run": put(np.diff(np.append(head, b - a))),
                         "word": put_rising(word[o], new), "seen": put(seen[o]), "lower": put(lower[o]), "total": put(total[o][head]),
                         "split": put(split[o][head])})
        return pa.Table.from_pylist(rows, schema)

    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("ctx", "run", "word", "seen", "lower", "total", "split")]])

    def answer(key, g):
        part, rows = key[0].as_py(), g.to_pylist()
        heads = [(get_rising(r["ctx"]), get(r["run"]), get(r["split"])) for r in rows]
        sizes = np.array([int(n.sum()) for _, n, _ in heads])
        ctxs, c, _, _ = _distinct(np.concatenate([h for h, _, _ in heads]))
        at = np.split(c, np.cumsum([len(h) for h, _, _ in heads])[:-1])                 # of each block's histories
        pair = np.empty(int(sizes.sum()), np.uint64)
        for r, (_, n, _), c, end in zip(rows, heads, at, np.cumsum(sizes)):
            new = np.zeros(int(n.sum()), bool)
            new[np.cumsum(n) - n] = True
            pair[end - len(new):end] = np.repeat(c.astype(np.uint64) << _U32, n) | get_rising(r["word"], new).astype(np.uint64)
        distinct, code, by_pair, new = _distinct(pair)
        count = np.add.reduceat(np.concatenate([get(r["seen"]) for r in rows])[by_pair], new)
        # p of the n-gram without its first word, from its count
        least = np.maximum.reduceat(np.concatenate([get(r["lower"]) for r in rows])[by_pair], new)
        of, word = (distinct >> _U32).astype(np.int64), (distinct & np.uint64((1 << 32) - 1)).astype(np.int64)
        few = (count > 0) & (count <= cutoff)
        sums = np.bincount(of[few] * cutoff + count[few] - 1, minlength=len(ctxs) * cutoff).reshape(-1, cutoff)
        total = np.ones(len(ctxs), np.int64)
        for r, c in zip(rows, at):
            total[c] = get(r["total"])
        known = np.flatnonzero(count > 0)
        p = stats.factor(order - 1, least[known]) * least[known] / total[of[known]]
        mass = np.bincount(of[known], p, len(ctxs))
        ident = np.where(count > 0, 2 + (np.cumsum(count > 0) - 1) * buckets + part, UNKNOWN)
        out = []
        split = np.zeros(len(ctxs), bool)
        for r, code_r, (_, n_r, s_r), c in zip(rows, np.split(code, np.cumsum(sizes)[:-1]), heads, at):
            split[c[s_r > 0]] = True
            here = count[code_r]
            need = np.minimum.reduceat(here, np.cumsum(n_r) - n_r) == 0              # a follower that has no count
            out.append(("reply", r["block"], order << 40 | part, put(here), *put_history(sums[c], mass[c], need),
                        put_known(ident[code_r], here) if order < last else None))
        out.append(("model", None, order << 40 | part, put_rising(ctxs[of[known]]), put(word[known]), put(count[known]),
                    put_rising(ident[known]) if order < last else None))
        out.append(("stat", None, order << 40 | part, None, None, None, None, [len(known), *_by_count(count, cutoff)]))
        if split.any():
            out.append(("hot", None, order << 40 | part, put(ctxs[split]), put(sums[split].ravel()), put(mass[split])))
        return _answers(out)

    ddl = "part long, block long, ctx binary, run binary, word binary, seen binary, lower binary, total binary, split binary"
    def one(turn):
        asked = _with_answers(blocks.drop("doc_id"), answers, lambda row, answered: ask(row, answered, turn), ddl)
        return persist(asked.groupBy("part").applyInArrow(answer, ANSWER), f"katz-{order}", ["kind"])

    out = one(0)
    for turn in range(1, rounds):
        free_shuffles(blocks.sparkSession)
        out = out.unionByName(one(turn))
    return out


def _hot_answers(found: DataFrame, below: DataFrame | None, blocks: DataFrame, plan: dict, order: int) -> DataFrame:
    """The sums of the split histories, added up over their buckets, as one
    answer row for every block that holds such a history."""
    cutoff, hot = plan["stats"].cutoff, plan["hot"]

    def spread(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(get(r["a"])), pa.array(get(r["b"]).reshape(-1, cutoff).tolist(), pa.list_(pa.int64())), pa.array(get(r["c"]))], ["ctx", "sums", "low"])

    def wanted(batches):
        for b in batches:
            for r in b.to_pylist():
                count = get(r["a"])
                ident = get_rising(r["d"]) if order == 2 else get_known(r["d"], count)
                own = np.unique(ident[count >= hot])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["block"], np.int64)), pa.array(own)], ["block", "ctx"])

    def join(key, g):
        return _answers([("hot", key[0].as_py(), order << 40, put(g.column("ctx").to_numpy()),
                          put(np.array(g.column("sums").to_pylist()).ravel()), put(g.column("low").to_numpy()))])

    sums = found.filter("kind = 'hot'").select("a", "b", "c").mapInArrow(spread, "ctx long, sums array<long>, low double").groupBy("ctx").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(cutoff)]).alias("sums"), F.sum("low").alias("low"))
    named = blocks.select("block", F.col("counts").alias("a"), F.col("ids").alias("d")) if order == 2 else below.filter("kind = 'reply'").select("block", "a", "d")
    want = named.mapInArrow(wanted, "block long, ctx long")
    if order == 2 and plan["stats"].documents >= hot:
        want = want.unionByName(blocks.select("block", F.lit(START).cast("long").alias("ctx")))
    return want.distinct().join(sums, "ctx").groupBy("block").applyInArrow(join, ANSWER)


class Model:
    """The answers and model tables of all orders, and the corpus sums."""

    def __init__(self, blocks, answers, tables, plan):
        self.blocks, self.answers, self.tables, self.plan = blocks, answers, tables, plan

    def ngrams(self, order: int) -> DataFrame:
        """The model table of an order as rows: (id, word, count) for order 1,
        (id, history, word_id, count) above, ids pointing one order down (the
        highest order needs none)."""
        def words(batches):
            for b in batches:
                for r in b.to_pylist():
                    ident = get(r["b"])
                    if len(ident):
                        yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array([w.decode() for w in get_words(r["a"])]), pa.array(get(r["c"]))], ["id", "word", "n"])

        def grams(batches):
            for b in batches:
                for r in b.to_pylist():
                    n = get(r["c"])
                    ident = pa.nulls(len(n), pa.int64()) if r["d"] is None else pa.array(get_rising(r["d"]))
                    yield pa.RecordBatch.from_arrays([ident, pa.array(get_rising(r["a"])), pa.array(get(r["b"])), pa.array(n)], ["id", "history", "word_id", "n"])
        m = self.tables[order - 1].filter("kind = 'model'").select("a", "b", "c", "d")
        return m.mapInArrow(words, "id long, word string, n long") if order == 1 else m.mapInArrow(grams, "id long, history long, word_id long, n long")


def train(docs: DataFrame, order: int = 2, folds: int = 7, held: int = 2, cutoff: int = 5, block_tokens: int = 1_250_000,
          bucket_tokens: int = 3_000_000, hot_tokens: int = 200_000, rounds: int = 2) -> Model:
    """Count and normalise the model of ``docs`` less the held-out fold."""
    raw = persist(make_blocks(docs, folds, held, block_tokens), "katz-raw")
    total = raw.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // bucket_tokens))
    tables = [_count_words(raw, buckets, cutoff)]
    blocks = persist(_numbered(raw, tables[0].filter("kind = 'reply'").select("block", "part", "a", "b"), buckets), "katz-blocks")
    # the blocks hold all that is needed of these
    discard(raw)
    discard(tables[0], "kind=reply")
    free_shuffles(docs.sparkSession)

    def summed(t, kind, n):
        r = t.filter(F.col("kind") == kind).agg(*[F.sum(F.col("stat")[i]) for i in range(n)]).first()
        return [x or 0 for x in r]
    documents, tokens = summed(tables[0], "sum", 2)
    words, *n_r = summed(tables[0], "stat", cutoff + 2)
    d = discounts(n_r, cutoff)
    stats = Stats(tokens, documents, words, cutoff, [d])
    stats.lost = sum((r + 1) * n_r[r] * (1 - d[r]) for r in range(cutoff)) / max(1, tokens) if tokens else 1.0
    plan = {"stats": stats, "buckets": buckets, "hot": hot_tokens, "order": order, "rounds": rounds}
    cols = ["kind", "block", "part", "a", "b", "c", "d"]
    answers = None
    for k in range(2, order + 1):
        t = _count_grams(blocks, answers, plan, k)
        stats.factors.append(discounts(summed(t, "stat", cutoff + 2)[1:], cutoff))
        new = t.filter("kind = 'reply'").select(*cols).unionByName(_hot_answers(t, tables[-1], blocks, plan, k).select(*cols))
        answers = new if answers is None else answers.unionByName(new)
        tables.append(t)
        free_shuffles(docs.sparkSession)
    return Model(blocks, answers, tables, plan)


def score(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    (log10) of every row of ``docs`` under the model of its training rows."""
    m = train(docs, **how)
    plan, stats = m.plan, m.plan["stats"]

    def run(row, answers):
        block = _block_of(row, answers, plan, plan["order"])
        first = block.ends - block.sizes
        c = block.word_count[block.token]
        add = lambda x: np.add.reduceat(x, first)
        return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(block.held), pa.array(block.sizes), pa.array(add((c > 0).astype(np.int64))),
                         pa.array(np.full(len(first), stats.tokens)), pa.array(add(np.log10((c + 1) / (stats.tokens + stats.words + 1)))),
                         pa.array(add(np.log10(block.p)))], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return _with_answers(
        m.blocks, m.answers, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
