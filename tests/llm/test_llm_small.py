"""Every operator on the awkward documents and on empty tables, against
brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from bruteforce_katz import Katz, tokens
from bruteforce_simhash import components, groups
from fixtures import EDGE, LONG, empty, frame
from pyspark.sql import functions as F

from sensorspark.llm import common, decontaminate, katz, knn_quality, licenses, packing, pii_crf, simhash, suffix_dedup, syncmers


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """The awkward documents as a stored table."""
    path = str(tmp_path_factory.mktemp("edge") / "documents")
    frame(spark, EDGE).write.parquet(path)
    return spark.read.parquet(path)


def fold(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


# ------------------------------------------------------------------ 1
@pytest.mark.parametrize("order,hot", [(2, 200_000), (2, 20), (3, 20)])
def test_katz_matches_dictionary_model(spark, edge, order, hot):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(
        edge, order=order, block_tokens=500, bucket_tokens=4000, hot_tokens=hot).collect()), key=str)
    m = Katz([t for i, t in EDGE if fold(i, 7) != 2], order)
    v = len(m.counts[1])
    want = []
    for i, t in EDGE:
        w = tokens(t)
        base = sum(math.log10((m.counts[1].get((x,), 0) + 1) / (m.n + v + 1)) for x in w)
        want.append((i, len(w), sum((x,) in m.counts[1] for x in w), m.n, fold(i, 7) == 2, round(base, 6), round(m.score(t), 6)))
    assert got == sorted(want, key=str)


def test_katz_distributions_sum_to_one(spark):
    m = Katz(["a b a c", "b a a d e", "a b"], 3)
    words = [g[0] for g in m.counts[1]]
    for h in [("a",), ("b", "a"), ("<s>",), ("zzz",), ("<s>", "a")]:
        assert sum(m.p(w, h) for w in [*words, "never-seen"]) == pytest.approx(1.0)


def test_katz_model_table(spark, edge):
    m = katz.train(edge, block_tokens=500, bucket_tokens=4000)
    one = {r.word: r.n for r in m.ngrams(1).collect()}
    ids = {r.id: r.word for r in m.ngrams(1).collect()} | {katz.START: "<s>"}
    two = {(ids[r.history], ids[r.word_id]): r.n for r in m.ngrams(2).collect()}
    want = Katz([t for i, t in EDGE if fold(i, 7) != 2], 2)
    end = lambda x: "" if x == "</s>" else x
    assert one == {end(g[0]): c for g, c in want.counts[1].items()}
    assert two == {(end(a), end(b)): c for (a, b), c in want.counts[2].items()}


def test_katz_keeps_no_words_beside_their_ids(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "checkpoint_dir", lambda _: str(tmp_path))
    m = katz.train(edge, order=3, block_tokens=500, bucket_tokens=4000)
    assert {"words", "n"}.isdisjoint(m.blocks.columns)
    kinds = {tuple(sorted(k.name for k in t.iterdir() if k.name.startswith("kind="))) for t in (tmp_path / "llm").glob("katz-1-*")}
    assert kinds == {("kind=model", "kind=stat", "kind=sum")} and not list((tmp_path / "llm").glob("katz-raw-*"))
    # each id is the word's and small ids are the frequent words'
    words = {r.word: (r.id, r.n) for r in m.ngrams(1).collect()}
    for part in range(m.plan["buckets"]):
        own = sorted(v for v in words.values() if (v[0] - 2) % m.plan["buckets"] == part)
        assert [n for _, n in own] == sorted((n for _, n in own), reverse=True)


def test_katz_asks_each_bucket_in_one_round(spark, edge):
    def told(rounds):
        m = katz.train(edge, order=3, block_tokens=500, bucket_tokens=300, hot_tokens=20, rounds=rounds)
        assert m.plan["buckets"] > 2
        return sorted((r.block, r.part, r.a) for r in m.tables[2].filter("kind = 'reply'").collect()), sorted(
            (r.history, r.word_id, r.n) for r in m.ngrams(3).collect())
    one, three = told(1), told(3)
    assert one == three and len({r[:2] for r in one[0]}) == len(one[0])


def test_katz_blocks_hold_every_document_once(spark):
    texts = ["", None, " \t ", "A b\x0bC", "\n" + "x y z " * 40, *[f"w{i} w{i % 7}\x1f  e" for i in range(300)]]
    docs = frame(spark, list(enumerate(texts)), 3)
    for size in (1, 7, 150, 10_000):
        got = {}
        for r in katz.make_blocks(docs, 7, 2, size).collect():
            words, sizes = katz.get_words(r.words), katz.get(r.sizes)
            tokens = [words[i] for i in katz.get(r.tokens)]
            assert len(set(words)) == len(words) and r.n == len(tokens) == sizes.sum() and r.n - sizes[-1] < size
            for i, part in zip(r.doc_id, np.split(np.array([*tokens, None], object)[:-1], np.cumsum(sizes)[:-1])):
                assert i not in got
                got[i] = part.tolist()
        assert got == {i: katz.tokens_of(t and t.encode()) for i, t in enumerate(texts)}


def test_katz_empty_and_untrained(spark):
    assert katz.score(empty(spark)).count() == 0
    held = next(i for i in range(100) if fold(i, 7) == 2)
    r = katz.score(frame(spark, [(held, "a b")], 1)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


# ------------------------------------------------------------------ 2
def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(text):
    from xxhash import xxh64_intdigest
    return _signed(xxh64_intdigest(text.encode(), 42))


def _chain_hash(v):
    import struct

    from xxhash import xxh64_intdigest
    h = 42
    for x in v:
        h = xxh64_intdigest(struct.pack("<q", x), h)
    return _signed(h)


def syncmers_of(h, k, s):
    if len(h) < k:
        return [(0, _chain_hash(h))] if h else []
    m, w = [_chain_hash(h[i:i + s]) for i in range(len(h) - s + 1)], k - s + 1
    return [(i, _chain_hash(h[i:i + k])) for i in range(len(h) - k + 1) if min(m[i:i + w]) in (m[i], m[i + w - 1])]


def word_tokens(text):
    return [t for w in re.findall(r"[^\x20\x09-\x0d]+", text) for t in (w if len(w) > 24 else [w])]


def syncmer_brute(text, k=7, s=2):
    """The levels of a text's fingerprint: (position, hash)."""
    chars = [_hash(c) for c in text]
    start = [_hash(""), *chars]
    return (syncmers_of([_hash(w) for w in word_tokens(text)], k, s), syncmers_of(chars, 5, 2) if len(text) < 1024 else None,
            [(i, _chain_hash(start[i:i + 2])) for i in range(len(chars))] if len(text) < 48 else None)


def likeness_brute(a, b, look=64):
    level = next(i for i in (2, 1, 0) if a[i] is not None and b[i] is not None)
    a, b = a[level], b[level]
    ha, hb = Counter(h for _, h in a), Counter(h for _, h in b)
    if not ha or not hb:
        return float(not ha and not hb)
    once = {h for h in ha if ha[h] == 1 and hb.get(h) == 1}
    at = {h: p for p, h in b}
    pairs = [(p, at[h]) for p, h in a if h in once]
    runs = []
    for x, y in pairs:
        if runs and runs[-1][3] == x - y:
            runs[-1][1], runs[-1][2] = y, runs[-1][2] + 1
        else:
            runs.append([y, y, 1, x - y])
    best = []
    for i, (first, _, n, _) in enumerate(runs):
        best.append(n + max((best[j] for j in range(max(0, i - look), i) if runs[j][1] < first), default=0))
    return (max(best, default=0) + len(set(ha) & set(hb)) - len(once)) / len(set(ha) | set(hb))


MORE_TEXTS = ["字" * 5 + "漢字仮名交じり文の長い一続きの行です" * 4, "ab" * 40, "line again\n" * 30, "x", "xy", "the cat sat on the mat", "w " * 700 + "end", "q" * 1100,
              " ".join(f"u{i}" for i in range(300)), " ".join(f"u{i}" for i in [*range(200, 300), *range(0, 200)]), "a" * 24 + " " + "b" * 25]


@pytest.mark.parametrize("cell_rows", [512, 2])
def test_syncmers_match_brute_force(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(syncmers.with_next, "__defaults__", (cell_rows,))
    rows = list(EDGE) + [(20 + i, t) for i, t in enumerate(MORE_TEXTS)] + [(None, f"n {i}") for i in range(9)] + [(20, f"again {i}") for i in range(9)]
    docs = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, _hash(x[1]), x[1]))
    show = lambda f: " | ".join(" ".join("%x:%d" % (h & 0xFFFFFFFF, p) for p, h in a) for a in f if a is not None)
    want = []
    for n, (i, t) in enumerate(docs):
        nxt = docs[(n + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = map(syncmer_brute, (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), round(likeness_brute(a, b), 9), round(likeness_brute(a, c), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
           for r in syncmers.compare_neighbours(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def like(spark, *pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    r = df.select("i", syncmers.likeness(syncmers.fingerprint(F.col("a")), syncmers.fingerprint(F.col("b"))).alias("x")).collect()
    return [x for _, x in sorted((r.i, r.x) for r in r)]


def test_likeness_goes_by_position(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(400)]
    text = " ".join(words)
    blocks = [words[i:i + 20] for i in range(0, 400, 20)]
    backward = " ".join(w for b in blocks[::-1] for w in b)
    han = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 900))
    half = " ".join(words[:150] + ["new"] * 8 + words[150:])
    moved = " ".join(words[300:] + words[:300])
    x = like(spark, (text, text), (text, backward), (text[:900], text[:450] + "#" + text[451:900]), (han, han[:450] + "#" + han[451:]), (text, half), (text, moved), ("", ""), ("", "a"), (text, "zz"))
    assert x[0] == 1.0 and x[1] < 0.2 and x[2] >= 0.8 and x[3] >= 0.8 and x[4] > 0.85 and 0.5 < x[5] < 0.85 and x[6:] == [1.0, 0.0, 0.0]


def test_half_edited_texts_are_never_unlike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = syncmers.compare_neighbours(docs).collect()
    assert len(rows) == len(text) and all(r.near_edited > 0 for r in rows)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next)) and np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.2


def test_hot_ids_fall_into_many_cells(spark):
    rows = [(7, f"t{i}") for i in range(400)] + [(None, f"n{i}") for i in range(300)] + [(i, f"x{i}") for i in range(300)]
    cells = syncmers._cells(frame(spark, rows).select("doc_id", "text"), 10).groupBy("coarse", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()
    assert max(r.n for r in cells) < 60
    order = [(r.a is not None, r.a or 0) for r in sorted(cells, key=lambda r: (r.coarse, r.cell))]
    assert order == sorted(order)


def test_syncmers_empty_and_context_free(spark):
    assert syncmers.compare_neighbours(empty(spark)).count() == 0
    passage = " ".join(f"p{i * i % 101}" for i in range(60))
    of = lambda t: {h for _, h in syncmer_brute(t)[0]}
    inner = of(passage)
    assert inner <= of("x y z " + passage) and inner <= of(passage + " q r s") and len(inner) > 5


# ------------------------------------------------------------------ 4
def test_knn_scores_match_brute_force(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0, "a"), (2, 0, 0, "a"), (6, 1, None, "a"), (8, 1, 0, "a"), (9, 0, 1, "a"), (3, None, 0, "a"), (None, 1, 0, "a")],
                                   "doc_id long, quality int, toxic int, text string")
    got = sorted(((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in knn_quality.score(edge, labels, dims=4, neighbours=3).collect()), key=str)
    x, y = knn_quality.training_rows(edge, labels, 5, 0, 4096)
    df, n = knn_quality.document_frequency(edge)
    texts = [(t or "").encode() for _, t in EDGE]
    assert n == len(EDGE) and (df == (knn_quality.features(texts) > 0).sum(0)).all()
    lab = {1: 1, 2: 0, 6: 1, 8: 1, 9: 0}
    assert sorted(y.tolist()) == sorted(lab[i] for i in {i for i, _ in EDGE} if i in lab and fold(i, 5) != 0)
    m = knn_quality.Model(x, y, df, n, dims=4, neighbours=3)
    want = []
    for (i, _), t in zip(EDGE, texts):
        v = (knn_quality.features([t]) * m.idf) @ m.axes
        v = (v / max(np.linalg.norm(v), 1e-12))[0]
        near = sorted(((float(v @ u), w, q) for u, w, q in zip(m.vectors, m.weight, m.labels)), reverse=True)
        near = [x for x in near if x[0] >= near[2][0] - 1e-5]            # ties with the third vote
        s = [max(c, 0) ** 4 * w for c, w, _ in near]
        score = sum(a * q for a, (_, _, q) in zip(s, near)) / sum(s) if sum(s) > 0 else m.prior
        want.append((i, fold(i, 5) == 0, round(score, 6), int(score >= 0.3)))
    want.sort(key=str)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want))
    kept = knn_quality.keep_good(edge, labels, dims=4, neighbours=3)
    assert kept.columns == edge.columns and kept.count() == sum(w[3] for w in want)


def test_knn_without_labels_and_rows(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in knn_quality.score(edge, none).collect()} == {0.5}
    assert knn_quality.score(empty(spark), none).count() == 0


def test_knn_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = knn_quality.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in r]) > 0.95
    assert np.mean([x.predicted for x in r if x.quality == 1]) > 0.97


# ------------------------------------------------------------------ 5
def repeats_brute(texts, w):
    c = Counter(t[i:i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        cov = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if c[t[i:i + w]] > 1:
                cov[i:i + w] = b"\1" * w
        kept = bytes(b for b, x in zip(t, cov) if not x)
        out.append((len(t), sum(cov), sum(cov[i] and not (i and cov[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,hot", [(400, 1000), (60, 1000), (60, 1), (50, 2)])
def test_suffix_dedup_matches_brute_force(spark, tmp_path, window, hot):
    rng = np.random.default_rng(window + hot)
    word = lambda n: " ".join("w%d" % x for x in rng.integers(0, 400, n))
    passage, line = word(120), word(20)
    rows = list(EDGE) + [(20 + i, word(int(rng.integers(0, 60))) + " " + (passage[int(rng.integers(0, 200)):] if i % 2 else line) + " " + word(20)) for i in range(30)]
    rows += [(100, "ab" * 400), (101, "xab" * 250), (102, word(30) + "é" * 300)]
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(
        spark.read.parquet(str(tmp_path / "d")), window, hot_segments=hot, bundle_windows=5000).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, repeats_brute([(t or "").encode() for _, t in rows], window))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_dedup_counts_crowded_passages(spark, tmp_path, monkeypatch):
    """A passage that many documents hold in other contexts never meets in one bundle."""
    rng = np.random.default_rng(17)
    word = lambda n: " ".join("w%d" % x for x in rng.integers(0, 4000, n))
    passage = word(50)
    rows = [(i, f"{word(12)} {passage} {word(12)}") for i in range(60)] + [(100 + i, word(30)) for i in range(5)]
    frame(spark, rows).write.parquet(str(tmp_path / "d"))
    most, compare = [], suffix_dedup._compare

    def watched(pieces, *how):
        n = pieces.filter("text IS NOT NULL AND sub <> 0").groupBy("key", "sub").agg(F.count_distinct("piece").alias("n")).agg(F.max("n")).first()[0]
        most.append(n or 0)
        return compare(pieces, *how)

    monkeypatch.setattr(suffix_dedup, "_compare", watched)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(
        spark.read.parquet(str(tmp_path / "d")), 150, hot_segments=10, bundle_windows=5000).collect()]
    want = [(i, *x) for (i, _), x in zip(rows, repeats_brute([t.encode() for _, t in rows], 150))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(most) <= 10


def test_suffix_dedup_slices_of_long_texts(spark):
    t = np.frombuffer(LONG.encode(), np.uint8)
    whole = suffix_dedup.segments(t, np.array([0, len(t)]), 100, 16)
    groups = list(suffix_dedup._groups([LONG.encode()], 5000, 100))
    covered = sum(len(p) - 99 for g in groups for _, _, p in g)
    assert covered == len(t) - 99 == whole[1].sum() and len(groups) > 5


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


# ------------------------------------------------------------------ 6
def edit_brute(item, text):
    """Least edit distance of the item to any substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_matches_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(200):
        p = "".join(rng.choice(list("abc"), int(rng.integers(1, 90))))
        t = "".join(rng.choice(list("abc"), int(rng.integers(0, 120))))
        d, _ = decontaminate.myers(decontaminate.masks(p), len(p), t, len(p))
        assert d == edit_brute(p, t)


def test_decontamination_matches_brute_force(spark, edge):
    items = [(1, "the quick brown fox jumps over the lazy dog"), (2, "the quack brown fox jumped over the lazy dog near the river"), (3, None), (4, ""),
             (5, "!!! ???"), (6, "nothing like this occurs in any of the documents at all"), (7, "word5 tail5 word6 tail6 word7 tail7 word8 tail8"),
             (None, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (8, "one"), (9, "ver"), (10, "a"), (11, "NO id")]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, doc_id double")
    for blocks in (4_000_000, 40):
        got = sorted(((r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(edge, bench, block_chars=blocks).collect()), key=str)
        want, kept = [], []
        for i, t in EDGE:
            before = len(want)
            for k, x in items:
                x = decontaminate.normalised(x)
                if x:
                    t_ = decontaminate.normalised(t)[:2000]
                    e = decontaminate.budget(len(x), 0.07)
                    d = edit_brute(x, t_) if e else int(f" {x} " not in f" {t_} ")
                    if d <= e:
                        want.append((i, k, d))
            kept += [i] * (len(want) == before)
        assert got == sorted(want, key=str)
    clean = decontaminate.remove_contaminated(edge, bench, block_chars=40)
    assert clean.columns == edge.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(kept, key=str)


def test_decontamination_empty(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "some text to look for in here")], "item_id long, text string")
    assert decontaminate.matches(edge, none).count() == 0
    assert decontaminate.matches(empty(spark), some).count() == 0
    assert decontaminate.remove_contaminated(edge, none).count() == len(EDGE)


# ------------------------------------------------------------------ 7
def near_rows():
    rng = np.random.default_rng(3)
    rows = list(EDGE)
    for g in range(6):
        base = [f"t{x}" for x in rng.integers(0, 900, 150)]
        for c in range(7):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 99)}"
            rows.append((1000 + g * 10 + c, " ".join(w)))
    return rows


@pytest.mark.parametrize("limit", [4096, 1])
def test_simhash_components_match_brute_force(spark, limit, monkeypatch):
    rows = near_rows()
    if limit == 1:
        monkeypatch.setattr(simhash.links, "__defaults__", (3, 1, 300_000))
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    fps, comp = components([i for i, _ in rows], [t for _, t in rows])
    want = sorted(((i, f, c) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 10


@pytest.mark.parametrize("limit", [2, 20])
def test_hot_buckets_are_split_until_they_fit(spark, limit):
    """Fingerprints that agree on most bits: the splits lose no link."""
    rng = np.random.default_rng(12)
    fps = sorted({int(x) for x in rng.integers(0, 1 << 14, 260)} | {(1 << 40) + int(x) for x in rng.integers(0, 1 << 20, 60)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {tuple(r) for r in simhash.links(df, 3, limit, 300_000).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in found:
        assert bin(a ^ b).count("1") <= 3
        root[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 3:
                assert find(a) == find(b)


def test_covering_masks_lose_no_pair():
    import itertools
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for bits in itertools.combinations(range(64), 2):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    masks, rng = simhash.covering_masks(3), np.random.default_rng(0)
    for _ in range(3000):
        bits = rng.choice(64, 3, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in masks)


def test_simhash_keeps_one_of_each_component(spark):
    rows = near_rows()
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    of = {}
    for g, (i, t) in zip(groups([t for _, t in rows]), rows):
        of.setdefault(g, []).append((i is None, i or 0, t is None, hashlib.sha256((t or "").encode()).hexdigest(), i, t))
    want = [min(own, key=lambda r: r[:4])[4:] for own in of.values()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_keeps_one_row_where_ids_repeat_or_lack(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog", "seven wise owls read old books by candle light", "rain fell on the harbour all through that night")
    for rows, want in [([(2, a), (5, a), (5, b)], [(2, a), (5, b)]), ([(None, a), (3, a), (None, b), (None, b), (None, c), (7, None), (None, "")], [(3, a), (7, None), (None, b), (None, c)]),
                       ([(5, a), (5, a), (5, b), (5, b)], [(5, a), (5, b)])]:
        assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ 8
def base_brute(text):
    def luhn(d):
        s = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
          (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
          (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
          (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return [[m.span() for m in re.finditer(p, text) if f(m.group())] for p, f in ok]


def test_pii_base_spans_match_the_patterns():
    rng = np.random.default_rng(2)
    pieces = ["a@b.c", "x.y+z@mail-1.example.com", "@", "..", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "999.1.1.1",
              "192.168.0.1", "0001.2.3.4", "_", "%", "é", " ", "12", ".", "-", "(", "5500000000000004", "a@b", "user@host.", "\n", "@x.y", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces, int(rng.integers(1, 9))))
        assert pii_crf.base_spans(t) == base_brute(t), t


def test_pii_rows_and_skip_chain(spark, edge):
    rows = list(EDGE) + [(50 + i, f"call me at +1 555 0{i}0 42{i}7 or mail a{i}@x.org from 10.0.0.{i} card 4111 1111 1111 1111 ok {i} times") for i in range(30)]
    got = {(r.doc_id, r.spans): r for r in pii_crf.pii_spans(frame(spark, rows)).collect()}
    assert sum(1 for _ in pii_crf.pii_spans(frame(spark, rows)).collect()) == len(rows)
    for i, t in rows:
        base = base_brute(t or "")
        r = next(r for (d, _), r in got.items() if d == i)
        if i is not None:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in base]
            assert r.base_sha256 == hashlib.sha256(pii_crf.joined(base).encode()).hexdigest()
            assert {f"{pii_crf.KINDS[k]}:{s}:{e}" for k, own in enumerate(base) for s, e in own} <= set(r.spans.split(",") if r.spans else [])
    assert pii_crf.pii_spans(empty(spark)).count() == 0


def exact_marginals(tokens, model):
    import itertools
    n, k = len(tokens.doc), pii_crf.OTHER + 1
    u = pii_crf._unary(tokens.features, model["index"], model["weights"])
    e, kind = tokens.edges()
    out = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        w = math.exp(sum(u[i, c] for i, c in enumerate(y)) + sum(model["pair"][t][y[a], y[b]] for (a, b), t in zip(e.tolist(), kind.tolist())))
        for i, c in enumerate(y):
            out[i, c] += w
    return out / out.sum(1, keepdims=True)


def test_message_passing_is_exact_on_a_tree_and_close_on_a_loop():
    train = pii_crf.Tokens()
    for i in range(40):
        t = f"ring +1 555 010 42{i:02d} now or 555 010 42{i:02d} later, order 77{i}"
        train.add(i, t, pii_crf.base_spans(t))
    model = pii_crf.fit(train, rounds=80)
    for text, tolerance in (("a 12 b 34567890 c 34567890", 1e-3), ("555 0100 42 and 555-010042 x 5550100 42", 0.1)):
        t = pii_crf.Tokens()
        t.add(0, text, pii_crf.base_spans(text))
        assert np.abs(pii_crf.marginals(t, model, rounds=200) - exact_marginals(t, model)).max() < tolerance


SPELLED = ["+1 415 555 0199", "(415) 555-0199", "415-555-0199", "415.555.0199", "14155550199", "415 555 0199"]


def added(text, model):
    base, every = pii_crf.find([text], model, 0.95)
    assert all(set(b) <= set(e) for b, e in zip(base[0], every[0]))
    return [sorted(text[s:e] for s, e in set(e) - set(b)) for b, e in zip(base[0], every[0])]


def test_one_matched_spelling_finds_the_others(spark):
    """Learned from the test table and from a corpus without personal data."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for model in (pii_crf.train(docs), pii_crf.train(frame(spark, [(i, f"item {i} of {i + 7}") for i in range(20)]))):
        for order in (SPELLED, SPELLED[::-1], SPELLED[3:] + SPELLED[:3]):
            text = "call " + " or try ".join(order) + " . order 77120 of 2024-01-05, rooms 10 and 12, ref 8812345 and 555 1234"
            assert added(text, model) == [[], [], [], sorted(SPELLED[1:])]
        assert added("call " + " or ".join(SPELLED[1:]), model) == [[], [], [], []]                 # no base span, nothing to tie to
        mail = "mail bob.smith@example.com, later Bob.Smith wrote; see example.com or amy@example.com; card 4111 1111 1111 1111 or 4111.1111.1111.1111"
        assert added(mail, model) == [["Bob.Smith"], [], ["4111.1111.1111.1111"], []]


def test_what_the_field_adds_to_the_test_table(spark):
    """Numbers in prose stay; what is added are card numbers next to each other,
    which the pattern joins and drops."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    base, extra = 0, []
    for r in pii_crf.pii_spans(docs).collect():
        own = {f"{pii_crf.KINDS[k]}:{s}:{e}" for k, o in enumerate(pii_crf.base_spans(text[r.doc_id] or "")) for s, e in o}
        base += len(own)
        extra += [(x.split(":")[0], text[r.doc_id][int(x.split(":")[1]):int(x.split(":")[2])]) for x in set(r.spans.split(",")) - own - {""}]
    assert base > 30 and extra and all(k == "card" and len(t) == 16 and pii_crf.luhn(t) for k, t in extra)


def test_candidates_lie_outside_base_spans():
    rng = np.random.default_rng(8)
    pieces = ["a.bee@cee.dee", "a.bee", "CEE.DEE", "+1 (555) 123-4567", "555 123.4567", "4111 1111 1111 1111", "1.2.3.4", " ", ", ", "x9", "12", "\n", "(", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "@q"]
    for _ in range(2000):
        t = " ".join(rng.choice(pieces, int(rng.integers(1, 9))))
        base = pii_crf.base_spans(t)
        c = pii_crf.candidates(t, base)
        taken = sorted((s, e) for own in base for s, e in own)
        assert c == sorted(c) and all(a[1] <= b[0] for a, b in zip(c, c[1:]))
        assert all(e <= a or s >= b for s, e in c for a, b in taken)
        inside = {i for s, e in [*c, *taken] for i in range(s, e)}
        assert all(i in inside for i, x in enumerate(t) if x.isdigit())


def test_pii_redaction(spark):
    text = "mail bob@example.com or 192.168.0.1 now"
    docs = frame(spark, [(1, text), (2, None), (3, "")])
    out = {r.doc_id: r for r in pii_crf.redact(docs).collect()}
    assert out[1].text == "mail <EMAIL> or <IP> now" and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "" and pii_crf.redact(docs).columns == docs.columns


# ------------------------------------------------------------------ 9
@pytest.mark.parametrize("shard_rows", [20_000, 5])
def test_packing_places_every_token_once(spark, edge, shard_rows):
    caps = (16, 64, 256)
    r = packing.best_fit(edge, caps, shard_rows=shard_rows).collect()
    want = Counter()
    for i, t in EDGE:
        n = len(tokens(t))
        for p in range((n - 1) // 256 + 1):
            want[i, p, min(256, n - p * 256)] += 1
    assert Counter((x.doc_id, x.piece, x.n_tokens) for x in r) == want
    bins = {}
    for x in r:
        bins.setdefault(x.bin_id, []).append(x)
    for own in bins.values():
        at = 0
        for x in sorted(own, key=lambda x: x.position):
            assert x.position == at
            at += x.n_tokens
        assert all(x.fill == at and x.capacity == min(c for c in caps if c >= at) for x in own)


def test_best_fit_against_quadratic_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = sorted((int(x) for x in rng.integers(1, 257, 80)), reverse=True)
        placed, sizes = packing.pack(lengths, (64, 128, 256))
        room, opened, left = [], [], sum(lengths)
        for n, (b, _) in zip(lengths, placed):
            fits = [x for x in room if x >= n]
            if fits:
                assert room[b] == min(fits)
                room[b] -= n
            else:
                size = min((c for c in (64, 128, 256) if c >= n), key=lambda c: (packing.bin_cost(c) / min(c, left), c))
                assert b == len(room)
                room.append(size - n)
                opened.append(size)
            left -= n
        assert sizes == [min(c for c in (64, 128, 256) if c >= o - f) for o, f in zip(opened, room)]


def test_packing_empty(spark):
    assert packing.best_fit(empty(spark)).count() == 0


# ------------------------------------------------------------------ 10
def test_licenses(spark, edge):
    rows = list(EDGE) + [(30, "Some prose here.\nReleased under the MIT License.\nMore prose of the day."), (31, "RELEASED UNDER THE MIT LICENSE!!"),
                         (32, "This work is licensed under the GNU General Public License, version 3."), (33, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
                         (34, "The license of the driver was released under the bridge.\nAll rights reserved."), (35, "Licensed under CC BY 4.0."),
                         (36, "This work is licensed under the terms of a private contract.")]
    docs = frame(spark, rows)
    model = licenses.train(docs)
    got = {}
    for r in licenses.scan(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    families = {i: r[0].families for i, r in got.items()}
    assert [families[i] for i in range(30, 37)] == ["MIT", "MIT", "GPL-3.0", "Apache-2.0,CC-BY-NC", "", "CC-BY", ""]
    assert not any(families[i] for i in families if i is None or i < 30)
    assert licenses.scan(empty(spark), model).count() == 0


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify and sell copies of the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "GPL-2.0": """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.""",
}


def test_wrapped_licenses(spark, edge):
    prose = "Some prose of the day, in a line of its own.\n"
    texts = [*WRAPPED.values(), *[f"A title\n\n{t}\n \nThe end." for t in WRAPPED.values()], *[prose * 20 + t + "\n" + prose * 20 for t in WRAPPED.values()],
             "\n\n".join(WRAPPED.values()), *[t.replace("\n", "\r\n") for t in WRAPPED.values()], "Permission is hereby\n\ngranted", prose * 40]
    docs = frame(spark, [(100 + i, t) for i, t in enumerate(texts)])
    model = licenses.train(edge)
    got = {r.doc_id - 100: (r.families, r.n_confirmed) for r in licenses.scan(docs, model).collect()}
    one = [(k, 1) for k in WRAPPED]
    assert [got[i] for i in range(len(texts))] == [*one * 3, (",".join(sorted(WRAPPED)), 3), *one, ("", 0), ("", 0)]
    at = {(r.doc_id - 100, r.paragraph, r.family) for r in licenses.scan_paragraphs(docs, model).filter("confirmed").collect()}
    assert {(3, 2, "MIT"), (4, 2, "BSD"), (5, 2, "GPL-2.0")} <= at


def test_license_sums_match_brute_force(spark):
    docs = frame(spark, [(1, "Released under the MIT License.\nplain text of no interest"), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under BSD")])
    model = licenses.train(docs)
    got = {(r.paragraph, r.family): r.probability for r in licenses.scan_paragraphs(docs.filter("doc_id = 1"), model).collect()}
    grams = spark.createDataFrame([("Released under the MIT License.",)], "p string").select(licenses.paragraph_grams(F.col("p")).alias("g")).first().g
    z = (np.array(model.intercepts) + sum(np.array(model.weights.get(g, np.zeros(len(model.classes)))) for g in grams)) / model.temperature
    assert got == {(0, model.classes[int(z.argmax())]): pytest.approx(1 / (1 + math.exp(z[0] - z.max())))}


HEADERS = {
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "GPL-2.0": """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "AGPL-3.0": """it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL-3.0": """it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MIT": "The MIT License (MIT)",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.""",
}
TAGGED = {"// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
          "/* SPDX-License-Identifier: LGPL-2.1-only */": "LGPL-2.1", "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "Licensed under MIT or Apache-2.0": "Apache-2.0,MIT",
          "SPDX-License-Identifier: BSD-3-Clause": "BSD"}
PLAIN = ["er kam mit der Familie", "the Free Software Foundation published a license", "Permission was granted to use the hall for any purpose",
         "the general public, version of events", "Ein Text mit Lizenz", "terms of the lesser known general"]


def test_headers_tags_and_choices(spark, edge):
    """Families that differ in a word or two, tags, two families in a line, and a
    notice over any number of lines."""
    one_word_a_line = "\n".join(HEADERS["GPL-2.0"].replace("*", "").split())
    texts = [*HEADERS.values(), *TAGGED, *PLAIN, one_word_a_line, "\n\n".join(HEADERS.values()), HEADERS["LGPL-2.1"] + "\n\n" + HEADERS["GPL-3.0"],
             "prose of the day\n" * 300 + HEADERS["LGPL-2.1"]]
    docs = frame(spark, [(100 + i, t) for i, t in enumerate(texts)])
    got = {r.doc_id - 100: r.families for r in licenses.scan(docs, licenses.train(edge)).collect()}
    want = [*HEADERS, *TAGGED.values(), *[""] * len(PLAIN), "GPL-2.0", ",".join(sorted(HEADERS)), "GPL-3.0,LGPL-2.1", "LGPL-2.1"]
    assert {texts[i]: got[i] for i in got} == dict(zip(texts, want))


def test_text_grams_cross_lines_inside_a_block(spark):
    text = "a b\nc -\n\n \t\nd e\r\n***\nf g h"
    docs = spark.createDataFrame([(text,), ("",), ("one",), ("\n\n",)], "t string")
    h = {}
    for w in (["a", "b"], ["b", "c"], ["a", "b", "c"], ["d", "e"], ["e", "f"], ["f", "g"], ["g", "h"], ["d", "e", "f"], ["e", "f", "g"], ["f", "g", "h"]):
        h[" ".join(w)] = spark.range(1).select(F.xxhash64(*[F.lit(x) for x in w])).first()[0]
    out = [sorted(map(tuple, r.g)) for r in docs.select(licenses.text_grams(F.col("t")).alias("g")).collect()]
    want = {"a b": (0, 0, 0), "b c": (0, 0, 1), "a b c": (0, 0, 1), "d e": (4, 4, 4), "e f": (4, 4, 6), "d e f": (4, 4, 6), "f g": (4, 6, 6), "g h": (4, 6, 6),
            "e f g": (4, 4, 6), "f g h": (4, 6, 6)}
    assert out == [sorted((*v, h[k]) for k, v in want.items()), [], [], []]


def test_words_are_ascii_lowered_and_split():
    text = "AÉB\tc\x0bD\x0cE\rF\ng h I \x1f\x85 j"
    want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))]
    assert simhash.words_of(text.encode()) == want and simhash.words_of(None) == []
    assert katz.tokens_of(text.encode()) == [*want, katz.END]
