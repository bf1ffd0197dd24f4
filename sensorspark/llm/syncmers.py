"""Document fingerprints from closed syncmers, matched by position.

Native: DataFrame expressions only.  A k-mer is k successive tokens; its inner
substrings are runs of s tokens, each hashed.  The k-mer is chosen when the
smallest inner hash is its first or its last (ties count), which depends on
the k tokens alone: the same passage yields the same anchors in every context,
and at least one in every k - s + 1 successive k-mers is chosen.  The chosen
k-mers' hashes in text order, with their positions, are the fingerprint.

Tokens are words (those of over ``LONG`` characters: their characters, so that texts
without blanks have tokens, too).  Texts below ``SHORT`` characters have a second
fingerprint over their characters, and those below ``TINY`` a third, the pairs of
successive characters from the text's start.  Two texts are compared by the finest that both have.

Likeness: the anchors that occur once in each text are matched, runs of them
with one shift are joined, and the heaviest chain of runs that ascends in both texts counts (a
run looks back over at most ``LOOK`` earlier ones).  Anchors that a text repeats count where
both texts hold them.  The share is of all different anchors of both texts.

Cases: NULL texts count as empty and have no anchors; texts of 1 to k - 1
tokens have one anchor, the hash of all; repeated rows are fingerprinted
each; two fingerprints without anchors are alike (1.0), one without is unlike
any other (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.llm.common import SPACE, let

K, S = 7, 2
#: Over characters.
CHAR_K, CHAR_S = 5, 2
LONG, SHORT, TINY = 24, 1024, 48
LOOK = 64
ANCHORS = "array<struct<position:int,hash:bigint>>"


def _chars(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def word_hashes(text: Column) -> Column:
    """The XXH64 of each token of a text."""
    whole = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    cut = F.flatten(F.transform(whole, lambda w: F.when(F.char_length(w) > LONG, _chars(w)).otherwise(F.array(w))))
    tokens = F.when(text.rlike("[^\\x20\\x09-\\x0D]{%d}" % (LONG + 1)), cut).otherwise(whole)
    return F.transform(tokens, lambda w: F.xxhash64(w))


def syncmers(token_hashes: Column, k: int, s: int) -> Column:
    """array<struct<position int, hash long>> of the closed syncmers of an array of token hashes."""
    inner = k - s + 1

    def chosen(h: Column, m: Column) -> Column:
        at = lambda i, j: F.get(m, i + j)
        edge = lambda i: F.least(at(i, 0), at(i, inner - 1))
        rest = lambda i: F.least(*[at(i, j) for j in range(1, inner - 1)]) if inner > 3 else at(i, 1)
        places = F.sequence(F.lit(0), F.size(h) - k)
        if inner > 2:
            places = F.filter(places, lambda i: edge(i) <= rest(i))
        return F.transform(places, lambda i: F.struct(
            i.alias("position"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))

    def of(h: Column) -> Column:
        mers = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash")))
        return F.when(F.size(h) >= k, let(mers, lambda m: chosen(h, m))).when(F.size(h) > 0, whole).otherwise(F.array().cast(ANCHORS))

    return let(token_hashes, of)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text over its words."""
    return syncmers(word_hashes(F.coalesce(text, F.lit(""))), k, s)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """struct(words, chars, pairs): the anchors over words and, for short and
    tiny texts, over characters and pairs of them; NULL where a text is longer."""
    t = F.coalesce(text, F.lit(""))
    hashed = F.transform(_chars(t), lambda c: F.xxhash64(c))
    from_start = F.concat(F.array(F.xxhash64(F.lit(""))), hashed)
    pairs = let(from_start, lambda h: F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - 2), lambda i: (i >= 0) & (i < F.size(h) - 1)), lambda i: F.struct(
        i.alias("position"), F.xxhash64(F.get(h, i), F.get(h, i + 1)).alias("hash"))))
    return F.struct(anchors(t, k, s).alias("words"), F.when(F.char_length(t) < SHORT, syncmers(hashed, CHAR_K, CHAR_S)).alias("chars"),
                    F.when(F.char_length(t) < TINY, pairs).alias("pairs"))


def matched(a: Column, b: Column) -> Column:
    """array<struct<a, b>>: the positions, ascending in a, of the anchors that
    occur once in each."""
    side = lambda x, i: F.transform(x, lambda v: F.struct(v["hash"].alias("h"), F.lit(i).alias("side"), v["position"].alias("p")))

    def of(e: Column) -> Column:
        def alone(i):
            h = F.get(e, i)["h"]
            return ((h == F.get(e, i + 1)["h"]) & (F.get(e, i)["side"] == 0) & (F.get(e, i + 1)["side"] == 1) &
                    F.coalesce(F.get(e, i - 1)["h"] != h, F.lit(True)) & F.coalesce(F.get(e, i + 2)["h"] != h, F.lit(True)))
        at = F.filter(F.sequence(F.lit(0), F.size(e) - 2), alone)
        return F.array_sort(F.transform(at, lambda i: F.struct(F.get(e, i)["p"].alias("a"), F.get(e, i + 1)["p"].alias("b"))))
    return let(F.array_sort(F.concat(side(a, 0), side(b, 1))), of)


def ascending(pairs: Column) -> Column:
    """How many of the ``matched`` pairs the heaviest ascending chain holds."""
    def of(p: Column) -> Column:
        shift = lambda i: F.get(p, i)["a"] - F.get(p, i)["b"]
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i).isNotNull() & F.coalesce(shift(i) != shift(i - 1), F.lit(True)))

        def runs(st: Column) -> Column:
            end = lambda r: F.coalesce(F.get(st, r + 1), F.size(p))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(st) - 1), lambda r: F.get(st, r).isNotNull()), lambda r: F.struct(
                F.get(p, F.get(st, r))["b"].alias("first"), F.get(p, end(r) - 1)["b"].alias("last"), (end(r) - F.get(st, r)).alias("weight")))

        def step(acc, run):
            reach = F.filter(acc["open"], lambda o: o["last"] < run["first"])
            best = run["weight"] + F.coalesce(F.array_max(F.transform(reach, lambda o: o["best"])), F.lit(0))
            return let(best, lambda v: F.struct(F.slice(F.concat(F.array(F.struct(run["last"].alias("last"), v.alias("best"))), acc["open"]), 1, LOOK).alias("open"),
                                                F.greatest(acc["top"], v).alias("top")))
        start = F.struct(F.array().cast("array<struct<last:int,best:int>>").alias("open"), F.lit(0).alias("top"))
        return F.aggregate(let(starts, runs), start, step)["top"]
    return let(pairs, of)


def hashes(a: Column) -> Column:
    return F.transform(a, lambda x: x["hash"])


def chained(a: Column, b: Column) -> Column:
    """Likeness of two arrays of anchors."""
    ha, hb = hashes(a), hashes(b)
    shared = F.size(F.array_intersect(ha, hb))
    share = let(matched(a, b), lambda p: (ascending(p) + shared - F.size(p)) / F.greatest(F.size(F.array_union(ha, hb)), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(shared == 0, F.lit(0.0)).otherwise(share)


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints by the finest level that both have."""
    both = lambda n: a[n].isNotNull() & b[n].isNotNull()
    return (F.when(both("pairs"), chained(a["pairs"], b["pairs"])).when(both("chars"), chained(a["chars"], b["chars"]))
            .otherwise(chained(a["words"], b["words"])))


def printed(f: Column) -> Column:
    """A fingerprint as text: the low 32 bits of each anchor in hexadecimal, a
    colon and its position, level by level."""
    show = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lower(F.hex(x["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(":"), x["position"])), " ")
    return F.concat_ws(" | ", show(f["words"]), show(f["chars"]), show(f["pairs"]))


def _cells(docs: DataFrame, cell_rows: int) -> DataFrame:
    """``docs`` with (coarse, cell, h): intervals of (doc_id, h) that ascend with
    it and hold about ``cell_rows`` rows; h is the hash of the text.  256
    quantiles give the coarse intervals, so clustered ids do no harm; each is cut
    evenly.  NULL ids come first.  They and an id that fills quantiles
    of its own are cut by h."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    r = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.percentile_approx("doc_id", [i / 256 for i in range(257)], 20_000)).first()
    found = r[2] or []
    bounds = sorted(set(found))
    share = (F.col("h").cast("double") / float(1 << 64)) + 0.5

    def by_hash(rows: int):
        n = max(1, rows // cell_rows)
        return n, F.least(F.floor(share * n), F.lit(n - 1))
    without, null_cell = by_hash(r[0] - r[1])
    if not bounds:
        return docs.withColumns({"coarse": F.lit(-1), "cell": null_cell})
    cuts = max(1, r[0] // (256 * cell_rows))
    widths = [max(1.0, (float(b) - float(a)) / cuts) for a, b in zip(bounds, bounds[1:])] + [float(1 << 62)]
    own = [max(0, found.count(b) - 1) * r[1] // (256 * cell_rows) for b in bounds]           # cells of the bound itself
    arrays = [F.array(*[F.lit(x).cast(t) for x in v]) for v, t in ((bounds, "long"), (widths, "double"), (own, "long"))]
    coarse = F.coalesce(F.size(F.filter(arrays[0], lambda b: b <= F.col("doc_id"))) - 1, F.lit(-1))
    low, width, cells = (F.get(a, F.greatest(F.col("coarse"), F.lit(0))) for a in arrays)
    # ids below the first quantile (it is approximate) share interval -1 with NULL ids, which come first
    cell = (F.when(F.col("doc_id").isNull(), null_cell).when(F.col("coarse") < 0, F.lit(without).cast("long"))
            .when((F.col("doc_id") == low) & (cells > 0), F.least(F.floor(share * cells), cells - 1))
            .otherwise(cells + F.floor((F.col("doc_id").cast("double") - low.cast("double")) / width)))
    return docs.withColumn("coarse", F.when(F.col("doc_id").isNull(), -1).otherwise(coarse)).withColumn("cell", cell)


def with_next(docs: DataFrame, cell_rows: int = 512) -> DataFrame:
    """doc_id, text and the next document's ``next_text`` in ascending doc_id
    (rows of one id, or without one: by the XXH64 of the text); after the last
    row comes the first.  NULL texts become empty.

    One shuffle of the texts by id interval; inside an interval a window finds
    the next row, and the last row of each interval joins the first of the
    next.  No task sees more than an interval, or the list of the intervals
    of one coarse interval.
    """
    base = _cells(docs.withColumn("text", F.coalesce("text", F.lit(""))), cell_rows).repartition("coarse", "cell")
    w = Window.partitionBy("coarse", "cell").orderBy("doc_id", "h", "text")
    inside = base.withColumn("next_text", F.lead("text").over(w)).filter("next_text IS NOT NULL")
    firsts = base.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(
        F.col("coarse").alias("c2"), F.col("cell").alias("e2"), F.col("text").alias("next_text"))
    lasts = base.withColumn("_l", F.lead(F.lit(1)).over(w)).filter("_l IS NULL")
    cells = base.groupBy("coarse", "cell").agg(F.count(F.lit(1)).alias("n"))
    chain = cells.select("coarse", "cell", F.lead("cell").over(Window.partitionBy("coarse").orderBy("cell")).alias("e2"))
    heads = cells.groupBy("coarse").agg(F.min("cell").alias("cell"))
    follow = heads.select("coarse", F.lead("coarse").over(Window.orderBy("coarse")).alias("c3"),
                          F.lead("cell").over(Window.orderBy("coarse")).alias("e3"),
                          F.first("coarse").over(Window.orderBy("coarse")).alias("c0"),
                          F.first("cell").over(Window.orderBy("coarse")).alias("e0"))   # at most 258 rows
    nxt = chain.join(F.broadcast(follow), "coarse").select(
        "coarse", "cell", F.when(F.col("e2").isNotNull(), F.col("coarse")).otherwise(F.coalesce("c3", "c0")).alias("c2"),
        F.coalesce("e2", "e3", "e0").alias("e2"))
    last = lasts.join(nxt, ["coarse", "cell"]).join(firsts, ["c2", "e2"])
    cols = ["doc_id", "text", "next_text"]
    return inside.select(*cols).unionByName(last.select(*cols))


def half_edit(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as
    many (or all) of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id and the fingerprint of every row (all of ``docs``, no shuffle)."""
    return docs.select("doc_id", fingerprint(F.col("text"), k, s).alias("fingerprint"))


def compare_neighbours(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Every document's fingerprint, that of its half-edited text, and the
    likeness of the first to the second and to the next document's."""
    d = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    d = d.withColumn("edited", half_edit(F.col("text"), F.col("next_text")))
    d = d.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 *[fingerprint(F.col(c), k, s).alias(f"_{c}") for c in ("text", "edited", "next_text")])
    return d.select("doc_id", "n_chars", "edited_sha256", printed(F.col("_text")).alias("fingerprint"),
                    printed(F.col("_edited")).alias("edited_fingerprint"),
                    likeness(F.col("_text"), F.col("_edited")).alias("near_edited"),
                    likeness(F.col("_text"), F.col("_next_text")).alias("near_next"))
