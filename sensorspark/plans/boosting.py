"""Boosted regression trees on histograms (M2), scored by generated SQL.

The bin edges of every column are exact quantiles of the training rows.  A level
of a tree takes one grouped count of (node, column, bin), combined map-side; its
result, at most 2^depth x columns x bins rows, is all that the driver sees.  The
split with the largest reduction of squared error wins, of equal ones (to nine digits) the
first column and the lowest edge.  A fitted model is a few hundred numbers and
is scored by a SQL expression over the raw columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.operators.quantiles import exact_quantiles
from sensorspark.session import materialize


#: Gains that differ by less (as a share of the best) are equal.
TIE = 1e-9


@dataclass(frozen=True)
class Split:
    """Rows with column < edge go left; ``left`` and ``right`` are leaves or splits."""
    column: int
    bin: int
    edge: float
    left: "Split | float"
    right: "Split | float"


@dataclass(frozen=True)
class Boosted:
    columns: tuple[str, ...]
    start: float
    trees: tuple["Split | float", ...]


def edges_of(rows: DataFrame, columns, bins: int, **options) -> list[list[float]]:
    """Different interior edges of ``bins`` equal-count bins of each column."""
    found = exact_quantiles(rows, columns, [i / bins for i in range(1, bins)], **options)
    return [sorted(set(found[c][1] or [])) for c in columns]


def _bin_expr(c: str, edges: list[float]) -> Column:
    """How many edges are at most the value."""
    if not edges:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (F.col(c) >= e).cast("int"))


def _node(tree, bins: Column) -> Column:
    """The number of the open node a row falls into (``tree``'s leaves are node numbers)."""
    if not isinstance(tree, Split):
        return F.lit(tree)
    return F.when(bins[tree.column] < tree.bin, _node(tree.left, bins)).otherwise(_node(tree.right, bins))


def _best(hist, edges, min_rows: int):
    """(column, bin) of the best split from hist[column][bin] = (n, sum), or None."""
    gains = []
    for c, own in sorted(hist.items()):
        n, s = sum(x[0] for x in own.values()), sum(x[1] for x in own.values())
        nl = sl = 0.0
        for b in range(1, len(edges[c]) + 1):
            x = own.get(b - 1, (0, 0.0))
            nl, sl = nl + x[0], sl + x[1]
            if min_rows <= nl <= n - min_rows:
                gains.append((sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n, c, b))
    best = max((g for g, _, _ in gains), default=0.0)
    return next(((c, b) for g, c, b in gains if g > TIE and g >= best * (1 - TIE)), None)


def fit_boosted(rows: DataFrame, columns, y: str = "y", rounds: int = 10, depth: int = 2, rate: float = 0.3, bins: int = 16, min_rows: int = 5,
                **options) -> Boosted | None:
    """Boosted trees on the rows without NULL; None where there are none."""
    cols = list(columns)
    whole = rows.select(F.col(y).cast("double").alias("_y"), *cols).dropna()
    whole = materialize(whole)
    edges = edges_of(whole, cols, bins, **options)
    start = whole.agg(F.avg("_y")).first()[0]
    if start is None:
        return None
    binned = materialize(whole.select("_y", F.array(*[_bin_expr(c, e).cast("tinyint") for c, e in zip(cols, edges)]).alias("_b")))
    trees: list = []
    for _ in range(rounds):
        bin_col = F.col("_b")
        residual = F.col("_y") - F.lit(start)
        for t in trees:
            residual = residual - _leaf(t, bin_col)
        tree = _grow(binned.withColumn("_r", residual), edges, depth, rate, min_rows)
        if tree is None:
            break
        trees.append(tree)
    return Boosted(tuple(cols), start, tuple(trees))


def _leaf(tree, bins: Column) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(bins[tree.column] < tree.bin, _leaf(tree.left, bins)).otherwise(_leaf(tree.right, bins))


def _grow(rows: DataFrame, edges, depth: int, rate: float, min_rows: int):
    """One tree on the residuals ``_r``; None where nothing splits."""
    splits: dict[int, tuple[int, int]] = {}             # node 1 is the root, 2 n and 2 n + 1 the children of n
    value: dict[int, float] = {}
    frontier = [1]

    def shape(n):
        if n not in splits:
            return n
        c, b = splits[n]
        return Split(c, b, edges[c][b - 1], shape(2 * n), shape(2 * n + 1))
    for level in range(depth + 1):
        g = rows.select(_node(shape(1), F.col("_b")).alias("node"), "_r", F.posexplode("_b").alias("c", "b")) if level < depth else \
            rows.select(_node(shape(1), F.col("_b")).alias("node"), "_r", F.lit(0).alias("c"), F.lit(0).alias("b"))
        hist: dict = {}
        for r in g.groupBy("node", "c", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("s")).collect():
            hist.setdefault(r.node, {}).setdefault(r.c, {})[r.b] = (r.n, r.s)
        for n in frontier:
            own = hist[n][min(hist[n])]
            value[n] = rate * sum(x[1] for x in own.values()) / sum(x[0] for x in own.values())
        if level == depth:
            break
        grown = []
        for n in frontier:
            at = _best(hist[n], edges, min_rows)
            if at:
                splits[n] = at
                grown += [2 * n, 2 * n + 1]
        if not grown:
            break
        frontier = grown

    def leaves(n):
        if n not in splits:
            return value[n]
        c, b = splits[n]
        return Split(c, b, edges[c][b - 1], leaves(2 * n), leaves(2 * n + 1))
    return leaves(1) if splits else None


def boosted_sql(model: Boosted) -> str:
    """The prediction as a SQL expression (doubles with all their digits)."""
    def case(t):
        if not isinstance(t, Split):
            return f"CAST('{t!r}' AS DOUBLE)"
        return f"CASE WHEN {model.columns[t.column]} < CAST('{t.edge!r}' AS DOUBLE) THEN {case(t.left)} ELSE {case(t.right)} END"
    whole = " AND ".join(f"{c} IS NOT NULL" for c in model.columns)
    return f"CASE WHEN {whole} THEN " + " + ".join([f"CAST('{model.start!r}' AS DOUBLE)", *[case(t) for t in model.trees]]) + " END"


def boosted_score(rows: DataFrame, model: Boosted | None, out: str = "pred") -> DataFrame:
    """M3: ``rows`` with the model's prediction, NULL where an input is."""
    return rows.withColumn(out, F.expr(boosted_sql(model)) if model else F.lit(None).cast("double"))


def boosted_predict(model: Boosted, x: np.ndarray) -> np.ndarray:
    """The prediction for rows of numbers; NaN where an input is."""
    def of(t, x):
        if not isinstance(t, Split):
            return np.full(len(x), t)
        return np.where(x[:, t.column] < t.edge, of(t.left, x), of(t.right, x))
    return np.where(np.isnan(x).any(axis=1), np.nan, model.start + sum((of(t, x) for t in model.trees), np.zeros(len(x))))
