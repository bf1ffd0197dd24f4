"""Exact quantiles of many columns of a table of any size.

One wide pass (a column is never unpivoted) takes each column's count and a
mergeable quantile sketch, ``percentile_approx``, whose error in ranks is known.
The sketch brackets every wanted order statistic.  Further wide passes count
what lies below and inside each bracket; a bracket with more than ``most``
values is narrowed by a sketch of the values inside it, a hundredfold or more each
time.  At last only the values inside the brackets leave their rows; they are
counted by value and put in order, so that no task holds more than one bracket.
A bracket of equal values needs no order at all.

A table of 10^12 rows takes a sketch, two passes of narrowing and the last one;
up to ``most / 4 * accuracy`` values a column it is three scans, and two where
no column has over ``small`` values, which Spark's own exact percentile orders.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Quantiles of the values inside a bracket that a narrowing pass asks for.
INNER = 400


@dataclass
class Bracket:
    """Where the order statistics ``first`` and ``last`` (ranks from 0) of a column lie."""
    column: str
    first: int
    last: int
    lo: float
    hi: float
    below: int = 0
    inside: int = 0


def value_of(column: str) -> Column:
    """The column as double; NaN is missing, as NULL is."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


def _inside(b: Bracket) -> Column:
    x = value_of(b.column)
    return (x >= F.lit(b.lo)) & (x <= F.lit(b.hi))


def _literals(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sketch(df: DataFrame, columns, points, accuracy: int):
    """Count of every column and, per wanted point, values on either side of it."""
    d = 2.0 / accuracy
    wide = [min(1.0, max(0.0, q + s * d)) for q in points for s in (-1, 1)]
    row = df.agg(*[F.count(value_of(c)).alias(f"n{i}") for i, c in enumerate(columns)],
                 *[F.percentile_approx(value_of(c), _literals(wide), F.lit(accuracy)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [row[f"n{i}"] for i in range(len(columns))], [row[f"b{i}"] for i in range(len(columns))]


def _count(df: DataFrame, brackets: list[Bracket], accuracy: int, inner: bool):
    """Set ``below`` and ``inside`` of the brackets; with ``inner`` also the
    quantiles of the values inside each."""
    aggs = []
    for i, b in enumerate(brackets):
        aggs += [F.count(F.when(value_of(b.column) < F.lit(b.lo), 1)).alias(f"c{i}"), F.count(F.when(_inside(b), 1)).alias(f"i{i}")]
        if inner:
            points = _literals([k / INNER for k in range(INNER + 1)])
            aggs.append(F.percentile_approx(F.when(_inside(b), value_of(b.column)), points, F.lit(accuracy)).alias(f"q{i}"))
    row = df.agg(*aggs).first()
    for i, b in enumerate(brackets):
        b.below, b.inside = row[f"c{i}"], row[f"i{i}"]
    return [row[f"q{i}"] for i in range(len(brackets))] if inner else []


def _holds(b: Bracket) -> bool:
    return b.below <= b.first and b.last < b.below + b.inside


def _narrow(df: DataFrame, brackets: list[Bracket], most: int, accuracy: int, rounds: int) -> list[Bracket]:
    """Narrow until no bracket of unlike values holds over ``most``; a bracket
    that a sketch put wrongly goes back to the one before."""
    _count(df, brackets, accuracy, False)
    missed = [b for b in brackets if not _holds(b)]
    for b in missed:
        b.lo, b.hi = -math.inf, math.inf
    if missed:
        _count(df, missed, accuracy, False)
    for _ in range(rounds):
        wide = [b for b in brackets if b.inside > most and b.lo < b.hi]
        if not wide:
            break
        before = [(b.lo, b.hi, b.below, b.inside) for b in wide]
        inner = _count(df, wide, accuracy, True)
        margin = 1 / INNER + 4 / accuracy
        for b, q in zip(wide, inner):
            a, z = (b.first - b.below) / b.inside - margin, (b.last - b.below + 1) / b.inside + margin
            if a > 0:
                b.lo = q[math.floor(a * INNER)]
            if z < 1:
                b.hi = q[math.ceil(z * INNER)]
        _count(df, wide, accuracy, False)
        for b, old in zip(wide, before):
            if not _holds(b):
                b.lo, b.hi, b.below, b.inside = old
        if all(b.inside >= old[3] for b, old in zip(wide, before)):
            break                                       # only copies of one value are left over
    return brackets


def _order(df: DataFrame, brackets: list[Bracket]) -> list[tuple[float, float]]:
    """The order statistics (first, last) of each bracket."""
    out: dict[int, tuple[float, float]] = {i: (b.lo, b.lo) for i, b in enumerate(brackets) if b.lo == b.hi}
    open_ = [(i, b) for i, b in enumerate(brackets) if i not in out]
    if open_:
        hits = F.array(*[F.when(_inside(b), F.struct(F.lit(i).alias("i"), value_of(b.column).alias("x"))) for i, b in open_])
        values = df.select(F.explode(F.array_compact(hits)).alias("h")).groupBy("h.i", "h.x").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        first, last = F.lit(None).cast("long"), F.lit(None).cast("long")
        for i, b in open_:
            first = F.when(F.col("i") == i, F.lit(b.first - b.below)).otherwise(first)
            last = F.when(F.col("i") == i, F.lit(b.last - b.below)).otherwise(last)
        ranked = values.withColumn("u", upto).select("i", "x", "u", first.alias("first"), last.alias("last"))
        got = ranked.groupBy("i").agg(F.min(F.when(F.col("u") > F.col("first"), F.col("x"))).alias("lo"),
                                      F.min(F.when(F.col("u") > F.col("last"), F.col("x"))).alias("hi"))
        out.update({r.i: (r.lo, r.hi) for r in got.collect()})
    return [out[i] for i in range(len(brackets))]


def exact_quantiles(df: DataFrame, columns, points, accuracy: int = 10_000, small: int = 1_000_000, most: int = 1_000_000,
                    rounds: int = 8) -> dict[str, tuple[int, list[float] | None]]:
    """column -> (count, quantiles with linear interpolation; None where a
    column has no value).  The result holds ``len(points)`` numbers a column."""
    columns, points = list(columns), list(points)
    if not columns:
        return {}
    counts, near = _sketch(df, columns, points, accuracy)
    if max(counts) <= small:
        row = df.agg(*[F.percentile(value_of(c), _literals(points)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: (counts[i], row[f"q{i}"]) for i, c in enumerate(columns)}
    brackets, at = [], {}
    for c, n, b in zip(columns, counts, near):
        for k, q in enumerate(points if n else []):
            r = q * (n - 1)
            at[c, k] = (len(brackets), r - math.floor(r))
            brackets.append(Bracket(c, math.floor(r), math.ceil(r), b[2 * k], b[2 * k + 1]))
    found = _order(df, _narrow(df, brackets, most, accuracy, rounds))

    def value(c, k):
        i, f = at[c, k]
        lo, hi = found[i]
        return lo if f == 0 else lo + (hi - lo) * f
    return {c: (n, [value(c, k) for k in range(len(points))] if n else None) for c, n in zip(columns, counts)}
