"""Least squares of any number of columns, one model a series (M2).

One aggregate gives the means and the covariances of a series (the Gram matrix
of the centred columns; built from partial aggregates, so a series of any
length costs one row a task).  The correlations are then solved by Cholesky, as
array expressions over the one row of each series: no series leaves the JVM and
none meets another.

A constant column gets the coefficient 0.  Where a pivot shows that the others
depend on each other, the correlations get a ridge on their diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A variance below this share of the squared mean is rounding: a constant.
CONSTANT = 1e-20
#: A smaller pivot of the correlations calls for the ridge.
SINGULAR = 1e-9
RIDGE = 1e-6


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cholesky(a: Column, k: int) -> Column:
    """struct(rows, least): the lower triangle L (row i has i + 1 entries) with
    L L' = a, and the least pivot before its root."""
    idx = F.array(*[F.lit(i) for i in range(k)])

    def add_row(acc, i):
        def entry(row, j):
            l = acc["rows"][j]  # noqa: E741
            return F.array_append(row, (a[i][j] - _dot(row, F.slice(l, F.lit(1), j))) / l[j])
        left = F.aggregate(F.slice(idx, F.lit(1), i), _empty("array<double>"), entry)

        def close(row):
            pivot = a[i][i] - _dot(row, row)
            return F.struct(F.array_append(acc["rows"], F.array_append(row, F.sqrt(F.greatest(pivot, F.lit(1e-300))))).alias("rows"),
                            F.least(acc["least"], pivot).alias("least"))
        return F.transform(F.array(left), close)[0]
    return F.aggregate(idx, F.struct(_empty("array<array<double>>").alias("rows"), F.lit(float("inf")).alias("least")), add_row)


def solve(rows: Column, b: Column, k: int) -> Column:
    """x with L L' x = b."""
    idx = F.array(*[F.lit(i) for i in range(k)])
    z = F.aggregate(idx, _empty("array<double>"), lambda z, i: F.array_append(z, (b[i] - _dot(F.slice(rows[i], F.lit(1), i), z)) / rows[i][i]))

    def back(z):
        def step(x, i):
            below = F.transform(F.slice(rows, i + 2, F.lit(k - 1) - i), lambda r: r[i])
            return F.array_prepend(x, (z[i] - _dot(below, x)) / rows[i][i])
        return F.aggregate(F.reverse(idx), _empty("array<double>"), step)
    return F.transform(F.array(z), back)[0]


def least_squares(rows: DataFrame, columns, y: str = "y", series_cols=(), ridge: float = RIDGE) -> DataFrame:
    """(series, n_train, intercept, coefficients) of every series with a
    complete row; ``coefficients`` is an array in the order of ``columns``."""
    cols = list(columns)
    k = len(cols)
    whole = rows
    for c in [*cols, y]:
        whole = whole.filter(F.col(c).isNotNull())
    pairs = [(i, j) for i in range(k) for j in range(i)]
    g = whole.groupBy(*series_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_train"), F.avg(y).alias("_y"), F.array(*[F.avg(c) for c in cols]).alias("_mean"),
        F.array(*[F.var_pop(c) for c in cols]).alias("_var"), F.array(*[F.covar_pop(c, y) for c in cols]).alias("_cy"),
        (F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]) if pairs else _empty("array<double>")).alias("_cov")).filter("n_train > 0")
    sd = F.zip_with("_var", "_mean", lambda v, m: F.when(v > F.lit(CONSTANT) * (m * m), F.sqrt(v)))
    g = g.withColumn("_sd", sd)
    idx = F.array(*[F.lit(i) for i in range(k)])

    def corr(i, j):
        high = F.greatest(i, j)
        c = F.col("_cov")[F.shiftright(high * (high - 1), 1) + F.least(i, j)] / (F.col("_sd")[i] * F.col("_sd")[j])     # row by row of the triangle
        return F.when(i == j, F.lit(1.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    g = g.withColumn("_r", F.transform(idx, lambda i: F.transform(idx, lambda j: corr(i, j))))
    g = g.withColumn("_b", F.zip_with("_cy", "_sd", lambda c, s: F.coalesce(c / s, F.lit(0.0))))
    g = g.withColumn("_l", cholesky(F.col("_r"), k))
    eased = F.transform("_r", lambda row, i: F.transform(row, lambda v, j: v + F.when(i == j, F.lit(ridge)).otherwise(0.0)))
    g = g.withColumn("_l", F.when(F.col("_l.least") > SINGULAR, F.col("_l.rows")).otherwise(cholesky(eased, k)["rows"]))
    g = g.withColumn("_x", solve(F.col("_l"), F.col("_b"), k))
    g = g.withColumn("coefficients", F.zip_with("_x", "_sd", lambda x, s: F.coalesce(x / s, F.lit(0.0))))
    return g.select(*series_cols, "n_train", (F.col("_y") - _dot(F.col("coefficients"), F.col("_mean"))).alias("intercept"), "coefficients")


def linear_score(rows: DataFrame, model: DataFrame, columns, series_cols=(), out: str = "pred") -> DataFrame:
    """M3: ``rows`` with the linear prediction of their series; NULL where an
    input or the model lacks."""
    from sensorspark.operators.blocks import join_series_stats
    m = model.select(*series_cols, F.col("intercept").alias("_a"), F.col("coefficients").alias("_b"))
    p = F.col("_a")
    for i, c in enumerate(columns):
        p = p + F.col("_b")[i] * F.col(c)
    return join_series_stats(rows, m, series_cols).withColumn(out, p).drop("_a", "_b")
