"""Forecast error metrics and model comparison.

All metrics are declarative aggregates (partial + final aggregation).  The
group mean of the truth that R² and the index of agreement need is a small
per-group aggregate joined back, not a window over row-level data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.constants import (CLAIM_MSE_IMPROVEMENT, IMPROVEMENT_EPS, IOA_EPS, MAPE_FLOOR,
                                   PERSISTENCE_ALARM_FACTOR, WITHIN_PCT, WITHIN_UNITS)

#: Variance of a truth, as a share of its squared mean, that is rounding only.
CONSTANT = 1e-24

METRIC_NAMES = ["mse", "rmse", "mae", "r2", "mape", "within_25pct", "within_50", "bias", "index_of_agree"]


def _join_group(df: DataFrame, stats: DataFrame, group_cols, few_groups: bool = False) -> DataFrame:
    """Attach per-group aggregates: one row, or as many as the caller vouches
    are few (``few_groups``), by broadcast; else by a join that AQE plans."""
    if group_cols:
        return df.join(F.broadcast(stats) if few_groups else stats, list(group_cols), "left")
    one = stats.withColumn("_one", F.lit(0))
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one", "left").drop("_one")


def _sums(y: Column, p: Column, ybar: Column, prefix: str = "") -> list[Column]:
    """The aggregates behind all metrics of one prediction column."""
    e, denom = p - y, F.greatest(F.abs(y), F.lit(MAPE_FLOOR))
    share = lambda c: F.avg(c.cast("double")) * 100
    out = {"n": F.count(e).cast("bigint"), "mse": F.avg(e * e), "mae": F.avg(F.abs(e)), "ssres": F.sum(e * e),
           "sstot": F.sum(F.when(p.isNotNull(), F.pow(y - ybar, 2))), "mape": F.avg(F.abs(e) / denom) * 100,
           "within_25pct": share(F.abs(e) / denom <= F.lit(WITHIN_PCT)), "within_50": share(F.abs(e) <= F.lit(WITHIN_UNITS)),
           "bias": F.avg(e), "ybar": F.max(ybar), "ioa": F.sum(F.pow(F.abs(p - ybar) + F.abs(y - ybar), 2))}
    return [c.alias(f"_{prefix}{k}") for k, c in out.items()]


def _metrics(prefix: str = "") -> dict[str, Column]:
    """METRIC_NAMES from the columns of ``_sums``."""
    c = lambda k: F.col(f"_{prefix}{k}")
    # a truth that is constant up to rounding has no variance; a prediction may equal it up to rounding
    rounding = F.lit(CONSTANT) * c("n") * c("ybar") * c("ybar")
    constant = c("sstot") <= rounding
    r2 = (F.when(constant, F.when(c("ssres") <= rounding, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(F.lit(1.0) - c("ssres") / c("sstot")))
    return {"mse": c("mse"), "rmse": F.sqrt(c("mse")), "mae": c("mae"), "r2": r2, "mape": c("mape"), "within_25pct": c("within_25pct"),
            "within_50": c("within_50"), "bias": c("bias"), "index_of_agree": F.lit(1.0) - c("ssres") / (c("ioa") + F.lit(IOA_EPS))}


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", group_cols=(), few_groups: bool = False) -> DataFrame:
    """A8-A13 per group: n, MSE, RMSE, MAE, R² (zero-variance truth: 1 if exact
    else 0), MAPE and within-25 % with denominator max(|y|, 1), within-50
    units, bias = mean(pred - y), Willmott index of agreement.

    ``few_groups``: the caller vouches that the groups are few (models, splits);
    their means are then broadcast and no row moves before its aggregate."""
    d = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    d = _join_group(d, d.groupBy(*group_cols).agg(F.avg(y).alias("_ybar")), group_cols, few_groups)
    g = d.groupBy(*group_cols).agg(*_sums(F.col(y), F.col(pred), F.col("_ybar")))
    return g.select(*group_cols, F.col("_n").alias("n"), *[c.alias(k) for k, c in _metrics().items()])


def improvement(base: Column, cand: Column) -> Column:
    """(baseline - candidate) / (baseline + 1e-8) * 100."""
    return (base - cand) / (base + F.lit(IMPROVEMENT_EPS)) * 100


def align_predictions(truth: DataFrame, baseline: DataFrame, candidate: DataFrame, key, y: str = "y", pred: str = "pred",
                      how: str = "inner") -> DataFrame:
    """Two models' prediction tables and the truth, aligned by key (never
    by position).  ``how='inner'`` keeps what all three hold, ``'left'`` every
    row of the truth; a NULL key meets no other.

    One aggregate over the three tables; a key that any of them holds twice
    raises an error instead of multiplying rows.
    """
    key = list(key)
    none = F.lit(None).cast("double")
    whole = [F.col(k).isNotNull() for k in key]
    lacking = ~reduce(lambda a, b: a & b, whole)
    sides = [truth.select(*key, F.col(y).cast("double").alias("y"), none.alias("b"), none.alias("c"), F.lit(0).alias("_t")),
             baseline.select(*key, none.alias("y"), F.col(pred).cast("double").alias("b"), none.alias("c"), F.lit(1).alias("_t")),
             candidate.select(*key, none.alias("y"), none.alias("b"), F.col(pred).cast("double").alias("c"), F.lit(2).alias("_t"))]
    n = [F.count(F.when(F.col("_t") == i, 1)).alias(f"_n{i}") for i in range(3)]
    g = reduce(DataFrame.unionByName, sides).filter(~lacking).groupBy(*key).agg(F.max("y").alias("y"), F.max("b").alias("b"), F.max("c").alias("c"), *n)
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
    repeated = F.raise_error(F.concat(F.lit("a prediction key is repeated: "), name))
    once = lambda c: F.when(F.greatest("_n0", "_n1", "_n2") > 1, repeated.cast("double")).otherwise(c)
    # one condition, or Spark might drop the row before it looks at its count
    g = g.filter(once(F.expr("CAST(_n0 = 1 AND _n1 = 1 AND _n2 = 1 AS DOUBLE)" if how == "inner" else "CAST(_n0 = 1 AS DOUBLE)")) == 1)
    out = g.select(*key, once(F.col("y")).alias("y"), once(F.col("b")).alias("pred_baseline"), once(F.col("c")).alias("pred_candidate"))
    if how == "inner":
        return out
    return out.unionByName(sides[0].filter(lacking).select(*key, "y", none.alias("pred_baseline"), none.alias("pred_candidate")))


def compare_models(preds: DataFrame, y: str = "y", baseline: str = "pred_baseline",
                   candidate: str = "pred_candidate", group_cols=(), few_groups: bool = False) -> DataFrame:
    """M6: metrics of two aligned prediction columns (``align_predictions``)
    against the truth, their improvements and the claim flag (MSE improvement
    >= 7.5 %).  The truth's mean does not depend on the model, so one join and
    one aggregate serve both; rows without the truth or either prediction
    don't count."""
    d = preds.filter(F.col(y).isNotNull() & F.col(baseline).isNotNull() & F.col(candidate).isNotNull())
    d = _join_group(d, d.groupBy(*group_cols).agg(F.avg(y).alias("_ybar")), group_cols, few_groups)
    g = d.groupBy(*group_cols).agg(*_sums(F.col(y), F.col(baseline), F.col("_ybar"), "b_"), *_sums(F.col(y), F.col(candidate), F.col("_ybar"), "c_"))
    out = g.select(*group_cols, F.col("_b_n").alias("n"), *[c.alias(f"{m}_{k}") for m in ("baseline", "candidate") for k, c in _metrics(f"{m[0]}_").items()])
    for c in ("mse", "mae", "rmse"):
        out = out.withColumn(f"{c}_improvement_pct", improvement(F.col(f"baseline_{c}"), F.col(f"candidate_{c}")))
    out = out.withColumn("meets_claim", F.col("mse_improvement_pct") >= F.lit(CLAIM_MSE_IMPROVEMENT))
    return out if group_cols else out.filter("n > 0")


def quality_alarm(rmse: Column, persistence_rmse: Column) -> Column:
    """model RMSE above 3x the persistence RMSE."""
    return rmse > persistence_rmse * F.lit(PERSISTENCE_ALARM_FACTOR)


def persistence_rmse(split_windows: DataFrame, lag_col: str, series_cols=(), split: str = "test") -> DataFrame:
    """sqrt(mean((y_t - y_{t-1})^2)) over consecutive targets of a split.
    Windows are contiguous hours, so y_{t-1} is the row's own lag-1 feature;
    the split's first window has no predecessor inside the split and is left
    out."""
    s = split_windows.filter(F.col("split") == split)
    first = s.groupBy(*series_cols).agg(F.min("widx").alias("_w0"))
    s = _join_group(s, first, series_cols).filter(F.col("widx") > F.col("_w0"))
    return s.groupBy(*series_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("pairs"),
        F.sqrt(F.avg(F.pow(F.col("y") - F.col(lag_col), 2))).alias("persistence_rmse"))
