"""Forecasting re-expressed as Spark jobs (M1-M5).

The neural networks of the original are not rebuilt (single-machine Keras
training); what the chain needs from them -- a fitted forecaster, batch
scoring, recursive horizons, inverse transform -- is provided with
declarative aggregates (AR(1) by ``regr_slope``/``regr_intercept``),
``pyspark.ml`` regression on the flat last-row features, and recursions as
array expressions over each series' last hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.constants import FORECAST_HOURS, TARGET
from sensorspark.operators.blocks import join_series_stats
from sensorspark.plans.least_squares import least_squares


def naive_forecast(windows: DataFrame, target: str = TARGET) -> DataFrame:
    """M1: persistence (value one hour earlier) and seasonal naive (24 hours
    earlier) predictions for each window target.  Both come from the row's
    own lag features, so no extra window or join is needed."""
    return windows.withColumn("pred_persistence", F.col(f"{target}_lag_1h")) \
                  .withColumn("pred_seasonal", F.col(f"{target}_lag_24h"))


def ar1_fit(split_windows: DataFrame, lag_col: str = f"{TARGET}_lag_1h", series_cols=(),
            split: str = "train") -> DataFrame:
    """M2: per-series AR(1) y_t = a + phi * y_{t-1} by least squares on the
    train windows: two aggregate functions, partial-aggregated."""
    tr = split_windows.filter(F.col("split") == split)
    return tr.groupBy(*series_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_train"),
        F.regr_intercept("y", lag_col).alias("ar_a"),
        F.regr_slope("y", lag_col).alias("ar_phi"))


def ar1_predict(windows: DataFrame, model: DataFrame, lag_col: str = f"{TARGET}_lag_1h",
                series_cols=()) -> DataFrame:
    """M3: one-step AR(1) scores for every window."""
    w = join_series_stats(windows, model.select(*series_cols, "ar_a", "ar_phi"), series_cols)
    return w.withColumn("pred_ar1", F.col("ar_a") + F.col("ar_phi") * F.col(lag_col)).drop("ar_a", "ar_phi")


def forecast_grid(last: DataFrame, hours: int = FORECAST_HOURS, series_cols=(), ts_col: str = "last_ts") -> DataFrame:
    """M5: hourly future grid of ``hours`` rows after each series' last
    observed hour (not after the wall clock)."""
    return last.select(*series_cols, F.col(ts_col),
                       F.explode(F.sequence(F.lit(1), F.lit(int(hours)))).alias("h")) \
               .withColumn("ts", F.col(ts_col) + F.make_interval(hours=F.col("h")))


def last_observation(features: DataFrame, target: str = TARGET, series_cols=()) -> DataFrame:
    """Last observed hour and target value of each series (``max_by``, an
    aggregate -- no sort, no window)."""
    return features.groupBy(*series_cols).agg(
        F.max("datetime").alias("last_ts"),
        F.max_by(target, "datetime").alias("last_y"))


def ar1_recursive_forecast(features: DataFrame, model: DataFrame, hours: int = FORECAST_HOURS,
                           target: str = TARGET, series_cols=()) -> DataFrame:
    """M4 for AR(1): feeding each prediction back gives the closed form
    y_h = mu + phi^h (y_last - mu), mu = a / (1 - phi); for phi = 1 it is
    y_last + h * a.  Evaluated on the M5 grid: fully parallel, no loop."""
    last = last_observation(features, target, series_cols)
    last = join_series_stats(last, model.select(*series_cols, "ar_a", "ar_phi"), series_cols)
    g = last.select(*series_cols, "last_ts", "last_y", "ar_a", "ar_phi",
                    F.explode(F.sequence(F.lit(1), F.lit(int(hours)))).alias("h"))
    phi, a, y0, h = F.col("ar_phi"), F.col("ar_a"), F.col("last_y"), F.col("h")
    mu = a / (F.lit(1.0) - phi)
    pred = F.when(phi == 1.0, y0 + h * a).otherwise(mu + F.pow(phi, h) * (y0 - mu))
    return g.select(*series_cols, (F.col("last_ts") + F.make_interval(hours=h)).alias("ts"), "h",
                    pred.alias("forecast"), F.lit("recursive").alias("forecast_type"))


def ar_fit(split_windows: DataFrame, lag_cols, series_cols=(), split: str = "train") -> DataFrame:
    """M2 with any number of lags: per-series least squares on the train
    windows (``least_squares``).  ``lag_cols`` maps lag -> column; the result
    has ``n_train``, ``intercept`` and ``lag_<k>``."""
    m = least_squares(split_windows.filter(F.col("split") == split), list(lag_cols.values()), "y", series_cols)
    return m.select(*series_cols, "n_train", "intercept", *[F.col("coefficients")[i].alias(f"lag_{k}") for i, k in enumerate(lag_cols)])


def recursive_forecast(features: DataFrame, model: DataFrame, lags, hours: int = FORECAST_HOURS,
                       target: str = TARGET, series_cols=(), pos_col: str = "pos") -> DataFrame:
    """M4, general linear autoregression on target lags: each step's
    prediction is fed back into the lags of the next step.

    ``model``: one row per series with ``intercept`` and ``lag_<k>`` for every
    k of ``lags``.  The last max(lags) hours of a series (found by its last
    position, not by sorting it) are its history; the recursion is an
    expression over that short array, one row per series.  A series without
    all these hours, or without a model, gets NULL, not a forecast.
    """
    lags = sorted(int(k) for k in lags)
    need = lags[-1]
    last = features.groupBy(*series_cols).agg(F.max(pos_col).alias("_p"), F.max("datetime").alias("last_ts"))
    tail = join_series_stats(features.select(*series_cols, pos_col, target), last, series_cols).filter(F.col(pos_col) > F.col("_p") - need)
    hist = tail.groupBy(*series_cols).agg(
        F.first("last_ts").alias("last_ts"), F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(target).cast("double").alias("v")))).alias("_h"))
    hist = join_series_stats(hist, model.select(*series_cols, "intercept", *[f"lag_{k}" for k in lags]), series_cols)

    def step(acc, _):
        y = F.col("intercept")
        for k in lags:
            y = y + F.col(f"lag_{k}") * F.element_at(acc, -k)
        return F.array_append(acc, y)
    values = F.transform("_h", lambda s: s["v"])
    path = F.when(F.size("_h") == need, F.aggregate(F.sequence(F.lit(1), F.lit(int(hours))), values, step))
    out = hist.withColumn("_path", path).select(*series_cols, "last_ts", "_path", F.explode(F.sequence(F.lit(1), F.lit(int(hours)))).alias("h"))
    return out.select(*series_cols, (F.col("last_ts") + F.make_interval(hours=F.col("h"))).alias("ts"), "h",
                      F.get("_path", F.col("h") + need - 1).alias("forecast"), F.lit("recursive").alias("forecast_type"))


def fit_linear_forecaster(train: DataFrame, feature_cols, label: str = "y_scaled", reg: float = 0.0):
    """M2 with ``pyspark.ml``: linear regression on the z-scored last-row
    features of each window (distributed normal-equation/L-BFGS fit).
    Returns the assembler, the model and how many rows with a NULL the fit
    left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    whole = train.dropna(subset=[*feature_cols, label])
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred_scaled",
                          regParam=reg, standardization=False)
    model = lr.fit(va.transform(whole))
    return va, model, train.count() - model.summary.numInstances


def batch_score(df: DataFrame, assembler, model) -> DataFrame:
    """M3: score every row with a fitted ``pyspark.ml`` model (JVM-side); the
    prediction is NULL where an input is."""
    out = model.transform(assembler.transform(df)).drop("features")
    p = F.col("pred_scaled")
    return out.withColumn("pred_scaled", F.when(~F.isnan(p), p))
