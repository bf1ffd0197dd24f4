"""Recursive forecasts over the whole feature vector (M4).

The state of a series is its last hours: the target's, which each step extends
by its prediction, and the other parameters', which keep their last value once
the observations end.  Every step makes the feature row of the hour before
(lags, rolling means and stds, cross lags, calendar) from the state and asks the
model for the next hour.  Series are steps' rows: a task advances a block of
series together, so time is sequential and series are parallel.  A series is one
row with a short array; none meets another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.constants import CROSS_LAGS, CROSS_PARAMS, FORECAST_HOURS, PARAMETERS, ROLLING_WINDOWS, TARGET, TARGET_LAGS
from sensorspark.operators.blocks import join_series_stats
from sensorspark.operators.features import feature_lookback, feature_columns
from sensorspark.plans.boosting import Boosted, boosted_predict


def calendar(hours: np.ndarray) -> np.ndarray:
    """F1 for hours since the epoch: sin and cos of hour, weekday and month."""
    t = hours.astype("datetime64[h]")
    day = t.astype("datetime64[D]").astype(np.int64)
    month = t.astype("datetime64[M]").astype(np.int64) % 12 + 1
    out = []
    for v, period in ((hours % 24, 24), ((day + 3) % 7, 7), (month, 12)):
        a = 2 * math.pi * v / period
        out += [np.sin(a), np.cos(a)]
    return np.stack(out, axis=1)


def feature_rows(hist: dict[str, np.ndarray], hours: np.ndarray, parameters, target: str) -> np.ndarray:
    """The feature rows (``feature_columns``) of the last hour of ``hist``, which
    has (series, hours) of every parameter."""
    params = sorted(parameters)
    y = hist[target]
    cols = [hist[p][:, -1] for p in params]
    cols += [y[:, -1 - k] for k in TARGET_LAGS]
    for w in ROLLING_WINDOWS:
        cols += [y[:, -w:].mean(axis=1), y[:, -w:].std(axis=1, ddof=1)]
    cols += [hist[p][:, -1 - k] for p in CROSS_PARAMS if p in params and p != target for k in CROSS_LAGS]
    return np.concatenate([np.stack(cols, axis=1), calendar(hours)], axis=1)


def advance(hist: dict[str, np.ndarray], last: np.ndarray, predict, steps: int, parameters, target: str) -> np.ndarray:
    """(series, steps) of predictions; ``last`` is the last hour of each series."""
    hist = {p: v.copy() for p, v in hist.items()}
    out = np.empty((len(last), steps))
    for h in range(steps):
        out[:, h] = predict(feature_rows(hist, last + h, parameters, target))
        for p, v in hist.items():
            nxt = out[:, h:h + 1] if p == target else v[:, -1:]
            hist[p] = np.concatenate([v[:, 1:], nxt], axis=1)
    return out


def last_hours(features: DataFrame, parameters, need: int, series_cols=()) -> DataFrame:
    """(series, last_ts, last_pos, hist): the last ``need`` rows of every series
    as an array in time order, NULL where they are not ``need`` hours in a row."""
    last = features.groupBy(*series_cols).agg(F.max("pos").alias("_p"), F.max("datetime").alias("last_ts"))
    near = join_series_stats(features.select(*series_cols, "pos", *parameters), last, series_cols).filter(F.col("pos") > F.col("_p") - need)
    row = F.struct("pos", *[F.col(p).cast("double").alias(p) for p in parameters])
    g = near.groupBy(*series_cols).agg(F.first("last_ts").alias("last_ts"), F.first("_p").alias("last_pos"), F.array_sort(F.collect_list(row)).alias("_h"))
    return g.select(*series_cols, "last_ts", "last_pos", F.when(F.size("_h") == need, F.flatten(F.transform("_h", lambda r: F.array(*[r[p] for p in parameters])))).alias("hist"))


def feature_forecast(features: DataFrame, model: DataFrame | Boosted, hours: int = FORECAST_HOURS, parameters=None, target: str = TARGET,
                     series_cols=()) -> DataFrame:
    """(series, ts, h, forecast, forecast_type) for ``hours`` hours after each
    series' last one.

    ``model`` is a table of linear models over ``feature_columns``, one a series
    (``least_squares``), or one ``Boosted`` model for all.  The forecast is NULL
    for a series without a model or without a whole history.
    """
    params = sorted(parameters or PARAMETERS)
    need = feature_lookback() + 1
    rows = last_hours(features, params, need, series_cols)
    linear = not isinstance(model, Boosted)
    if linear:
        rows = join_series_stats(rows, model.select(*series_cols, F.col("intercept").cast("double").alias("_a"), F.col("coefficients").alias("_b")), series_cols)
    width = len(feature_columns(params, target))
    trees = None if linear else model

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            hist = np.full((n, need, len(params)), np.nan)
            for i, h in enumerate(b.column("hist").to_pylist()):
                if h is not None:
                    hist[i] = np.array([np.nan if x is None else x for x in h]).reshape(need, -1)
            if trees is None:
                a = np.array([np.nan if x is None else x for x in b.column("_a").to_pylist()], float)
                w = np.array([[np.nan] * width if x is None else x for x in b.column("_b").to_pylist()], float)
                predict = lambda x: a + (w * x).sum(axis=1)
            else:
                predict = lambda x: boosted_predict(trees, x)
            last = b.column("last_pos").to_numpy(zero_copy_only=False).astype(np.int64)
            y = advance({p: hist[:, :, i] for i, p in enumerate(params)}, last, predict, hours, params, target)
            pick = np.repeat(np.arange(n), hours)
            cols = [b.column(c).take(pa.array(pick)) for c in (*series_cols, "last_ts")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(np.arange(1, hours + 1), n), pa.int32()), pa.array(y.reshape(-1), pa.float64(), from_pandas=True)],
                                             [*series_cols, "last_ts", "h", "forecast"])

    kept = rows.select(*series_cols, "last_ts", "last_pos", "hist", *(["_a", "_b"] if linear else []))
    schema = ", ".join([*[f"{c} {features.schema[c].dataType.simpleString()}" for c in series_cols], "last_ts timestamp, h int, forecast double"])
    out = kept.mapInArrow(run, schema)
    return out.select(*series_cols, (F.col("last_ts") + F.make_interval(hours=F.col("h"))).alias("ts"), "h", "forecast", F.lit("recursive").alias("forecast_type"))
