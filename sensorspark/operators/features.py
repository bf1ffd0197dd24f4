"""Feature table and sliding windows.

All row windows run on the ``(series, block)`` partitioning created by the
gap fill: lags, rolling frames and the NULL filter are one stage after one
exchange (halo = gap look-back 9 + longest feature look-back 72).  Windows
are cut from the (much smaller) feature table with a halo of T rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.constants import (CROSS_LAGS, CROSS_PARAMS, PARAMETERS, ROLLING_WINDOWS, SEQ_LENGTH,
                                   TARGET, TARGET_LAGS)
from sensorspark.operators.blocks import DEFAULT_BLOCK_HOURS, add_blocks, block_window
from sensorspark.operators.resample import GAP_LOOKBACK, blocked_grid

CYCLIC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]


def cyclic_exprs(ts: Column) -> list[Column]:
    """sin/cos of hour/24, weekday/7 (Monday = 0) and month/12."""
    two_pi = F.lit(2 * math.pi)
    parts = [("hour", F.hour(ts), 24), ("dow", F.weekday(ts), 7), ("month", F.month(ts), 12)]
    out = []
    for name, v, period in parts:
        ang = two_pi * v / F.lit(period)
        out += [F.sin(ang).alias(f"{name}_sin"), F.cos(ang).alias(f"{name}_cos")]
    return out


def feature_columns(parameters=None, target: str = TARGET) -> list[str]:
    """Column order of the feature table: parameters (alphabetical, as a pivot
    lays them out), target lags, rolling mean/std pairs, cross lags, cyclic."""
    params = sorted(parameters or PARAMETERS)
    cols = list(params)
    cols += [f"{target}_lag_{k}h" for k in TARGET_LAGS]
    for w in ROLLING_WINDOWS:
        cols += [f"{target}_rmean_{w}h", f"{target}_rstd_{w}h"]
    cols += [f"{p}_lag_{k}h" for p in CROSS_PARAMS if p in params and p != target for k in CROSS_LAGS]
    return cols + CYCLIC


def input_columns(parameters=None, target: str = TARGET) -> list[str]:
    """Window inputs X: every feature column except the target itself."""
    return [c for c in feature_columns(parameters, target) if c != target]


def _origin(col: str, params) -> str | None:
    """Parameter a feature column is derived from (None for calendar columns)."""
    for p in params:
        if col == p or col.startswith(p + "_"):
            return p
    return None


def feature_lookback() -> int:
    return max(max(TARGET_LAGS), max(CROSS_LAGS), max(ROLLING_WINDOWS) - 1)


def _features_blocked(hourly: DataFrame, parameters, target, series_cols, block,
                      allow_backfill=True, checkpoint=True) -> DataFrame:
    params = list(parameters or PARAMETERS)
    halo = GAP_LOOKBACK + feature_lookback()
    g = blocked_grid(hourly, params, series_cols, block, halo, allow_backfill, checkpoint)
    wb = block_window(series_cols)
    y = F.col(target)
    exprs = [F.lag(y, k).over(wb).alias(f"{target}_lag_{k}h") for k in TARGET_LAGS]
    for w in ROLLING_WINDOWS:
        fr = wb.rowsBetween(-(w - 1), 0)
        exprs += [F.avg(y).over(fr).alias(f"{target}_rmean_{w}h"),
                  F.coalesce(F.stddev_samp(y).over(fr), F.lit(0.0)).alias(f"{target}_rstd_{w}h")]
    exprs += [F.lag(F.col(p), k).over(wb).alias(f"{p}_lag_{k}h")
              for p in CROSS_PARAMS if p in params and p != target for k in CROSS_LAGS]
    f = g.select(*series_cols, "_blk", "_own", "pos", "datetime", *params, *exprs,
                 *cyclic_exprs(F.col("datetime")), *[F.col(f"_has_{p}") for p in params])
    # Drop rows with any NULL.  A parameter that never occurs in a series
    # has no column in a pandas pivot; here its column is all NULL and ignored.
    cols = feature_columns(params, target)
    ok = F.lit(True)
    for c in cols:
        p = _origin(c, params)
        cond = F.col(c).isNotNull()
        if p is not None and p != target:
            cond = cond | ~F.coalesce(F.col(f"_has_{p}"), F.lit(False))
        ok = ok & cond
    return f.filter(ok)


def feature_table(hourly: DataFrame, parameters=None, target: str = TARGET, series_cols=(),
                  block: int = DEFAULT_BLOCK_HOURS, allow_backfill: bool = True, checkpoint: bool = True) -> DataFrame:
    """Gap-filled hourly table + W1-W4 + F1, rows with NULLs dropped.
    Input: the hourly wide table (``hourly_wide``); ``checkpoint=False`` where
    the caller has materialized it."""
    params = list(parameters or PARAMETERS)
    f = _features_blocked(hourly, params, target, series_cols, block, allow_backfill, checkpoint)
    return f.filter("_own").select(*series_cols, "pos", "datetime", *feature_columns(params, target))


def sequence_windows(features: DataFrame, parameters=None, target: str = TARGET, series_cols=(),
                     seq_length: int = SEQ_LENGTH, block: int = DEFAULT_BLOCK_HOURS,
                     with_x: bool = True, keep=(), last=()) -> DataFrame:
    """One row per window: ``ts``/``y`` of row i+T and ``x`` = the T
    preceding feature rows (all columns but the target) as an array of
    structs, built by ``collect_list`` over a ``rowsBetween(-T, -1)`` frame.

    Input is the feature table (with ``pos``).  It is re-blocked by
    ``(series, block)`` with a halo of T rows, so a long series is cut into
    windows by many tasks.  After gap fill, NULL rows only occur at the start
    (lags) and end (long trailing gaps) of a series, so valid feature rows are
    contiguous and a positional window equals the T preceding hours; windows
    are kept when all T rows are present and contiguous.  ``keep`` carries
    columns of row i+T itself (e.g. its lag features for naive forecasts),
    ``last`` those of the window's last row as ``x_<column>``.
    """
    params = list(parameters or PARAMETERS)
    T = int(seq_length)
    f = add_blocks(features, block, T).repartition(*series_cols, "_blk")
    fr = block_window(series_cols).rowsBetween(-T, -1)
    xin = input_columns(params, target)
    cols = [*series_cols, "pos", F.col("datetime").alias("ts"), F.col(target).alias("y"),
            *keep, *[F.lag(c, 1).over(block_window(series_cols)).alias(f"x_{c}") for c in last], F.count(F.lit(1)).over(fr).alias("_n"), F.min("pos").over(fr).alias("_p0"), "_own"]
    if with_x:
        cols.append(F.collect_list(F.struct(*[F.col(c) for c in xin])).over(fr).alias("x"))
    w = f.select(*cols)
    w = w.filter(F.col("_own") & (F.col("_n") == T) & (F.col("_p0") == F.col("pos") - T))
    return w.drop("_n", "_p0", "_own")
