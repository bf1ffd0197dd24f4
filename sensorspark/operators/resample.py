"""Long -> hourly wide table, hour spine and gap fill.

Plan shape: the raw readings are aggregated twice (per reading time, then per
hour), both with map-side partial aggregation, so everything after this point
works on at most ``#series x #hours`` rows.  The spine, the gap fill and the
features then share one ``(series, block)`` exchange (see ``blocks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.constants import FFILL_LIMIT, INTERP_LIMIT, PARAMETERS
from sensorspark.operators.blocks import (DEFAULT_BLOCK_HOURS, add_blocks, block_window,
                                          hour_pos, join_series_stats, pos_hour)
from sensorspark.session import materialize

GAP_LOOKBACK = INTERP_LIMIT + FFILL_LIMIT   # 9: beyond this a gap takes the next value


def pivot_mean(m: DataFrame, parameters, series_cols=()) -> DataFrame:
    """A1: mean value per (series, reading time, parameter) pooled over
    locations, pivoted to one column per parameter.  NULL readings are ignored
    and times without any reading do not appear (pandas drops all-NULL rows).
    ``parameters`` names the columns; readings of others are left out."""
    params = list(parameters)
    v = m.filter(F.col("value").isNotNull() & F.col("parameter").isin(params))
    return (v.groupBy(*series_cols, "datetime")
             .pivot("parameter", params)
             .agg(F.avg("value")))


def reading_means(m: DataFrame, parameters, series_cols=()) -> DataFrame:
    """A1 in long form: (series, datetime, parameter, v)."""
    params = list(parameters)
    v = m.filter(F.col("value").isNotNull() & F.col("parameter").isin(params))
    return v.groupBy(*series_cols, "datetime", "parameter").agg(F.avg("value").alias("v"))


def hourly_wide(m: DataFrame, parameters, series_cols=()) -> DataFrame:
    """A2: hourly value = mean of the per-reading-time means (two stages, not a
    flat mean), one column per parameter; the pivot is the conditional average
    of the second stage, so no extra pivot job runs."""
    params = list(parameters)
    a1 = reading_means(m, params, series_cols)
    hour = F.date_trunc("hour", F.col("datetime")).alias("hour")
    return (a1.groupBy(*series_cols, hour)
              .agg(*[F.avg(F.when(F.col("parameter") == p, F.col("v"))).alias(p) for p in params]))


def hourly_long(m: DataFrame, parameters, series_cols=()) -> DataFrame:
    """A2 in long form: (series, hour, parameter, value)."""
    a1 = reading_means(m, parameters, series_cols)
    return (a1.groupBy(*series_cols, F.date_trunc("hour", F.col("datetime")).alias("hour"), "parameter")
              .agg(F.avg("v").alias("value")))


def _next_value_summary(h: DataFrame, bounds: DataFrame, params, series_cols, block: int) -> DataFrame:
    """Per (series, block): the first non-NULL (pos, value) of each parameter in
    any *later* block, and whether the parameter occurs in the series at all.
    One row per block of the spine (empty blocks included), so the window over
    blocks is small."""
    hb = h.withColumn("_blk", F.floor(F.col("pos") / F.lit(block)).cast("bigint"))
    first_in_blk = hb.groupBy(*series_cols, "_blk").agg(*[
        F.min(F.when(F.col(p).isNotNull(), F.struct(F.col("pos").alias("i"), F.col(p).alias("v")))).alias(f"_f_{p}")
        for p in params])
    blks = bounds.select(*series_cols, F.explode(F.sequence(
        F.floor(F.col("_p0") / F.lit(block)).cast("bigint"),
        F.floor(F.col("_p1") / F.lit(block)).cast("bigint"))).alias("_blk"))
    first_in_blk = blks.join(first_in_blk, [*series_cols, "_blk"], "left")
    later = (Window.partitionBy(*series_cols) if series_cols else Window.partitionBy(F.lit(0)))
    later = later.orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = first_in_blk.select(
        *series_cols, "_blk",
        *[F.last(f"_f_{p}", ignorenulls=True).over(later).alias(f"_nx_{p}") for p in params])
    has = first_in_blk.groupBy(*series_cols).agg(
        *[F.max(F.col(f"_f_{p}").isNotNull()).alias(f"_has_{p}") for p in params])
    return join_series_stats(nxt, has, series_cols)


def gap_fill_expr(p: str, wb_back, wb_fwd, nx: Column | None, allow_backfill: bool = True) -> Column:
    """W7+W8 closed form of ``interpolate(linear, limit=6).ffill(limit=3).bfill()``.

    ``pv`` = nearest non-NULL (pos, value) at most 9 rows back, ``nv`` = first
    non-NULL at or after the row (inside the partition, else from a later
    block).  Present -> value; pv and nv -> linear between them for the first
    6 steps, the 6th point held for steps 7-9; only pv (trailing) -> pv;
    otherwise (leading gap, or more than 9 steps) -> nv (back fill).
    """
    s = F.when(F.col(p).isNotNull(), F.struct(F.col("pos").alias("i"), F.col(p).alias("v")))
    pv = F.last(s, ignorenulls=True).over(wb_back.rowsBetween(-GAP_LOOKBACK, 0))
    nv_in = F.last(s, ignorenulls=True).over(wb_fwd)
    nv = F.coalesce(nv_in, nx) if nx is not None else nv_in
    k = F.col("pos") - pv["i"]
    interp = pv["v"] + (nv["v"] - pv["v"]) * F.least(k, F.lit(INTERP_LIMIT)) / (nv["i"] - pv["i"])
    back = nv["v"] if allow_backfill else F.lit(None).cast("double")
    return (F.when(F.col(p).isNotNull(), F.col(p))
             .when(pv.isNotNull() & nv.isNotNull(), interp)
             .when(pv.isNotNull(), pv["v"])
             .otherwise(back))


def blocked_grid(hourly: DataFrame, parameters=None, series_cols=(), block: int = DEFAULT_BLOCK_HOURS,
                 halo: int = GAP_LOOKBACK, allow_backfill: bool = True, checkpoint: bool = True) -> DataFrame:
    """J1 + W7/W8 on blocks: the full hour spine of each series (from its first
    to its last hour with a reading), values left-aligned onto it and gap
    filled.  Returns own and halo rows with ``_blk``/``_own``, partitioned by
    (series, block); callers add more row windows in the same stage and keep
    ``_own`` rows at the end.

    The spine comes from per-series bounds (no cross join with a global hour
    list); the readings and the spine are unioned and aggregated per position
    after a single explicit ``(series, block)`` repartition, which also serves
    every window that follows.

    The hourly table feeds the spine bounds, the block summary and the grid;
    column pruning makes these three different plans (no exchange reuse), so
    with ``checkpoint`` it is written once to the shared checkpoint folder and
    the raw readings are scanned exactly once.  It holds at most
    ``#series x #hours`` rows.
    """
    params = list(parameters or PARAMETERS)
    h = hourly.select(*series_cols, hour_pos(F.col("hour")).alias("pos"), *params)
    if checkpoint:
        h = materialize(h)
    bounds = h.groupBy(*series_cols).agg(F.min("pos").alias("_p0"), F.max("pos").alias("_p1"))
    spine = bounds.select(*series_cols, F.explode(F.sequence("_p0", "_p1")).alias("pos"),
                          *[F.lit(None).cast("double").alias(p) for p in params])
    u = add_blocks(spine.unionByName(h), block, halo)
    u = u.repartition(*series_cols, "_blk")
    g = u.groupBy(*series_cols, "_blk", "pos").agg(*[F.max(p).alias(p) for p in params])
    g = g.withColumn("_own", F.col("_blk") == F.floor(F.col("pos") / F.lit(block)))
    summ = _next_value_summary(h, bounds, params, series_cols, block)
    g = g.join(summ, [*series_cols, "_blk"], "left")
    wb = block_window(series_cols)
    wf = Window.partitionBy(*series_cols, "_blk").orderBy(F.col("pos").desc()) \
               .rowsBetween(Window.unboundedPreceding, 0)
    filled = [gap_fill_expr(p, wb, wf, F.col(f"_nx_{p}"), allow_backfill).alias(p) for p in params]
    return g.select(*series_cols, "_blk", "_own", "pos", pos_hour(F.col("pos")).alias("datetime"),
                    *filled, *[F.col(f"_has_{p}") for p in params])


def gap_fill(hourly: DataFrame, parameters=None, series_cols=(), block: int = DEFAULT_BLOCK_HOURS,
             allow_backfill: bool = True, checkpoint: bool = True) -> DataFrame:
    """Public J1+W7+W8: gap-filled hourly wide table on the full spine."""
    params = list(parameters or PARAMETERS)
    g = blocked_grid(hourly, params, series_cols, block, GAP_LOOKBACK, allow_backfill, checkpoint)
    return g.filter("_own").select(*series_cols, "datetime", *params)


def hour_spine(hourly: DataFrame, parameters=None, series_cols=(), checkpoint: bool = True) -> DataFrame:
    """J1 alone: readings left-joined onto the full hour spine, gaps as NULL
    (the hourly table is checkpointed once, see ``blocked_grid``)."""
    params = list(parameters or PARAMETERS)
    h = hourly.select(*series_cols, hour_pos(F.col("hour")).alias("pos"), *params)
    if checkpoint:
        h = materialize(h)
    bounds = h.groupBy(*series_cols).agg(F.min("pos").alias("_p0"), F.max("pos").alias("_p1"))
    spine = bounds.select(*series_cols, F.explode(F.sequence("_p0", "_p1")).alias("pos"))
    out = spine.join(h, [*series_cols, "pos"], "left")
    return out.select(*series_cols, pos_hour(F.col("pos")).alias("datetime"), *params)
