"""Time blocks with halo rows: long series windows without a hot partition.

Row windows over an hourly series (lags, rolling frames, gap fill, sliding
windows) only look a bounded number of rows back.  Instead of
``Window.partitionBy(series)`` -- one task per series, and a single task for
the pooled city series -- every hour is assigned to a fixed block of
``block`` hours (aligned to the epoch, so no per-series bounds are needed)
and the last ``halo`` hours of each block are copied into the next block.
A window partitioned by ``(series, block)`` then sees every row it needs,
the work of one series is spread over ``#hours / block`` tasks, and halo
copies cost ``halo / block`` extra rows.  Only rows of the block itself
(``_own``) are kept afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_BLOCK_HOURS = 720   # 30 days per task per series


def hour_pos(ts: Column) -> Column:
    """Hours since the epoch (bigint): position on the hourly grid."""
    return F.floor(F.unix_timestamp(ts) / F.lit(3600)).cast("bigint")


def pos_hour(pos: Column) -> Column:
    return F.timestamp_seconds(pos * F.lit(3600))


def add_blocks(df: DataFrame, block: int, halo: int, pos_col: str = "pos") -> DataFrame:
    """Add ``_blk`` (the block this copy belongs to) and ``_own`` (the row
    lies in that block).  A row is also copied into every later block whose
    first ``halo`` preceding positions include it, i.e. blocks
    ``b+1 .. floor((pos + halo) / block)``."""
    p = F.col(pos_col)
    b = F.floor(p / F.lit(block)).cast("bigint")
    last = F.floor((p + F.lit(int(halo))) / F.lit(block)).cast("bigint")
    return (df.withColumn("_blk", F.explode(F.sequence(b, last)))
              .withColumn("_own", F.col("_blk") == b))


def block_window(series_cols, pos_col: str = "pos"):
    return Window.partitionBy(*series_cols, "_blk").orderBy(pos_col)


def series_window(series_cols):
    """Window over whole series.  Only used on per-block summaries (one row per
    block), never on row-level data."""
    return Window.partitionBy(*series_cols) if series_cols else Window.partitionBy(F.lit(0))


def join_series_stats(df: DataFrame, stats: DataFrame, series_cols) -> DataFrame:
    """Attach per-series aggregates.  The pooled series has exactly one stats
    row, so it is broadcast; per-series tables are joined on the key and left
    to AQE, which broadcasts them once their real size is known."""
    if series_cols:
        return df.join(stats, list(series_cols), "left")
    one = stats.withColumn("_one", F.lit(0))
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one", "left").drop("_one")


def series_rank(df: DataFrame, series_cols=(), pos_col: str = "pos", out: str = "_rank", block: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """The 0-based rank of each row in its series by ``pos_col``, holes or not:
    the rows of all earlier blocks (a running sum over one row per block)
    plus the row number inside the block.  Positions are unique in a series."""
    b = df.withColumn("_rb", F.floor(F.col(pos_col) / F.lit(block)).cast("bigint"))
    sums = b.groupBy(*series_cols, "_rb").agg(F.count(F.lit(1)).alias("_rn"))
    before = series_window(series_cols).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(*series_cols, "_rb", F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_ro"))
    inside = F.row_number().over(Window.partitionBy(*series_cols, "_rb").orderBy(pos_col))
    return b.join(offs, [*series_cols, "_rb"]).withColumn(out, F.col("_ro") + inside - 1).drop("_rb", "_ro")
