"""Chronological split, latest windows and scalers.

Per-series counts come from small aggregates joined back (one row per
series), never from ``count() over (partition by series)`` on row-level data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.constants import LATEST_WINDOWS, SEQ_LENGTH, TRAIN_FRAC, VAL_FRAC
from sensorspark.operators.blocks import DEFAULT_BLOCK_HOURS, add_blocks, block_window, join_series_stats, series_rank


def split_sizes(n):
    """W6 closed form on a count column: int(n*0.70), int(n*0.15) in double."""
    n_train = F.floor(n.cast("double") * F.lit(float(TRAIN_FRAC))).cast("bigint")
    n_val = F.floor(n.cast("double") * F.lit(float(VAL_FRAC))).cast("bigint")
    return n_train, n_val


def chrono_split(windows: DataFrame, series_cols=(), pos_col: str = "pos") -> DataFrame:
    """First int(n*0.70) windows of a series -> train, next int(n*0.15) ->
    val, rest -> test; n counted per series.  The index is the window's rank
    in its series, so hours without a window make no difference."""
    stats = windows.groupBy(*series_cols).agg(F.count(F.lit(1)).alias("_nw"))
    n_train, n_val = split_sizes(F.col("_nw"))
    stats = stats.select(*series_cols, n_train.alias("_ntr"), n_val.alias("_nva"))
    out = join_series_stats(series_rank(windows, series_cols, pos_col, "widx"), stats, series_cols)
    idx = F.col("widx")
    split = (F.when(idx < F.col("_ntr"), "train")
              .when(idx < F.col("_ntr") + F.col("_nva"), "val")
              .otherwise("test"))
    return out.withColumn("widx", idx.cast("bigint")).withColumn("split", split).drop("_ntr", "_nva")


def split_summary(split_windows: DataFrame, series_cols=()) -> DataFrame:
    """Rows and first/last window time per split."""
    return split_windows.groupBy(*series_cols, "split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def window_summary(windows: DataFrame, series_cols=(), col: str = "y") -> DataFrame:
    """Mean, population std, min, max of the window targets."""
    return windows.groupBy(*series_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(col).alias("y_mean"),
        F.stddev_pop(col).alias("y_std"), F.min(col).alias("y_min"), F.max(col).alias("y_max"))


def latest_windows(windows: DataFrame, n: int = LATEST_WINDOWS, series_cols=(), ts_col: str = "ts") -> DataFrame:
    """The last ``n`` windows of each series (n is the feature: a top-k).
    ``row_number() <= n`` gets a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*series_cols).orderBy(F.col(ts_col).desc()) if series_cols \
        else Window.partitionBy(F.lit(0)).orderBy(F.col(ts_col).desc())
    return windows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def train_weights(features: DataFrame, seq_length: int = SEQ_LENGTH, series_cols=(), pos_col: str = "pos",
                  block: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """(series, pos, w): how many train windows hold each feature row.  A
    window belongs to every row whose ``seq_length`` preceding hours are all
    there; the first int(n*0.70) of them train.  Works on positions alone, in
    time blocks: a window's row is copied to the blocks of the rows it holds,
    which count it with a range frame."""
    T = int(seq_length)
    p = features.select(*series_cols, F.col(pos_col).alias("pos"))
    fr = block_window(series_cols).rowsBetween(-T, -1)
    w = add_blocks(p, block, T).select(*series_cols, "pos", "_own", F.count(F.lit(1)).over(fr).alias("_n"), F.min("pos").over(fr).alias("_p0"))
    w = w.filter(F.col("_own") & (F.col("_n") == T) & (F.col("_p0") == F.col("pos") - T)).select(*series_cols, "pos")
    train = chrono_split(w, series_cols).filter("split = 'train'")
    blk = lambda x: F.floor(x / F.lit(block)).cast("bigint")
    marks = train.select(*series_cols, "pos", F.lit(1).alias("_t"), F.explode(F.sequence(blk(F.col("pos") - T), blk(F.col("pos") - 1))).alias("_blk"))
    rows = p.select(*series_cols, "pos", F.lit(0).alias("_t"), blk(F.col("pos")).alias("_blk"))
    ahead = Window.partitionBy(*series_cols, "_blk").orderBy("pos").rangeBetween(1, T)
    both = rows.unionByName(marks).withColumn("_w", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).cast("double"))
    return both.filter("_t = 0 AND _w > 0").select(*series_cols, F.col("pos").alias(pos_col), "_w")


def is_constant(var, mean, n):
    """Whether a variance is only rounding: relative to the mean and the
    number of values (double precision), not to a fixed bound."""
    eps = F.lit(2.0 ** -52)
    return var <= n * eps * var + F.pow(n * eps * mean, F.lit(2.0))


def fit_feature_scaler(features: DataFrame, columns, seq_length: int = SEQ_LENGTH, series_cols=(),
                       pos_col: str = "pos") -> DataFrame:
    """Per-feature mean and population std exactly as a scaler fitted on
    the train windows' rows stacked (N_train x T rows), without exploding the
    windows: each feature row weighs as many times as train windows hold it
    (``train_weights``).  Two wide aggregates, all columns at once (mean, then
    weighted squared deviations, for numerical safety); constant -> scale 1.
    Output: (series..., feature, mean, scale)."""
    cols = list(columns)
    f = features.join(train_weights(features, seq_length, series_cols, pos_col), [*series_cols, pos_col])
    x = {c: F.col(c).cast("double") for c in cols}
    here = {c: F.when(F.col(c).isNotNull(), F.col("_w")) for c in cols}
    means = f.groupBy(*series_cols).agg(*[(F.sum(here[c] * x[c]) / F.sum(here[c])).alias(f"_m_{i}") for i, c in enumerate(cols)])
    f = join_series_stats(f, means, series_cols)
    dev = f.groupBy(*series_cols).agg(
        *[F.first(f"_m_{i}").alias(f"_m_{i}") for i in range(len(cols))],
        *[(F.sum(here[c] * F.pow(x[c] - F.col(f"_m_{i}"), 2)) / F.sum(here[c])).alias(f"_v_{i}") for i, c in enumerate(cols)],
        *[F.sum(here[c]).alias(f"_n_{i}") for i, c in enumerate(cols)])
    long = dev.select(*series_cols, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_m_{i}").alias("mean"), F.col(f"_v_{i}").alias("var"), F.col(f"_n_{i}").alias("n"))
        for i, c in enumerate(cols)])).alias("s")).select(*series_cols, "s.*").filter("mean IS NOT NULL")
    scale = F.when(is_constant(F.col("var"), F.col("mean"), F.col("n")), F.lit(1.0)).otherwise(F.sqrt("var"))
    return long.select(*series_cols, "feature", "mean", scale.alias("scale"))


def fit_target_scaler(split_windows: DataFrame, series_cols=(), col: str = "y") -> DataFrame:
    """A16 for the target: mean and population std of y over train windows."""
    tr = split_windows.filter(F.col("split") == "train")
    constant = is_constant(F.var_pop(col), F.avg(col), F.count(col).cast("double"))
    return tr.groupBy(*series_cols).agg(
        F.avg(col).alias("y_mean"),
        F.when(constant, F.lit(1.0)).otherwise(F.stddev_pop(col)).alias("y_scale"))


def scale_features(features: DataFrame, scaler: DataFrame, columns, series_cols=()) -> DataFrame:
    """Z-score every feature column with the fitted scaler.  The long
    scaler is pivoted to one row per series (fixed feature list, no distinct
    job) and joined on the series key (broadcast for the pooled series)."""
    wide = scaler.groupBy(*series_cols).pivot("feature", list(columns)).agg(
        F.first("mean").alias("m"), F.first("scale").alias("s"))
    f = join_series_stats(features, wide, series_cols)
    scaled = [((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(c) for c in columns]
    keep = [c for c in features.columns if c not in set(columns)]
    return f.select(*keep, *scaled)


def scale_target(df: DataFrame, target_scaler: DataFrame, series_cols=(), col: str = "y",
                 out: str = "y_scaled") -> DataFrame:
    f = join_series_stats(df, target_scaler, series_cols)
    return f.withColumn(out, (F.col(col) - F.col("y_mean")) / F.col("y_scale")).drop("y_mean", "y_scale")


def inverse_transform(df: DataFrame, target_scaler: DataFrame, series_cols=(), col: str = "pred_scaled",
                      out: str = "pred") -> DataFrame:
    """F4 inverse: raw units = scaled * scale + mean."""
    f = join_series_stats(df, target_scaler, series_cols)
    return f.withColumn(out, F.col(col) * F.col("y_scale") + F.col("y_mean")).drop("y_mean", "y_scale")
