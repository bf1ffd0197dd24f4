"""Run history: backtest runs, champion rule, upsert, dashboard reads
(W11, W13, L2, L3, L5, A14, A15, A21).

The ``runs`` table has one unified schema.  Runs are produced by Spark from
the data (a daily backtest), so the table grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.constants import BAND_MSE_IMPROVEMENT, BAND_R2, BAND_RMSE
from sensorspark.functions.metrics import compare_models


def backtest_runs(preds: DataFrame, baseline: str, candidate: str, data_path: str, rolling_days: int,
                  series_cols=(), persistence: str | None = None) -> DataFrame:
    """One run per series and calendar day with predictions: both models'
    metrics on that day's windows, improvements, claim flag, champion flag.
    ``run_ts`` is the end of the day (the run sees the whole day)."""
    day = F.to_date("ts")
    p = preds.withColumn("run_date", day)
    cmp = compare_models(p, "y", baseline, candidate, [*series_cols, "run_date"])
    if persistence:
        pr = p.groupBy(*series_cols, "run_date").agg(
            F.sqrt(F.avg(F.pow(F.col("y") - F.col(persistence), 2))).alias("persistence_rmse"))
        cmp = cmp.join(pr, [*series_cols, "run_date"], "left")
    else:
        cmp = cmp.withColumn("persistence_rmse", F.lit(None).cast("double"))
    ymd = F.date_format("run_date", "yyyyMMdd")
    runs = cmp.select(
        *series_cols,
        F.concat(F.lit("batch_"), ymd).alias("batch_id"),
        F.concat(F.lit("run_"), ymd).alias("run_id"),
        (F.col("run_date").cast("timestamp") + F.expr("INTERVAL 23 HOURS")).alias("run_ts"),
        F.lit(data_path).alias("data_path"), F.lit(int(rolling_days)).alias("rolling_days"),
        "n", *[c for c in cmp.columns if c.startswith(("baseline_", "candidate_"))],
        "mse_improvement_pct", "mae_improvement_pct", "rmse_improvement_pct",
        "persistence_rmse", "meets_claim")
    return champion_history(runs, series_cols)


def champion_history(runs: DataFrame, series_cols=(), metric: str = "candidate_rmse") -> DataFrame:
    """A run is promoted when its RMSE is strictly below the best of all
    earlier runs (infinity before the first).  The window runs over the runs
    table (one row per run), partitioned by series."""
    w = (Window.partitionBy(*series_cols) if series_cols else Window.partitionBy(F.lit(0)))
    w = w.orderBy("run_ts", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(metric).over(w)
    return runs.withColumn("promoted", F.col(metric) < F.coalesce(best, F.lit(float("inf"))))


def runs_upsert(existing: DataFrame, incoming: DataFrame, key=("run_id",), ts: str = "run_ts") -> DataFrame:
    """Key-based upsert: the union of both, latest ``run_ts`` wins per key
    (incoming wins a tie).  Written as a ``max_by`` aggregate so a key with
    many versions is merged map-side."""
    cols = existing.columns
    u = existing.withColumn("_src", F.lit(0)).unionByName(incoming.select(*cols).withColumn("_src", F.lit(1)))
    rest = [c for c in cols if c not in key]
    agg = u.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col(ts), F.col("_src"))).alias("_r"))
    return agg.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_runs(runs: DataFrame, n: int, cols, order: str = "run_ts", desc: bool = True) -> DataFrame:
    """L2: newest (or oldest) ``n`` runs -- TakeOrderedAndProject, no full sort."""
    o = F.col(order).desc() if desc else F.col(order).asc()
    return runs.orderBy(o, F.col("run_id").desc() if desc else F.col("run_id")).limit(int(n)).select(*cols)


def runs_summary(runs: DataFrame, metric: str = "candidate_rmse") -> DataFrame:
    """L3 + A21: latest run's and best run's metric and the true run count,
    one aggregate (``max_by``/``min_by``)."""
    return runs.agg(
        F.max_by(metric, F.struct("run_ts", "run_id")).alias("latest_rmse"),
        F.min_by(metric, F.struct(F.col(metric), F.col("run_id"))).alias("best_rmse"),
        F.min_by("run_id", F.struct(F.col(metric), F.col("run_id"))).alias("best_run_id"),
        F.count(F.lit(1)).cast("bigint").alias("total_runs"))


def status_band(col: Column, band) -> Column:
    """Threshold class (``value >= step`` moves to the next colour)."""
    lo, hi, colours = band
    return F.when(col.isNull(), None).when(col >= hi, colours[2]).when(col >= lo, colours[1]).otherwise(colours[0])


def run_status_bands(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "run_ts",
                       status_band(F.col("mse_improvement_pct"), BAND_MSE_IMPROVEMENT).alias("mse_improvement_status"),
                       status_band(F.col("candidate_rmse"), BAND_RMSE).alias("rmse_status"),
                       status_band(F.col("candidate_r2"), BAND_R2).alias("r2_status"))


def daily_metrics(preds: DataFrame, pred: str = "predicted", ts: str = "timestamp",
                  version: str = "model_version") -> DataFrame:
    """mean/min/max/count of predictions per day and model version."""
    return preds.groupBy(F.to_date(ts).alias("date"), version).agg(
        F.avg(pred).alias("avg_prediction"), F.min(pred).alias("min_prediction"),
        F.max(pred).alias("max_prediction"), F.count(F.lit(1)).cast("bigint").alias("predictions_count"))


def prediction_summary(preds: DataFrame, pred: str = "predicted", by=()) -> DataFrame:
    """Min, max, mean, population std of predictions."""
    return preds.groupBy(*by).agg(F.min(pred).alias("min"), F.max(pred).alias("max"),
                                  F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("std"),
                                  F.count(F.lit(1)).cast("bigint").alias("n"))
