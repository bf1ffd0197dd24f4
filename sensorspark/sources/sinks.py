"""Sinks (S4-S10): partitioned parquet, CSV and JSON writers.

Writers never overwrite a path that the same plan reads; outputs go to the
caller's location (on a cluster: shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.sources.run_store import commit_runs


def write_shards(df: DataFrame, root: str, shard_col: str = "shard", mode: str = "overwrite") -> None:
    """One folder per shard label (``shard=m_<start>_<end>``), rows
    time-sorted inside each file.  Rows are dealt by ranges of (shard, time),
    so a week that holds most readings is written by many tasks."""
    df.repartitionByRange(shard_col, "datetime").sortWithinPartitions(shard_col, "datetime") \
      .write.mode(mode).partitionBy(shard_col).parquet(root)


def write_merged(df: DataFrame, path: str, by_date: bool = True) -> None:
    """The merged table, partitioned by date so retention and incremental
    upserts touch whole partitions only."""
    out = df.withColumn("date", F.to_date("datetime")) if by_date else df
    w = out.write.mode("overwrite")
    (w.partitionBy("date") if by_date else w).parquet(path)


def write_splits(windows: DataFrame, path: str) -> None:
    """Windows with x (array of structs), scaled y, raw y and ts, one
    folder per split."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(df: DataFrame, path: str, csv: bool = True) -> None:
    """Predictions as parquet and a CSV mirror with a header."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def append_runs(runs: DataFrame, path: str, batch_id: str, csv: bool = True) -> bool:
    """Append a batch of run rows to the stored runs (``run_store``) and
    its CSV mirror; a batch that is retried is there once.  False where it was there."""
    new = commit_runs(runs, path, batch_id)
    if csv:
        runs.write.mode("overwrite" if new else "ignore").option("header", True).csv(f"{path}/csv/batch={batch_id}")
    return new


def write_json_report(df: DataFrame, path: str) -> None:
    """A (small, aggregated) report as JSON lines; nested columns such as
    a feature -> PSI map are kept as JSON objects.  One file, written after a
    shuffle, so the stages above keep their tasks."""
    df.repartition(1).write.mode("overwrite").json(path)


def drift_report_frame(summary: DataFrame, psi: DataFrame) -> DataFrame:
    """S9 payload: summary row plus the feature -> PSI map (built by an
    aggregate over the per-feature table, one entry per feature)."""
    m = psi.agg(F.map_from_entries(F.collect_list(F.struct("feature", "psi"))).alias("feature_psi"))
    return summary.withColumn("_k", F.lit(0)).join(m.withColumn("_k", F.lit(0)), "_k").drop("_k")


def export_runs_csv(runs: DataFrame, path: str, order: str = "run_ts") -> None:
    """Runs export newest first (a range-partitioned sort; each output
    file holds one range, files are in order)."""
    runs.orderBy(F.col(order).desc()).write.mode("overwrite").option("header", True).csv(path)
