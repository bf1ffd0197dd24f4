"""Registered streaming queries.  Each runs its stream over all files of the
table into a table under the shared folder and returns its present rows, the
newest readings and hours included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.constants import PARAMETERS
from sensorspark.plans.catalog import AS_OF, RETENTION_DAYS, finalize
from sensorspark.session import ensure_utc
from sensorspark.streaming import ingest as ST


def _run(spark: SparkSession, name: str, df: DataFrame, mode: str = "append") -> DataFrame:
    d = ST.new_run_dir(spark, name)
    ST.run_to_parquet(df, f"{d}/out", f"{d}/ckpt", mode)
    return spark.read.parquet(f"{d}/out")


def q_stream_ingest(spark, sf):
    ensure_utc(spark)
    out = _run(spark, "ingest", ST.stream_measurements(spark, sf))
    return out.groupBy("parameter").agg(F.count(F.lit(1)).alias("rows"), F.max("datetime").alias("watermark"))


def q_stream_dedup(spark, sf):
    ensure_utc(spark)
    m = ST.stream_measurements(spark, sf, PARAMETERS)
    return ST.run_dedup(spark, m, ST.new_run_dir(spark, "dedup")).select("datetime", "parameter", "location", "value", "arrival")


def q_stream_hourly(spark, sf):
    """Every hour, the newest ones as far as their readings came."""
    ensure_utc(spark)
    m = ST.stream_measurements(spark, sf, PARAMETERS)
    return ST.run_hourly(spark, m, ST.new_run_dir(spark, "hourly"), PARAMETERS)


def q_stream_sliding(spark, sf):
    """24, 48 and 72 h mean and std of the gap-filled hours."""
    ensure_utc(spark)
    m = ST.stream_measurements(spark, sf, PARAMETERS)
    return ST.run_sliding(spark, m, ST.new_run_dir(spark, "sliding"), PARAMETERS)


def q_stream_sliding_panel(spark, sf):
    """The same by location."""
    ensure_utc(spark)
    m = ST.stream_measurements(spark, sf, PARAMETERS)
    return ST.run_sliding(spark, m, ST.new_run_dir(spark, "sliding"), PARAMETERS, series_cols=("location",))


def q_stream_late(spark, sf):
    """Retention, then keep-first dedup, whose watermark bounds lateness."""
    ensure_utc(spark)
    m = ST.late_filter(ST.stream_measurements(spark, sf, PARAMETERS), AS_OF, RETENTION_DAYS)
    return ST.run_dedup(spark, m, ST.new_run_dir(spark, "late")).select("datetime", "parameter", "location", "arrival")


def q_stream_upsert(spark, sf):
    ensure_utc(spark)
    d = ST.new_run_dir(spark, "upsert")
    ST.run_upsert(ST.stream_measurements(spark, sf, PARAMETERS), f"{d}/merged", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/merged").select("datetime", "parameter", "location", "value", "arrival")


QUERIES = {
    "stream_ingest": q_stream_ingest,
    "stream_dedup": q_stream_dedup,
    "stream_hourly": q_stream_hourly,
    "stream_sliding": q_stream_sliding,
    "stream_sliding_panel": q_stream_sliding_panel,
    "stream_late": q_stream_late,
    "stream_upsert": q_stream_upsert,
}


def registered() -> dict:
    def wrap(fn):
        def run(spark, sf_dir):
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        return run
    return {k: wrap(v) for k, v in QUERIES.items()}
