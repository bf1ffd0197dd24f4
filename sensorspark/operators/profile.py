"""Data profiles (A4-A7, J5, F12-F14): single aggregates, no driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.constants import SHORT_SPAN_DAYS


def span_profile(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """First and last reading, span in whole days, short-span flag."""
    g = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).cast("bigint").alias("rows"))
    days = F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / F.lit(86400)).cast("bigint")
    return g.withColumn("span_days", days).withColumn("short_span", F.col("span_days") < SHORT_SPAN_DAYS)


def distinct_dims(df: DataFrame, dims=("parameter", "location")) -> DataFrame:
    """A5: distinct values of each dimension, one row per (dimension, value).
    ``distinct`` is a two-phase aggregate; nothing is collected."""
    kv = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                             for d in dims])).alias("_kv")
    return df.select(kv).select("_kv.dimension", "_kv.value").where(F.col("value").isNotNull()).distinct()


def availability(df: DataFrame, by=("parameter",)) -> DataFrame:
    """Earliest, latest reading and record count per group."""
    return df.groupBy(*by).agg(F.min("datetime").alias("earliest"), F.max("datetime").alias("latest"),
                               F.count(F.lit(1)).cast("bigint").alias("records"))


def profile_compare(original: DataFrame, merged: DataFrame, by: str = "parameter") -> DataFrame:
    """Per parameter, the value ranges of two datasets (only where
    both have rows: full outer join of two aggregates, ranges NULL on the
    missing side), plus whether the merged data reaches later than the
    original ("has newer data") and starts later ("coverage note")."""
    a = original.groupBy(by).agg(F.min("value").alias("orig_min"), F.max("value").alias("orig_max"),
                                 F.min("datetime").alias("orig_first"), F.max("datetime").alias("orig_last"))
    b = merged.groupBy(by).agg(F.min("value").alias("merged_min"), F.max("value").alias("merged_max"),
                               F.min("datetime").alias("merged_first"), F.max("datetime").alias("merged_last"))
    j = a.join(b, by, "full_outer")
    both = F.col("orig_min").isNotNull() & F.col("merged_min").isNotNull()
    return j.select(
        by, both.alias("in_both"),
        *[F.when(both, F.col(c)).alias(c) for c in ("orig_min", "orig_max", "merged_min", "merged_max")],
        (F.col("merged_last") > F.col("orig_last")).alias("has_newer"),
        (F.col("merged_first") > F.col("orig_first")).alias("starts_later"))
