"""Merge, dedup and incremental ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.constants import DEDUP_KEY, DEFAULT_ROLLING_DAYS


def merge_shards(frames: list[DataFrame]) -> DataFrame:
    """Union of tables of different shape by column name; missing columns
    become NULL.  Shards of one folder need no union: ``read_shards`` scans
    them as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Types whose aggregation buffers Spark updates in place, so that it can hash.
_FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.TimestampType,
          T.TimestampNTZType, T.DateType)


def _rank(df: DataFrame, order) -> Column | None:
    """One fixed-width value that sorts like ``order`` (at most two fixed-width
    columns; two are packed into 128 bits), or None."""
    types = [df.schema[c].dataType for c in order]
    if len(order) == 1 and isinstance(types[0], _FIXED):
        return F.col(order[0])
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if len(order) == 2 and all(isinstance(t, whole) for t in types):
        wide = lambda c: F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(str(-(1 << 63))).cast("decimal(38,0)"))
        return (wide(order[0]) * F.lit(str(1 << 64)).cast("decimal(20,0)") + wide(order[1])).cast("decimal(38,0)")
    return None


def dedup_first(df: DataFrame, key=None, order=("shard", "arrival"), dictionary=()) -> DataFrame:
    """Keep the first row of every ``key`` in ``order`` (shard, then
    arrival).

    An aggregate, not a ``row_number`` window: it is combined map-side, so a
    key with millions of copies sends one partial row per map task.  Missing
    order columns are skipped.  Where the order packs into one fixed-width rank
    (``_rank``), which must be unique among a key's rows, each fixed-width column is its own
    ``min_by`` and the plan is a hash aggregate without sorts.  String columns
    of few values, named in ``dictionary``, travel as 64-bit codes and are joined
    back to the survivors.  Otherwise ``min_by`` over structs (a sort
    aggregate) is taken, with the remaining columns breaking ties.
    """
    key = list(key or DEDUP_KEY)
    rest = [c for c in df.columns if c not in key]
    order_cols = [c for c in order if c in df.columns]
    coded = [c for c in rest if c in dictionary and isinstance(df.schema[c].dataType, T.StringType)]
    rank = _rank(df, order_cols)
    if rank is not None and all(c in coded or isinstance(df.schema[c].dataType, _FIXED) for c in rest):
        d = df.withColumn("_rank", rank) if len(order_cols) > 1 else df
        o = "_rank" if len(order_cols) > 1 else order_cols[0]
        code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c)))
        out = d.groupBy(*key).agg(*[F.min_by(code(c), o).alias(f"_code_{c}") if c in coded else F.min(c).alias(c) if c == o else F.min_by(c, o).alias(c) for c in rest])
        if coded:
            words = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), code(c).alias("code"), F.col(c).alias("word")) for c in coded])).alias("w")
            words = df.select(words).select("w.*").filter("code IS NOT NULL").distinct()
            for c in coded:
                out = out.join(words.filter(F.col("column") == c).select(F.col("code").alias(f"_code_{c}"), F.col("word").alias(c)), f"_code_{c}", "left")
        return out.select(*key, *rest)
    tie = [c for c in rest if c not in order_cols]
    ord_struct = F.struct(*[F.col(c) for c in order_cols + tie])
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None)
    agg = df.groupBy(*key).agg(F.min_by(row, ord_struct).alias("_r"))
    return agg.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicate_count(df: DataFrame, key=None) -> DataFrame:
    """Rows removed by keep-first dedup = rows - distinct keys."""
    key = list(key or DEDUP_KEY)
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).cast("bigint").alias("rows_after"),
        (F.sum("_n") - F.count(F.lit(1))).cast("bigint").alias("duplicates_removed"))


def new_rows(incoming: DataFrame, stored: DataFrame, key=None) -> DataFrame:
    """Incoming rows whose key is not stored yet (left anti join)."""
    key = list(key or DEDUP_KEY)
    return incoming.join(stored.select(*key).distinct(), key, "left_anti")


def shard_contribution(shards: DataFrame, as_of, rolling_days: int, shard_col: str = "shard") -> DataFrame:
    """Per shard its original row count and first/last reading date,
    reported only for shards with at least one reading inside the retention
    window.  One aggregate; the retention test is a conditional count."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(rolling_days))
    g = shards.groupBy(shard_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("original_rows"),
        F.to_date(F.min("datetime")).alias("first_date"),
        F.to_date(F.max("datetime")).alias("last_date"),
        F.count(F.when(F.col("datetime") >= cutoff, 1)).cast("bigint").alias("retained_rows"))
    return g.filter(F.col("retained_rows") > 0)


def fetch_plan(shards: DataFrame, now, force: bool = False, first_days: int = DEFAULT_ROLLING_DAYS, label: Column | None = None) -> DataFrame:
    """T1/T2 decision, one row: what the next ingest should fetch.

    ``fetch_start`` is the last reading's time, or ``first_days`` before ``now``
    where nothing is stored; less than a whole day is skipped, and so is a
    span whose shard label is stored already, unless ``force``.  ``status`` is
    ``fetch``, ``skipped`` (too recent) or ``stored``.
    """
    now = F.lit(now).cast("timestamp")
    last = shards.agg(F.max("datetime").alias("_last"), F.collect_set("shard").alias("_labels"))   # one label a shard
    start = F.coalesce("_last", now - F.make_interval(days=F.lit(int(first_days))))
    days = F.floor((F.unix_timestamp("fetch_end") - F.unix_timestamp("fetch_start")) / 86400).cast("bigint")
    name = label if label is not None else F.concat(F.lit("m_"), F.date_format("fetch_start", "yyyyMMdd"), F.lit("_"), F.date_format("fetch_end", "yyyyMMdd"))
    p = last.withColumn("fetch_start", start).withColumn("fetch_end", now).withColumn("days", days).withColumn("label", name)
    status = F.when(F.lit(bool(force)), "fetch").when(F.col("days") < 1, "skipped").when(
        F.array_contains("_labels", F.col("label")), "stored").otherwise("fetch")
    return p.select("fetch_start", "fetch_end", "days", "label", status.alias("status"))
