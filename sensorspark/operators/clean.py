"""Projections, filters, predicates and casts."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorspark.constants import (COUNTRY_IDS, MAX_RADIUS_M, PARAMETERS,
                                   REQUIRED_COLUMNS, UNIT_MAP)


def unit_lookup(param: Column, unit_map: dict | None = None) -> Column:
    """F8: unit by parameter from a literal map (NULL for unknown parameters)."""
    m = unit_map or UNIT_MAP
    lit_map = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(lit_map, param)


def to_utc(c: Column, source_tz: str | None = None, instant: bool = False) -> Column:
    """event time as a UTC instant (under a UTC session).

    Strings are parsed as ISO-8601 and an explicit offset (``Z``, ``+05:30``)
    wins; naive values (timestamp_ntz or strings without offset) are read as
    ``source_tz`` (default UTC).  ``instant``: the column is a timestamp with
    time zone already, which no source zone shifts.
    """
    if instant:
        return c.cast("timestamp")
    t = F.to_timestamp(c)
    if not source_tz or source_tz == "UTC":
        return t
    own_offset = c.cast("string").rlike("[T ][0-9:.]+ ?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    return F.when(own_offset, t).otherwise(F.to_utc_timestamp(t, source_tz))


def standardize(df: DataFrame, source_tz: str | None = None) -> DataFrame:
    """UTC event time, unit filled by parameter when the column is absent,
    location as string, coordinates as double.

    The time sort of the original is not a global ``orderBy`` here: it would
    cost a range shuffle and nothing downstream depends on row order; the
    shard writer sorts inside its files.
    """
    instant = isinstance(df.schema["datetime"].dataType, T.TimestampType)
    unit_col = F.col("unit").cast("string") if "unit" in df.columns else unit_lookup(F.col("parameter"))
    keep = [c for c in df.columns if c not in REQUIRED_COLUMNS]
    return df.select(
        to_utc(F.col("datetime"), source_tz, instant).alias("datetime"),
        F.col("value").cast("double").alias("value"),
        F.col("parameter").cast("string").alias("parameter"),
        unit_col.alias("unit"),
        F.col("location").cast("string").alias("location"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        *keep)


def retention_filter(df: DataFrame, as_of: str | datetime, days: int, col: str = "datetime") -> DataFrame:
    """Keep readings with ``col >= as_of - days``.  The bound is a literal,
    so it is pushed into the parquet scan."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return df.filter(F.col(col) >= cutoff)


def param_filter(df: DataFrame, parameters=None, col: str = "parameter") -> DataFrame:
    """Case-insensitive allow-list, parameter names lower-cased."""
    allowed = [p.lower() for p in (parameters or PARAMETERS)]
    return df.withColumn(col, F.lower(F.col(col))).filter(F.col(col).isin(allowed))


def bbox_filter(df: DataFrame, bbox=None, limit: int | None = None) -> DataFrame:
    """Readings inside (lon_min, lat_min, lon_max, lat_max).

    With ``limit`` only the first ``limit`` distinct locations by name: a
    top-N (TakeOrderedAndProject: per-partition top N, then a merge of N rows
    per partition), so the semi join broadcasts at most ``limit`` rows.
    """
    from sensorspark.constants import CITY_BBOX
    lon_min, lat_min, lon_max, lat_max = bbox or CITY_BBOX
    inside = df.filter(F.col("longitude").between(lon_min, lon_max)
                       & F.col("latitude").between(lat_min, lat_max))
    if not limit:
        return inside
    locs = inside.select("location").distinct().orderBy("location").limit(int(limit))
    return inside.join(F.broadcast(locs), "location", "left_semi")


def haversine_m(lat1: Column, lon1: Column, lat2: float, lon2: float) -> Column:
    """Great-circle distance in metres (mean Earth radius 6,371,008.8 m)."""
    r = 6371008.8
    p1, p2 = F.radians(lat1), F.lit(math.radians(lat2))
    dphi = F.radians(lat1 - F.lit(lat2))
    dl = F.radians(lon1 - F.lit(lon2))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * r) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def radius_filter(df: DataFrame, lat: float, lon: float, radius_m: float = MAX_RADIUS_M) -> DataFrame:
    """P5: readings within ``radius_m`` (at most 25 km) of a centre point."""
    if not 0 <= float(radius_m) <= MAX_RADIUS_M:
        raise ValueError(f"radius_m must lie between 0 and {MAX_RADIUS_M}, not {radius_m}")
    return df.filter(haversine_m(F.col("latitude"), F.col("longitude"), lat, lon) <= F.lit(float(radius_m)))


def country_codes(spark: SparkSession) -> DataFrame:
    """The ISO-code -> country id table (fixed, 12 rows)."""
    return spark.createDataFrame(sorted(COUNTRY_IDS.items()), "iso string, country_id int")


def country_filter(df: DataFrame, codes: DataFrame, iso_codes, id_col: str) -> DataFrame:
    """Rows whose ``id_col`` is the country id of one of ``iso_codes``,
    matched case-insensitively.  The code table has a fixed size, so it is
    broadcast."""
    wanted = [c.upper() for c in iso_codes]
    sel = codes.filter(F.upper("iso").isin(wanted)).select(F.col("country_id").alias(id_col))
    return df.join(F.broadcast(sel), id_col, "left_semi")


def sensor_range_topn(df: DataFrame, start, end, limit: int | None = None,
                      sensor_col: str = "sensor_id", ts_col: str = "datetime",
                      tie_col: str | None = "arrival") -> DataFrame:
    """Readings of each sensor in [start, end]; optionally the first
    ``limit`` per sensor in time order.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle (n below ``spark.sql.optimizer.windowGroupLimitThreshold``), so a
    sensor holding most rows ships only n rows per map task.
    """
    out = df.filter(F.col(ts_col).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if not limit:
        return out
    order = [F.col(ts_col)] + ([F.col(tie_col)] if tie_col else [])
    w = Window.partitionBy(sensor_col).orderBy(*order)
    return out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def numeric_columns(df: DataFrame) -> list[str]:
    """The PSI-eligible numeric columns (double, float, bigint, int)."""
    ok = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ok)]


def validate_columns(df: DataFrame, required=None) -> list[str]:
    """P10: missing required columns (empty list = valid).  Schema only, no job."""
    need = list(required or REQUIRED_COLUMNS)
    return [c for c in need if c not in df.columns]


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` also present in ``b``, in ``a``'s order."""
    bs = set(b.columns)
    return [c for c in a.columns if c in bs]


def column_set_diff(a: DataFrame, b: DataFrame) -> dict:
    """Column-set equality and differences (schema only)."""
    sa, sb = set(a.columns), set(b.columns)
    return {"match": sa == sb, "only_left": sorted(sa - sb), "only_right": sorted(sb - sa)}
