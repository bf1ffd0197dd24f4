"""Measurement sources (S1, S2, S3 and the test-data view).

All scans declare their schema, convert NaN to NULL (pandas skips NaN in its
aggregates, Spark does not) and turn the event time into a session-UTC
``timestamp`` so watermarks and hour truncation work.  Column pruning and
filter pushdown reach the parquet reader because nothing here forces a
materialisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.constants import EVENT_PARAMETER

MEASUREMENT_SCHEMA = T.StructType([
    T.StructField("datetime", T.TimestampType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("parameter", T.StringType(), True),
    T.StructField("unit", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
])


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL so averages and comparisons follow pandas' skip-NaN rule."""
    return F.when(~F.isnan(c), c)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_measurements(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a measurement parquet (file, directory or glob) with a fixed schema."""
    df = spark.read.schema(schema or MEASUREMENT_SCHEMA).parquet(path)
    return clean_measurements(df)


def clean_measurements(df: DataFrame) -> DataFrame:
    """NaN -> NULL on doubles and ``timestamp`` event time, for any long table."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out.withColumn(f.name, nan_to_null(F.col(f.name)))
    if "datetime" in df.columns and not isinstance(df.schema["datetime"].dataType, T.TimestampType):
        out = out.withColumn("datetime", F.col("datetime").cast("timestamp"))
    return out


def floor_seconds(ts: Column, seconds: int) -> Column:
    """Floor a timestamp to a multiple of ``seconds`` since the epoch."""
    u = F.unix_timestamp(ts)
    return F.timestamp_seconds(u - F.pmod(u, F.lit(seconds)))


def events_measurements(spark: SparkSession, sf_dir: str, with_ids: bool = True, since=None, until=None,
                        parameters=None) -> DataFrame:
    """Measurement view over the test ``events`` table.

    datetime = ts floored to 10 minutes (creates duplicate keys), parameter
    from the event type, location ``loc_<user_id % 10>`` with fixed
    coordinates; ``sensor_id``/``arrival`` carry user_id/event_id so
    keep-first dedup is deterministic.

    ``since``/``until`` (bounds on ``datetime``) and ``parameters`` are also put
    on the stored columns, so that they reach the parquet scan: the floored
    time is at least a multiple of 10 minutes only if the stored time is, and
    at most ``until`` only if the stored time is below the next multiple.
    """
    ev = read_table(spark, sf_dir, "events")
    if since is not None:
        ev = ev.filter(F.col("ts") >= F.lit(str(since)).cast("timestamp_ntz"))
    if until is not None:
        ev = ev.filter(F.col("ts") < F.lit(str(until)).cast("timestamp_ntz") + F.expr("INTERVAL 10 MINUTES"))
    if parameters is not None:
        ev = ev.filter(F.col("event_type").isin([e for e, p in EVENT_PARAMETER.items() if p in set(parameters)]))
    m = measurement_view(ev)
    if since is not None:
        m = m.filter(F.col("datetime") >= F.lit(str(since)).cast("timestamp"))
    if until is not None:
        m = m.filter(F.col("datetime") <= F.lit(str(until)).cast("timestamp"))
    return m if with_ids else m.drop("sensor_id", "arrival")


def measurement_view(ev: DataFrame) -> DataFrame:
    """The measurement columns of ``events`` rows (a table or a stream)."""
    k = F.pmod(F.col("user_id"), F.lit(10))
    param = F.lit(None).cast("string")
    for et, p in reversed(list(EVENT_PARAMETER.items())):
        param = F.when(F.col("event_type") == et, F.lit(p)).otherwise(param)
    return ev.select(
        floor_seconds(F.col("ts").cast("timestamp"), 600).alias("datetime"),
        nan_to_null(F.col("value")).alias("value"),
        param.alias("parameter"),
        F.concat(F.lit("loc_"), k.cast("string")).alias("location"),
        (F.lit(28.3) + F.lit(0.07) * k).alias("latitude"),
        (F.lit(76.7) + F.lit(0.08) * k).alias("longitude"),
        F.col("user_id").alias("sensor_id"), F.col("event_id").alias("arrival"))


def week_shards(df: DataFrame, overlap_days: int = 1) -> DataFrame:
    """Assign each reading to its calendar-week shard and copy readings of the
    first ``overlap_days`` of a week into the previous week's shard too
    (neighbouring fetches overlap).  ``shard`` is the shard label
    ``m_<start yyyyMMdd>_<end yyyyMMdd>``; name order is time order."""
    wk = F.date_trunc("week", F.col("datetime"))
    prev_wk = F.date_sub(F.to_date(wk), 7)
    in_overlap = F.col("datetime") < F.date_trunc("week", F.col("datetime")) + F.expr(f"INTERVAL {overlap_days} DAYS")
    starts = F.when(in_overlap, F.array(F.to_date(wk), prev_wk)).otherwise(F.array(F.to_date(wk)))
    out = df.withColumn("_ws", F.explode(starts))
    label = F.concat(F.lit("m_"), F.date_format("_ws", "yyyyMMdd"), F.lit("_"),
                     F.date_format(F.date_add("_ws", 7 + overlap_days), "yyyyMMdd"))
    return out.withColumn("shard", label).drop("_ws")


def shard_number(label: Column) -> Column:
    """A number that sorts like the shard label ``m_<start>_<end>``; NULL for
    any other name."""
    day = lambda at: F.unix_date(F.try_to_timestamp(F.substring(label, at, 8), F.lit("yyyyMMdd")).cast("date")).cast("bigint")
    return day(3) * 1_000_000 + day(12)


def read_shards(spark: SparkSession, root: str, glob: str = "m_*", schema: T.StructType | None = None,
                skip_corrupt: bool = False) -> DataFrame:
    """Every shard that ``write_shards`` put under ``root`` whose label
    matches ``glob``; ``shard`` is the folder's label, for keep-first ordering.

    The label is a partition column, so a filter on it prunes whole shards.  A
    file that can't be read fails the job; with ``skip_corrupt`` it is left
    out, and ``unread_files`` names what was.
    """
    schema = schema or MEASUREMENT_SCHEMA
    if "shard" not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField("shard", T.StringType())])
    df = (spark.read.schema(schema).option("basePath", root)
          .option("ignoreCorruptFiles", str(bool(skip_corrupt)).lower())
          .parquet(f"{root.rstrip('/')}/shard={glob}"))
    return clean_measurements(df)


def unread_files(spark: SparkSession, root: str, glob: str = "m_*") -> list[str]:
    """The shard files that ``read_shards(skip_corrupt=True)`` gets no row
    from: unreadable or empty."""
    one = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(
        f"{root.rstrip('/')}/shard={glob}").select(one(F.col("path")).alias("path"))
    read = spark.read.schema(MEASUREMENT_SCHEMA).option("ignoreCorruptFiles", "true").parquet(f"{root.rstrip('/')}/shard={glob}")
    got = read.select(one(F.col("_metadata.file_path")).alias("path")).distinct()
    return sorted(r.path for r in there.join(got, "path", "left_anti").collect())


PAYLOAD_SCHEMA = T.StructType([
    T.StructField("location", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("coordinates", T.StructType([
            T.StructField("latitude", T.DoubleType()),
            T.StructField("longitude", T.DoubleType())]))])),
    T.StructField("sensor", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("parameter", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("units", T.StringType())]))])),
    T.StructField("measurements", T.ArrayType(T.StructType([
        T.StructField("value", T.DoubleType()),
        # datetimeFrom is either an object {"utc": ..} or a plain string: keep raw JSON
        T.StructField("period", T.StructType([T.StructField("datetimeFrom", T.StringType())]))]))),
])


def flatten_payloads(payloads: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """S3: nested landed payloads (one row per location x sensor with an array
    of measurements) -> long measurement rows.

    ``datetimeFrom`` may be an object with ``utc`` or a scalar string; rows
    without a time are skipped; parameter names are lower-cased and filtered
    by the allow-list.  Pure ``explode`` + JSON path expressions: no Python.
    """
    m = payloads.select(
        F.col("location.name").alias("location"),
        F.col("location.coordinates.latitude").alias("latitude"),
        F.col("location.coordinates.longitude").alias("longitude"),
        F.lower(F.col("sensor.parameter.name")).alias("parameter"),
        F.col("sensor.parameter.units").alias("unit"),
        F.explode_outer("measurements").alias("m"))
    raw = F.col("m.period.datetimeFrom")
    dt = F.coalesce(F.get_json_object(raw, "$.utc"),
                    F.when(~F.trim(raw).startswith("{"), raw))
    out = m.select(
        F.to_timestamp(dt).alias("datetime"),
        nan_to_null(F.col("m.value")).alias("value"),
        "parameter", "unit", "location", "latitude", "longitude")
    out = out.filter(F.col("datetime").isNotNull())
    if parameters:
        out = out.filter(F.col("parameter").isin(list(parameters)))
    return out


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed payload JSON files (one object per line) with a declared schema."""
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)
