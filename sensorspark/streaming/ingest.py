"""Incremental ingest as Structured Streaming.

The original keeps a "last fetch" high-watermark file and re-merges dated
shards.  Here the file source's checkpoint is the high-watermark (each file
is processed once), event-time watermarks bound the dedup state, and
``foreachBatch`` maintains the merged table by date partition.  The chained
stages (dedup, hourly means, rolling statistics) state rows as soon as they are
known and again when they change (``versions``), so the newest readings are in
every result.  All state and output live under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.constants import DEDUP_KEY, EVENT_PARAMETER, ROLLING_WINDOWS
from sensorspark.operators.resample import reading_means
from sensorspark.session import checkpoint_dir, path_exists, remove_path
from sensorspark.sources.measurements import measurement_view
from sensorspark.streaming import versions as V
from sensorspark.streaming.rolling import rolling_stream

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def new_run_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder under the shared checkpoint location for one stream run."""
    return f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """T1 source: a parquet table (a file or a folder of files) as a stream
    with a fixed schema; files already committed in the checkpoint are never
    read again."""
    r = spark.readStream.schema(schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        path = f"{path[:-1]}[{path[-1]}]"          # a stream's path is a folder or a pattern
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    return r.parquet(path)


def stream_measurements(spark: SparkSession, sf_dir: str, parameters=None, max_files: int | None = None) -> DataFrame:
    """The measurement view over a stream of the ``events`` table's files."""
    ev = read_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", EVENTS_SCHEMA, max_files)
    if parameters is not None:
        ev = ev.filter(F.col("event_type").isin([e for e, p in EVENT_PARAMETER.items() if p in set(parameters)]))
    return measurement_view(ev)


def dedup_stream(m: DataFrame, delay: str = "2 hours", key=None, order: str = "arrival") -> DataFrame:
    """Of the readings with one key the one with the smallest ``order``.  In
    update mode a key is emitted at once and again whenever a smaller one comes
    within ``delay``; later copies fall behind the watermark."""
    key = list(key or DEDUP_KEY)
    rest = [c for c in m.columns if c not in key]
    g = m.withWatermark("datetime", delay).groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order)).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def late_filter(m: DataFrame, as_of: str, days: int) -> DataFrame:
    """T7, retention part: readings older than the cutoff are dropped.  Lateness
    against the stream itself is enforced by the watermark of a stateful
    stage, such as ``dedup_stream``."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return m.filter(F.col("datetime") >= cutoff)


def run_dedup(spark: SparkSession, m: DataFrame, run_dir: str, delay: str = "2 hours") -> DataFrame:
    """T3 end to end: the deduplicated readings, the newest included."""
    d = dedup_stream(m, delay)
    V.run_versions(d, f"{run_dir}/dedup", f"{run_dir}/ckpt_dedup", "datetime")
    return V.read_latest(spark, f"{run_dir}/dedup", d.schema, DEDUP_KEY)


def hourly_schema(series_cols=()) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in series_cols], T.StructField("hour", T.TimestampType()), T.StructField("parameter", T.StringType()),
                         T.StructField("value", T.DoubleType()), T.StructField("readings", T.LongType())])


def restate_hours(source: str, schema: T.StructType, table: str, parameters, series_cols=()):
    """T4: ``foreachBatch`` function over the changes of the deduplicated
    readings.  Every (series, hour, parameter) that a change touches is stated
    anew from the present readings of its days: mean per reading time, then
    mean of these.  An hour that lost its last value is stated as NULL with no readings."""
    key = [*series_cols, "hour", "parameter"]

    def fn(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        hour = F.date_trunc("hour", F.col("datetime"))
        touched = batch.filter(F.col("parameter").isin(list(parameters))).select(*series_cols, hour.alias("hour"), "parameter").distinct()
        days = [F.lit(r[0]) for r in batch.select(V.DATE).distinct().collect()]          # one date a day of data in the batch
        now = V.latest(V.read_versions(spark, source, schema).filter(F.col(V.DATE).isin(days) if days else F.lit(False)), DEDUP_KEY)
        now = now.withColumn("hour", hour).join(touched, key, "left_semi")
        means = reading_means(now, parameters, series_cols)
        hours = means.groupBy(*series_cols, hour.alias("hour"), "parameter").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("readings"))
        out = touched.join(hours, key, "left").withColumn("readings", F.coalesce("readings", F.lit(0)))
        V.write_epoch(out.select(*hourly_schema(series_cols).fieldNames()), table, epoch, "hour")
    return fn


def run_hourly(spark: SparkSession, m: DataFrame, run_dir: str, parameters, delay: str = "2 hours", series_cols=()) -> DataFrame:
    """T4 end to end: keep-first dedup, then the hourly mean of means of every
    hour, provisional ones included; a later run states changed hours again."""
    d = dedup_stream(m, delay)
    V.run_versions(d, f"{run_dir}/dedup", f"{run_dir}/ckpt_dedup", "datetime")
    q = V.stream_versions(spark, f"{run_dir}/dedup", d.schema).writeStream.trigger(availableNow=True) \
         .option("checkpointLocation", f"{run_dir}/ckpt_hourly") \
         .foreachBatch(restate_hours(f"{run_dir}/dedup", d.schema, f"{run_dir}/hourly", parameters, series_cols)).start()
    q.awaitTermination()
    key = [*series_cols, "hour", "parameter"]
    return V.read_latest(spark, f"{run_dir}/hourly", hourly_schema(series_cols), key).filter("readings > 0")


def run_sliding(spark: SparkSession, m: DataFrame, run_dir: str, parameters, lengths=ROLLING_WINDOWS, delay: str = "2 hours", delay_hours: int = 3,
                series_cols=()) -> DataFrame:
    """T5 end to end over the T4 stream: the rolling mean and std of the gap-filled
    hours, one row a series, parameter, hour and length."""
    run_hourly(spark, m, run_dir, parameters, delay, series_cols)
    changes = V.stream_versions(spark, f"{run_dir}/hourly", hourly_schema(series_cols))
    out = rolling_stream(changes, lengths, delay_hours, series_cols)
    V.run_versions(out, f"{run_dir}/sliding", f"{run_dir}/ckpt_sliding", "hour")
    rows = V.read_latest(spark, f"{run_dir}/sliding", out.schema, [*series_cols, "hour", "parameter", "length"]).filter("n > 0")
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    return rows.select(*series_cols, "length", (end - F.make_interval(hours=F.col("length"))).alias("window_start"), end.alias("window_end"), "parameter", "mean", "std", "n")


def run_to_parquet(df: DataFrame, out: str, ckpt: str, mode: str = "append", partition_by=()) -> str:
    """Run a stream over everything available (``availableNow``) into a
    parquet sink with its checkpoint; restartable after executor or driver
    loss (the sink commit log makes the output exactly-once)."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt) \
          .outputMode(mode).trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    return out


def upsert_batch(table: str, key=None, order=("arrival",), date_col: str = "datetime"):
    """``foreachBatch`` function that merges each micro-batch into a
    parquet table partitioned by date: only the dates a batch touches are
    read (their list prunes the scan), deduplicated keep-first and overwritten
    (dynamic partition overwrite).  Whatever fails, fails the batch and leaves
    the table as it was; only a table that does not exist yet is made anew."""
    key = list(key or DEDUP_KEY)

    def fn(batch: DataFrame, epoch_id: int) -> None:
        from sensorspark.operators.ingest import dedup_first
        spark = batch.sparkSession
        b = batch.withColumn("date", F.to_date(date_col))
        merged = b
        if path_exists(spark, table):
            # one date per day of data in the batch
            dates = [r.date for r in b.select("date").distinct().collect()]
            known = [F.lit(d) for d in dates if d is not None]
            cur = spark.read.parquet(table).filter(F.col("date").isin(known) if known else F.lit(False))
            wrong = [f.name for f in cur.schema if f.name in b.columns and b.schema[f.name].dataType != f.dataType]
            if wrong:
                raise ValueError(f"batch {epoch_id}: other column types than in {table}: {wrong}")
            merged = cur.unionByName(b, allowMissingColumns=True)
        out = dedup_first(merged, key, order)
        # staged write, then dynamic overwrite of the touched dates only
        stage = f"{table}__stage/epoch={epoch_id}"
        out.write.mode("overwrite").parquet(stage)
        spark.read.schema(out.schema).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
             .partitionBy("date").parquet(table)
        remove_path(spark, stage)
    return fn


def run_upsert(df: DataFrame, table: str, ckpt: str, **kw) -> str:
    q = df.writeStream.foreachBatch(upsert_batch(table, **kw)).option("checkpointLocation", ckpt) \
          .trigger(availableNow=True).start()
    q.awaitTermination()
    return table
