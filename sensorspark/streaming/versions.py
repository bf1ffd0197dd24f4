"""Tables of versioned rows: results that a stream may state again.

A stage in update mode emits a key whenever its value changes, the newest hours
included, long before a watermark closes them.  Every micro-batch writes its
rows to a folder of its own, ``epoch=<n>/date=<day>``; a batch that runs again
after a failure replaces its folder, so nothing is written twice.  The row of
the highest epoch is a key's present one (``latest``).  Rows are only ever
added: a reader of the table sees whole epochs, and the next stage reads the
folder as a stream of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.session import path_exists, remove_path

EPOCH, DATE = "epoch", "date"


def stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType()), T.StructField(DATE, T.DateType())])


def write_epoch(rows: DataFrame, table: str, epoch: int, time_col: str) -> None:
    """Store the rows of one micro-batch, replacing what an earlier try left."""
    rows.withColumn(DATE, F.to_date(time_col)).write.mode("overwrite").partitionBy(DATE).parquet(f"{table}/{EPOCH}={int(epoch)}")


def read_versions(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """All versions of all rows, with ``epoch`` and ``date``."""
    if not path_exists(spark, table):
        return spark.createDataFrame([], stored_schema(schema))
    return spark.read.schema(stored_schema(schema)).parquet(table)


def stream_versions(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table as a stream of changes."""
    return spark.readStream.schema(stored_schema(schema)).parquet(table)


def latest(versions: DataFrame, key) -> DataFrame:
    """The present row of every key (one aggregate, combined map-side)."""
    key = list(key)
    rest = [c for c in versions.columns if c not in (*key, EPOCH, DATE)]
    g = versions.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(EPOCH)).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_latest(spark: SparkSession, table: str, schema: T.StructType, key) -> DataFrame:
    return latest(read_versions(spark, table, schema), key).select(*schema.fieldNames())


def run_versions(changes: DataFrame, table: str, ckpt: str, time_col: str) -> str:
    """Run a stream in update mode over everything available into ``table``."""
    q = changes.writeStream.outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True) \
               .foreachBatch(lambda batch, epoch: write_epoch(batch, table, epoch, time_col)).start()
    q.awaitTermination()
    return table


def compact(spark: SparkSession, table: str, schema: T.StructType, key, time_col: str, before: str) -> None:
    """Replace the versions of the days before ``before`` by their present rows.

    These are stored under an epoch below all others, then the older folders of
    those days go, the lowest epoch first: at any moment, also after a failure,
    a reader gets the same rows.  Run it between runs of the stages that read
    the table as a stream (they treat the compacted rows as versions that they know).
    """
    old = read_versions(spark, table, schema).filter(F.col(DATE) < F.lit(before).cast("date"))
    many = old.groupBy(DATE).agg(F.collect_set(EPOCH).alias("epochs")).filter(F.size("epochs") > 1).collect()      # one row a day
    if not many:
        return
    least = read_versions(spark, table, schema).agg(F.min(EPOCH)).first()[0]
    days = [F.lit(r[DATE]) for r in many]
    write_epoch(latest(old.filter(F.col(DATE).isin(days)), key).select(*schema.fieldNames()), table, min(least, 0) - 1, time_col)
    for epoch, day in sorted((e, r[DATE]) for r in many for e in r.epochs):
        remove_path(spark, f"{table}/{EPOCH}={epoch}/{DATE}={day}")
