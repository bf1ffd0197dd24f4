"""Session helpers.

The library never hard-codes a cluster layout.  It only pins the settings its
semantics depend on (UTC session time zone) and reads the shared checkpoint
folder from the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_SCALE_CONF = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions and turn joins into broadcast joins only after the
    # build side's real (post-shuffle) size is known.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sensorspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators rely on.

    On a cluster pass ``master=None`` and let spark-submit decide; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_SCALE_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone to UTC (hour truncation and calendar features
    are defined in UTC) and enable AQE if the caller has not configured it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, stream state and checkpoints.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Where it is
    unset a scratch folder is made, but only for a ``local`` master: on a
    cluster that would be the driver's own disk.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sensorspark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def materialize(df):
    """Cut a lineage that several consumers share: written as Parquet to the
    shared folder (columnar, pruned and pushed down on every read, safe when
    executors are lost) and read back.  ``release`` removes the tables."""
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark)}/sensorspark-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every intermediate table that this application materialized; the
    DataFrames made from them can't be read any more."""
    remove_path(spark, f"{checkpoint_dir(spark)}/sensorspark-{spark.sparkContext.applicationId}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system (any store Spark can reach)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
