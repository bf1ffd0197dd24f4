"""The run history as a stored table (W13, S8): commits by batch id.

``commit_runs`` stores the rows of one batch and commits them under the batch's
id: a batch that is retried, or whose driver was lost, is in the table once or
not at all.  ``read_runs`` gives the present row of every key: the latest
``run_ts``, of equal ones the later commit.  ``compact_runs`` rewrites these rows
as one batch that replaces the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.sources.commits import manifests, put_manifest, remove_unnamed

SEQ = "_seq"


def _commits(spark: SparkSession, path: str) -> dict[str, dict]:
    return manifests(spark, f"{path}/commits")


def stage_runs(runs: DataFrame, path: str) -> str:
    """Store the rows in a new folder, which no reader sees yet; its name."""
    name = f"rows-{uuid.uuid4().hex}"
    runs.write.parquet(f"{path}/data/{name}")
    return name


def commit_runs(runs: DataFrame, path: str, batch_id: str, replaces=()) -> bool:
    """Add one batch of run rows; False where the batch is committed
    already (its rows are then left as they are)."""
    spark = runs.sparkSession
    known = _commits(spark, path)
    if batch_id in known:
        return False
    seq = max((c["seq"] for c in known.values()), default=0) + 1
    return put_manifest(spark, f"{path}/commits", batch_id, {"folder": stage_runs(runs, path), "seq": seq, "replaces": sorted(replaces), "schema": runs.schema.jsonValue()})


def _valid(spark: SparkSession, path: str) -> dict[str, dict]:
    all_ = _commits(spark, path)
    gone = {b for c in all_.values() for b in c["replaces"]}
    return {b: c for b, c in all_.items() if b not in gone}


def run_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """Every committed row with its commit's number; None for no commit."""
    out = None
    for c in sorted(_valid(spark, path).values(), key=lambda c: c["seq"]):
        rows = spark.read.schema(T.StructType.fromJson(c["schema"])).parquet(f"{path}/data/{c['folder']}").withColumn(SEQ, F.lit(int(c["seq"])))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_runs(spark: SparkSession, path: str, key=("run_id",), ts: str = "run_ts") -> DataFrame | None:
    """The present row of every key; None where nothing is committed."""
    rows = run_versions(spark, path)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in (*key, SEQ)]
    g = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(SEQ))).alias("_r"))
    return g.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns if c != SEQ])


def compact_runs(spark: SparkSession, path: str, batch_id: str, key=("run_id",), ts: str = "run_ts") -> bool:
    """Replace all committed batches by one that holds the present rows."""
    old = _valid(spark, path)
    return bool(old) and commit_runs(read_runs(spark, path, key, ts), path, batch_id, replaces=old)


def clean_runs(spark: SparkSession, path: str) -> int:
    """Delete folders of lost writers and of replaced batches."""
    return remove_unnamed(spark, f"{path}/data", [c["folder"] for c in _valid(spark, path).values()])
