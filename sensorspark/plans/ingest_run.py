"""One restartable ingest run (T1, T2, T6): fetch decision, shard, merged table
and high-watermark, committed together.

A run reads the last commit, decides what to fetch (``fetch_plan``'s rules), writes
the new shard and the merged table to folders of its own and commits both with
the new watermark by one manifest.  A run that is lost at any step leaves the
last commit valid, and the next run decides the same again.  A run that fetches
nothing still rebuilds the merged table, as the retention moves on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.constants import DEFAULT_ROLLING_DAYS
from sensorspark.operators import clean as C
from sensorspark.operators import ingest as I
from sensorspark.sources.commits import manifests, put_manifest, remove_unnamed


def commits_of(spark: SparkSession, root: str) -> list[dict]:
    """The committed runs, oldest first."""
    return list(manifests(spark, f"{root}/commits").values())


def decide(last: dict | None, labels, now: datetime, force: bool, first_days: int) -> dict:
    """What to fetch: from the last reading (or ``first_days`` back), unless
    less than a day has passed or the span's shard is stored."""
    mark = last["watermark"] if last else None
    start = datetime.fromisoformat(mark) if mark else now - timedelta(days=first_days)
    label = f"m_{start:%Y%m%d}_{now:%Y%m%d}"
    days = (now - start).total_seconds() // 86400
    status = "fetch" if force else "skipped" if days < 1 else "stored" if label in labels else "fetch"
    return {"start": start.isoformat(), "end": now.isoformat(), "label": label, "status": status}


def stored_shards(spark: SparkSession, root: str, shards: list[dict], schema: T.StructType) -> DataFrame:
    """The committed shards as one table with their label and number."""
    out = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("shard", T.StringType()), T.StructField("shard_no", T.IntegerType())]))
    for s in shards:
        d = spark.read.schema(schema).parquet(f"{root}/shards/{s['folder']}")
        out = out.unionByName(d.withColumn("shard", F.lit(s["label"])).withColumn("shard_no", F.lit(int(s["no"]))))
    return out


def run_ingest(spark: SparkSession, fetch: Callable[[str, str], DataFrame], root: str, now: str, rolling_days: int = DEFAULT_ROLLING_DAYS,
               force: bool = False, after_step: Callable[[str], None] = lambda step: None) -> dict:
    """One run as of ``now``; the committed manifest.

    ``fetch(start, end)`` gives the readings of a closed span (readings at the
    watermark come again and lose to the stored ones).  ``after_step`` is called
    after "decide", "shard", "merge" and "commit"; what it raises ends the run
    there, as a lost driver would.
    """
    done = commits_of(spark, root)
    last = done[-1] if done else None
    shards = list(last["shards"]) if last else []
    when = datetime.fromisoformat(str(now))
    run = decide(last, {s["label"] for s in shards}, when, force, rolling_days)
    after_step("decide")
    mark, rows = last["watermark"] if last else None, 0
    schema = T.StructType.fromJson(last["schema"]) if last and last["schema"] else None
    if run["status"] == "fetch":
        new = C.standardize(fetch(run["start"], run["end"]))
        folder = f"{run['label']}-{uuid.uuid4().hex}"
        new.write.parquet(f"{root}/shards/{folder}")
        schema = new.schema
        got = spark.read.schema(schema).parquet(f"{root}/shards/{folder}").agg(F.count(F.lit(1)).alias("n"), F.max("datetime").alias("m")).first()
        rows = got.n
        if rows:
            newest = got.m.isoformat()
            mark = max(mark, newest) if mark else newest
            shards.append({"label": run["label"], "folder": folder, "no": len(shards)})
        else:
            run["status"] = "empty"
        after_step("shard")
    merged = f"merged-{uuid.uuid4().hex}"
    if schema is not None:
        kept = C.retention_filter(stored_shards(spark, root, shards, schema), str(when), rolling_days)
        I.dedup_first(kept, order=("shard_no", "arrival"), dictionary=("unit", "shard")).drop("shard_no").write.parquet(f"{root}/merged/{merged}")
    after_step("merge")
    commit = {**run, "rows": rows, "watermark": mark, "shards": shards, "merged": merged if schema is not None else None,
              "schema": schema.jsonValue() if schema is not None else None}
    if not put_manifest(spark, f"{root}/commits", f"{len(done):09d}", commit):
        raise RuntimeError("another run has committed meanwhile; run again")
    after_step("commit")
    return commit


def read_merged(spark: SparkSession, root: str) -> DataFrame | None:
    """The merged table of the last committed run."""
    done = commits_of(spark, root)
    return spark.read.parquet(f"{root}/merged/{done[-1]['merged']}") if done and done[-1]["merged"] else None


def clean_up(spark: SparkSession, root: str) -> int:
    """Delete what lost runs left, and merged tables but the last."""
    done = commits_of(spark, root)
    shards = {s["folder"] for d in done for s in d["shards"]}
    return remove_unnamed(spark, f"{root}/shards", shards) + remove_unnamed(spark, f"{root}/merged", [done[-1]["merged"]] if done else [])
