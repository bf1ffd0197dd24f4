"""Sinks, shards, streams and intermediate tables on files."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark import session
from sensorspark.constants import PARAMETERS
from sensorspark.operators import clean as C
from sensorspark.operators import ingest as I
from sensorspark.operators.resample import hourly_long
from sensorspark.plans import catalog
from sensorspark.sources import measurements as S
from sensorspark.sources import run_store, sinks
from sensorspark.streaming import ingest as ST

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(df.collect(), key=str)


def test_shards_round_trip(spark, tmp_path):
    root = str(tmp_path / "shards")
    s = C.standardize(catalog.shards(spark, SF))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # else tiny tasks are joined
    sinks.write_shards(s, root)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = S.read_shards(spark, root, schema=catalog.SHARD_SCHEMA)
    assert _rows(back.select(*s.columns)) == _rows(s)
    week = "m_20240101_20240109"
    one = S.read_shards(spark, root, glob=week, schema=catalog.SHARD_SCHEMA)
    assert _rows(one.select(*s.columns)) == _rows(s.filter(F.col("shard") == week))
    files = [f for f in os.listdir(f"{root}/shard={week}") if f.endswith(".parquet")]
    assert len(files) > 1                                     # one week, several tasks
    plan = back.filter(F.col("shard") == week)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_broken_shard_fails_or_is_named(spark, tmp_path):
    root = str(tmp_path / "shards")
    sinks.write_shards(C.standardize(catalog.shards(spark, SF)), root)
    bad = f"{root}/shard=m_20240101_20240109/part-x.parquet"
    with open(bad, "wb") as f:
        f.write(b"PAR1 cut off")
    with pytest.raises(Exception):
        S.read_shards(spark, root, schema=catalog.SHARD_SCHEMA).count()
    assert S.read_shards(spark, root, schema=catalog.SHARD_SCHEMA, skip_corrupt=True).count() == catalog.shards(spark, SF).count()
    unread = S.unread_files(spark, root)
    assert len(unread) == 1 and unread[0].endswith("part-x.parquet")


def test_merged_table_and_splits(spark, tmp_path):
    m = catalog.cleaned(spark, SF)
    sinks.write_merged(m, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert "date" in back.columns and _rows(back.select(*m.columns)) == _rows(m)
    sinks.write_merged(m, str(tmp_path / "flat"), by_date=False)
    assert spark.read.parquet(str(tmp_path / "flat")).columns == m.columns
    w = spark.createDataFrame([("train", 1.0), ("test", 2.0), ("train", 3.0)], "split string, y double")
    sinks.write_splits(w, str(tmp_path / "w"))
    assert sorted(x for x in os.listdir(tmp_path / "w") if x.startswith("split=")) == ["split=test", "split=train"]
    assert spark.read.parquet(str(tmp_path / "w")).filter("split = 'train'").count() == 2


def test_predictions_and_runs(spark, tmp_path):
    p = spark.createDataFrame([(datetime(2024, 1, 1), 1.5, "v1")], "timestamp timestamp, predicted_pm25 double, model_version string")
    sinks.write_predictions(p, str(tmp_path / "p"))
    csv = spark.read.option("header", True).csv(str(tmp_path / "p/csv"))
    assert spark.read.parquet(str(tmp_path / "p/parquet")).collect() == p.collect() and csv.first()["predicted_pm25"] == "1.5"
    runs = spark.createDataFrame([("r1", datetime(2024, 1, 1)), ("r2", datetime(2024, 1, 3))], "run_id string, run_ts timestamp")
    for _ in range(2):                                        # a retry adds nothing
        sinks.append_runs(runs, str(tmp_path / "r"), "b1")
    sinks.append_runs(spark.createDataFrame([("r3", datetime(2024, 1, 2))], runs.schema), str(tmp_path / "r"), "b2")
    stored = run_store.read_runs(spark, str(tmp_path / "r"))
    assert stored.count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 3
    sinks.export_runs_csv(stored, str(tmp_path / "export"))
    lines = []
    for f in sorted(x for x in os.listdir(tmp_path / "export") if x.endswith(".csv")):
        lines += (tmp_path / "export" / f).read_text().splitlines()[1:]
    assert [x.split(",")[0] for x in lines] == ["r2", "r3", "r1"]


def test_drift_report_file(spark, tmp_path):
    psi = spark.createDataFrame([("a", 0.25), ("b", 0.5)], "feature string, psi double")
    summary = spark.createDataFrame([(0.375, "retrain")], "psi_score double, recommendation string")
    sinks.write_json_report(sinks.drift_report_frame(summary, psi), str(tmp_path / "r"))
    files = [f for f in os.listdir(tmp_path / "r") if f.endswith(".json")]
    assert len(files) == 1
    assert json.loads((tmp_path / "r" / files[0]).read_text()) == {"psi_score": 0.375, "recommendation": "retrain", "feature_psi": {"a": 0.25, "b": 0.5}}


@pytest.fixture
def folder_table(spark, tmp_path):
    """``events`` stored as a folder of three files."""
    root = tmp_path / "sf"
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(root / "events.parquet"))
    return str(root)


def test_streams_read_folder_tables(spark, tmp_path, folder_table):
    for sf in (SF, folder_table):
        m = ST.stream_measurements(spark, sf)
        d = ST.new_run_dir(spark, "test")
        got = spark.read.parquet(ST.run_to_parquet(m, f"{d}/out", f"{d}/ckpt"))
        assert got.count() == 1000


def test_stream_restart_reads_nothing_twice(spark, folder_table):
    d = ST.new_run_dir(spark, "test")
    for _ in range(2):
        out = ST.run_to_parquet(ST.stream_measurements(spark, folder_table, max_files=1), f"{d}/out", f"{d}/ckpt")
    assert spark.read.parquet(out).count() == 1000


def test_stream_hourly_equals_batch(spark, folder_table):
    batch = {(r["hour"], r["parameter"]): r["value"] for r in hourly_long(catalog.cleaned(spark, SF), PARAMETERS).collect()}
    out = ST.run_hourly(spark, ST.stream_measurements(spark, folder_table, PARAMETERS), ST.new_run_dir(spark, "test"), PARAMETERS).collect()
    assert {(r["hour"], r["parameter"]): pytest.approx(r["value"]) for r in out} == batch and len(out) == len(batch)


def test_late_and_duplicate_readings(spark, tmp_path):
    """A smaller arrival inside the delay wins; a copy behind the watermark
    is dropped; what lies above the watermark is in the result."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("datetime", T.TimestampType()), ("parameter", T.StringType()), ("location", T.StringType()),
                                                           ("value", T.DoubleType()), ("arrival", T.LongType()))])
    t = datetime(2024, 1, 1)
    batches = [[(t, "p", "a", 1.0, 9), (t + timedelta(minutes=30), "p", "a", 5.0, 1)], [(t, "p", "a", 2.0, 4), (t + timedelta(hours=5), "p", "a", 3.0, 5)],
               [(t, "p", "a", 7.0, 0), (t + timedelta(hours=9), "p", "a", 4.0, 6)]]
    d = ST.new_run_dir(spark, "late")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = ST.run_dedup(spark, ST.read_stream(spark, str(tmp_path / "in"), schema), d, "2 hours")
    got = sorted((r["datetime"], r["value"], r["arrival"]) for r in out.collect())
    assert got == [(t, 2.0, 4), (t + timedelta(minutes=30), 5.0, 1), (t + timedelta(hours=5), 3.0, 5), (t + timedelta(hours=9), 4.0, 6)]


def test_failing_batch_leaves_the_table(spark, tmp_path):
    table = str(tmp_path / "t")
    day = datetime(2024, 1, 1)
    rows = [(day + timedelta(hours=i), "p", "a", float(i), i) for i in range(5)]
    schema = "datetime timestamp, parameter string, location string, value double, arrival long"
    up = ST.upsert_batch(table)
    up(spark.createDataFrame(rows, schema), 0)
    before = _rows(spark.read.parquet(table))
    with pytest.raises(ValueError):
        up(spark.createDataFrame([(day, "p", "b", "text", 9)], schema.replace("value double", "value string")), 1)
    assert _rows(spark.read.parquet(table)) == before
    up(spark.createDataFrame([(day, "p", "a", 77.0, 99), (day + timedelta(days=1), "p", "a", 1.0, 100)], schema), 2)
    got = spark.read.parquet(table)
    assert got.count() == 6 and got.filter("value = 77.0").count() == 0      # keep-first
    assert not os.path.exists(f"{table}__stage/epoch=2")


def test_upsert_reads_touched_dates_only(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [(datetime(2024, 1, 1 + d), "p", "a", 1.0, d) for d in range(20)]
    up = ST.upsert_batch(table)
    df = spark.createDataFrame(rows, "datetime timestamp, parameter string, location string, value double, arrival long")
    up(df, 0)
    stamp = {d: sorted(os.listdir(f"{table}/{d}")) for d in os.listdir(table) if d.startswith("date=")}
    up(df.limit(1), 1)
    now = {d: sorted(os.listdir(f"{table}/{d}")) for d in os.listdir(table) if d.startswith("date=")}
    assert [d for d in stamp if stamp[d] != now[d]] == ["date=2024-01-01"]


def test_materialized_tables_are_parquet_and_released(spark):
    df = session.materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    plan = df.select("id").filter("id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "ReadSchema: struct<id:bigint>" in plan
    root = f"{session.checkpoint_dir(spark)}/sensorspark-{spark.sparkContext.applicationId}"
    assert session.path_exists(spark, root)


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Spark:
        sparkContext = Context()
    with pytest.raises(ValueError):
        session.checkpoint_dir(Spark())


def test_merge_of_tables_with_other_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, "s")], "x int, z string")
    assert sorted(tuple(r) for r in I.merge_shards([a, b]).collect()) == [(1, 2, None), (3, None, "s")]
