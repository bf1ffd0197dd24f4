"""Stored runs, restartable ingest, keyed alignment and hashed dedup."""

import os
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorspark.functions import metrics as MT
from sensorspark.operators import ingest as I
from sensorspark.plans import catalog
from sensorspark.plans import ingest_run as IR
from sensorspark.sources import commits as CO
from sensorspark.sources import run_store as RS
from sensorspark.sources.measurements import shard_number

T0 = datetime(2024, 1, 1)
RUNS = "run_id string, run_ts timestamp, candidate_rmse double"


def run_rows(spark, *rows):
    return spark.createDataFrame([(i, T0 + timedelta(days=d), x) for i, d, x in rows], RUNS)


def present(spark, path):
    return sorted((r.run_id, r.candidate_rmse) for r in RS.read_runs(spark, path).collect())


def test_a_batch_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert RS.read_runs(spark, path) is None
    a = run_rows(spark, ("r1", 0, 1.0), ("r2", 1, 2.0))
    assert RS.commit_runs(a, path, "a") and not RS.commit_runs(a, path, "a")
    assert present(spark, path) == [("r1", 1.0), ("r2", 2.0)]
    assert RS.commit_runs(run_rows(spark, ("r2", 1, 9.0), ("r3", 2, 3.0), ("r1", -5, 0.5)), path, "b")      # ties go to the later commit
    assert present(spark, path) == [("r1", 1.0), ("r2", 9.0), ("r3", 3.0)]


def test_a_lost_writer_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    RS.commit_runs(run_rows(spark, ("r1", 0, 1.0)), path, "a")

    def lost(*a, **k):
        raise ConnectionError
    monkeypatch.setattr(RS, "put_manifest", lost)
    with pytest.raises(ConnectionError):
        RS.commit_runs(run_rows(spark, ("r1", 1, 7.0)), path, "b")
    monkeypatch.undo()
    assert present(spark, path) == [("r1", 1.0)] and len(os.listdir(f"{path}/data")) == 2
    assert RS.clean_runs(spark, path) == 1 and len(os.listdir(f"{path}/data")) == 1
    assert RS.commit_runs(run_rows(spark, ("r1", 1, 7.0)), path, "b") and present(spark, path) == [("r1", 7.0)]


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    real, first = RS.stage_runs, run_rows(spark, ("r1", 0, 1.0))

    def stage(runs, p):
        monkeypatch.setattr(RS, "stage_runs", real)
        assert RS.commit_runs(first, path, "a")           # another writer is faster
        return real(runs, p)
    monkeypatch.setattr(RS, "stage_runs", stage)
    assert not RS.commit_runs(run_rows(spark, ("r1", 0, 5.0)), path, "a")
    assert present(spark, path) == [("r1", 1.0)]
    assert not [f for f in os.listdir(f"{path}/commits") if f.startswith(".a-")]


def test_compaction_keeps_rows_and_commits(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(4):
        RS.commit_runs(run_rows(spark, ("r1", i, float(i)), (f"x{i}", 0, 0.5)), path, f"b{i}")
    before = present(spark, path)
    assert RS.compact_runs(spark, path, "c1") and not RS.compact_runs(spark, path, "c1")
    assert present(spark, path) == before and RS.run_versions(spark, path).count() == 5
    assert not RS.commit_runs(run_rows(spark, ("r1", 9, 9.0)), path, "b2")          # still known
    assert RS.clean_runs(spark, path) == 4 and present(spark, path) == before


def test_runs_with_a_new_column(spark, tmp_path):
    path = str(tmp_path / "runs")
    RS.commit_runs(run_rows(spark, ("r1", 0, 1.0)), path, "a")
    RS.commit_runs(run_rows(spark, ("r2", 0, 2.0)).withColumn("note", F.lit("n")), path, "b")
    assert sorted((r.run_id, r.note) for r in RS.read_runs(spark, path).collect()) == [("r1", None), ("r2", "n")]


# ------------------------------------------------------------------ ingest
READINGS = "datetime timestamp, value double, parameter string, location string, latitude double, longitude double, arrival long"


def readings(spark):
    rows = [(T0 + timedelta(hours=h), float(h), "pm25", f"l{h % 2}", 1.0, 2.0, h) for h in range(24 * 12)]
    return spark.createDataFrame(rows + [(r[0], -1.0, *r[2:6], r[6] + 1000) for r in rows[::5]], READINGS)


def source(df):
    return lambda start, end: df.filter(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def kept(spark, root):
    return sorted((r.datetime, r.location, r.value) for r in IR.read_merged(spark, root).collect())


@pytest.mark.parametrize("step", ["decide", "shard", "merge", "commit"])
def test_ingest_restarts_after_a_loss_at_any_step(spark, tmp_path, step):
    df = readings(spark)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    moments = ["2024-01-04 00:00:00", "2024-01-08 12:00:00", "2024-01-12 06:00:00"]
    for now in moments:
        IR.run_ingest(spark, source(df), whole, now, 7)

    def lost(s):
        if s == step:
            raise ConnectionError(s)
    for i, now in enumerate(moments):
        if i:
            before = kept(spark, broken)
        with pytest.raises(ConnectionError):
            IR.run_ingest(spark, source(df), broken, now, 7, after_step=lost)
        if i and step != "commit":
            assert kept(spark, broken) == before                         # the last commit is valid
        again = IR.run_ingest(spark, source(df), broken, now, 7)
        assert again["status"] == ("skipped" if step == "commit" else "fetch")
    assert kept(spark, broken) == kept(spark, whole) and len(kept(spark, whole)) == 7 * 24 + 1
    marks = [c["watermark"] for c in IR.commits_of(spark, broken)]
    assert marks == sorted(marks)
    used = IR.clean_up(spark, broken)
    assert used >= 2 and kept(spark, broken) == kept(spark, whole)
    assert len(os.listdir(f"{broken}/shards")) == 3


def test_ingest_decisions(spark, tmp_path):
    df, root = readings(spark), str(tmp_path / "r")
    assert IR.read_merged(spark, root) is None
    assert IR.run_ingest(spark, source(df.filter("false")), root, "2024-01-03 00:00:00", 7)["status"] == "empty"
    first = IR.run_ingest(spark, source(df), root, "2024-01-03 00:00:00", 7)
    assert (first["status"], first["watermark"]) == ("fetch", "2024-01-03T00:00:00")
    assert IR.run_ingest(spark, source(df), root, "2024-01-03 12:00:00", 7)["status"] == "skipped"
    forced = IR.run_ingest(spark, source(df), root, "2024-01-03 12:00:00", 7, force=True)
    assert (forced["status"], forced["watermark"], forced["rows"]) == ("fetch", "2024-01-03T12:00:00", 13 + 3)
    late = IR.run_ingest(spark, source(df.filter("false")), root, "2024-01-11 00:00:00", 7)
    assert late["status"] == "empty" and late["watermark"] == "2024-01-03T12:00:00"
    assert min(t for t, _, _ in kept(spark, root) or [(T0 + timedelta(days=10), 0, 0)]) >= T0 + timedelta(days=3) or kept(spark, root) == []


def test_two_runs_at_once_do_not_both_commit(spark, tmp_path):
    df, root = readings(spark), str(tmp_path / "r")

    def other(step):
        if step == "merge":
            IR.run_ingest(spark, source(df), root, "2024-01-03 00:00:00", 7)
    with pytest.raises(RuntimeError):
        IR.run_ingest(spark, source(df), root, "2024-01-04 00:00:00", 7, after_step=other)
    assert len(IR.commits_of(spark, root)) == 1
    assert IR.run_ingest(spark, source(df), root, "2024-01-04 00:00:00", 7)["status"] == "fetch"


def test_manifests_are_put_once(spark, tmp_path):
    d = str(tmp_path / "m")
    assert CO.manifests(spark, d) == {}
    assert CO.put_manifest(spark, d, "a", {"x": 1}) and not CO.put_manifest(spark, d, "a", {"x": 2})
    assert CO.manifests(spark, d) == {"a": {"x": 1}}


# ------------------------------------------------------------------ J4, W10
def preds(spark, rows, name="pred"):
    return spark.createDataFrame(rows, f"k string, t int, {name} double")


def test_alignment_raises_on_repeated_keys(spark):
    truth = preds(spark, [("a", 1, 1.0), ("a", 2, None), ("b", 1, 3.0), (None, 1, 9.0), ("c", 1, 4.0)], "y")
    base, cand = preds(spark, [("a", 1, 1.5), ("a", 2, 2.5), ("b", 1, 3.5), (None, 1, 0.0)]), preds(spark, [("a", 1, 1.1), ("a", 2, None), ("d", 1, 0.0), ("c", 1, 4.4)])
    rows = lambda how: sorted(map(tuple, MT.align_predictions(truth, base, cand, ["k", "t"], how=how).collect()), key=str)
    assert rows("inner") == [("a", 1, 1.0, 1.5, 1.1), ("a", 2, None, 2.5, None)]
    assert rows("left") == sorted([("a", 1, 1.0, 1.5, 1.1), ("a", 2, None, 2.5, None), ("b", 1, 3.0, 3.5, None), (None, 1, 9.0, None, None), ("c", 1, 4.0, None, 4.4)], key=str)
    again = preds(spark, [("a", 1, 7.0)])
    for t, b, c in ((truth.union(again), base, cand), (truth, base.union(again), cand), (truth, base, cand.union(again))):
        with pytest.raises(Exception, match="a prediction key is repeated: a, 1"):
            MT.align_predictions(t, b, c, ["k", "t"]).collect()
        with pytest.raises(Exception, match="repeated"):
            MT.compare_models(MT.align_predictions(t, b, c, ["k", "t"])).collect()
    plan = MT.align_predictions(truth, base, cand, ["k", "t"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_dedup_by_codes_equals_dedup_by_rows(spark):
    rows = [(i % 7, f"m_2024010{1 + i % 3}_2024010{5 + i % 2}", (i * 37) % 50, None if i % 5 == 0 else f"u{i % 4}", float(i)) for i in range(200)]
    rows += [(99, "m_20240101_20240105", None, "x", 1.0), (99, "m_20240101_20240105", 4, "y", 2.0)]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "k int, shard string, arrival long, unit string, value double")
    plain = sorted(map(tuple, I.dedup_first(df, ["k"], ("shard", "arrival")).collect()), key=str)
    coded = I.dedup_first(df.withColumn("_no", shard_number(F.col("shard"))), ["k"], ("_no", "arrival"), dictionary=("unit", "shard")).drop("_no")
    assert sorted(map(tuple, coded.select(*df.columns).collect()), key=str) == sorted(map(tuple, I.dedup_first(df, ["k"], ("shard", "arrival")).select(*df.columns).collect()), key=str)
    assert len(plain) == 8
    assert "SortAggregate" not in coded._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedup_first", "rolling_merge", "shard_roundtrip"])
def test_registered_dedup_does_not_sort_readings(spark, name):
    plan = catalog.registered()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
