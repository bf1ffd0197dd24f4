"""Streams that state the newest hours and state them again when they change."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.streaming import ingest as ST
from sensorspark.streaming import rolling as RO
from sensorspark.streaming import versions as V

READINGS = "datetime timestamp, parameter string, location string, value double, arrival long"
T0 = datetime(2024, 1, 1)
HOURS = [1, 2, 5]


def brute_fill(hours: dict, start: int) -> list[tuple[int, float]]:
    """W7/W8 by pandas' own methods, as far as the look-ahead is known."""
    s = pd.Series(hours).sort_index().reindex(range(start, max(hours) + 1))
    s = s.interpolate("linear", limit=6).ffill(limit=3).bfill()
    return list(s.items())


def brute_frames(rows, length):
    v = pd.Series([x for _, x in rows])
    r = v.rolling(length, 1)
    return {i: (m, 0.0 if pd.isna(sd) else sd, min(k + 1, length)) for k, ((i, _), m, sd) in enumerate(zip(rows, r.mean(), r.std()))}


def brute_hours(readings):
    """Keep-first by arrival, mean per time, mean of the means per hour."""
    first = {}
    for t, p, loc, v, a in readings:
        if (t, p, loc) not in first or a < first[t, p, loc][1]:
            first[t, p, loc] = (v, a)
    times, hours = {}, {}
    for (t, p, _), (v, _) in first.items():
        if v is not None:
            times.setdefault((t, p), []).append(v)
    for (t, p), v in times.items():
        hours.setdefault((t.replace(minute=0), p), []).append(np.mean(v))
    return {k: (float(np.mean(v)), len(v)) for k, v in hours.items()}


def random_readings(seed, n_hours=60):
    """Batches in time order, each with copies and changes of the last two hours."""
    rng = np.random.default_rng(seed)
    batches, arrival = [], 10_000
    h = 0
    while h < n_hours:
        rows = []
        for k in range(int(rng.integers(1, 9))):
            for p in ("a", "b"):
                if rng.random() < (0.6 if p == "a" else 0.25):
                    for loc in ("x", "y"):
                        t = T0 + timedelta(hours=h + k, minutes=int(rng.choice([0, 10, 50])))
                        rows.append((t, p, loc, None if rng.random() < 0.1 else float(round(rng.normal(50, 9), 2)), arrival))
                        arrival += 1
        h += k + 1 if rng.random() < 0.8 else k + 14            # sometimes a long gap
        if batches and batches[-1]:
            newest = max(r[0] for b in batches for r in b)
            for t, p, loc, v, a in batches[-1]:
                if t > newest - timedelta(minutes=100) and rng.random() < 0.6:
                    rows.append((t, p, loc, float(round(rng.normal(50, 9), 2)) if rng.random() < 0.8 else None, a - 10_000))   # wins
        batches.append(rows)
    return [b for b in batches if b]


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_stages_restate_what_changes(spark, tmp_path, seed):
    """Each run sees one more file; after each the tables equal the batch
    results over all files so far, the newest hours included."""
    schema = spark.createDataFrame([], READINGS).schema
    src, run, seen = str(tmp_path / "in"), ST.new_run_dir(spark, "chain"), []
    for rows in random_readings(seed, 30):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        seen += rows
        out = ST.run_sliding(spark, ST.read_stream(spark, src, schema), run, ["a", "b"], HOURS, "2 hours", 3).collect()
    hours = brute_hours(seen)
    stored = V.read_latest(spark, f"{run}/hourly", ST.hourly_schema(), ["hour", "parameter"]).filter("readings > 0").collect()
    assert {(r["hour"], r["parameter"]): (pytest.approx(r["value"]), r["readings"]) for r in stored} == hours
    pos = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) // 3600
    start = min(pos(t) for t, _ in hours)
    want = {}
    for p in ("a", "b"):
        own = {pos(t): v for (t, q), (v, _) in hours.items() if q == p}
        for n in HOURS:
            want.update({(p, n, i): x for i, x in brute_frames(brute_fill(own, start), n).items()} if own else {})
    got = {(r["parameter"], r["length"], pos(r["window_end"]) - 1): (r["mean"], r["std"], r["n"]) for r in out}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9), k


@pytest.mark.parametrize("seed", range(8))
def test_rolling_state_against_the_whole_series(seed):
    """Hours of two parameters in random batches, changed inside the delay."""
    rng = np.random.default_rng(seed)
    truth, state, stated = {"a": {}, "b": {}}, {}, {}
    for at in range(0, 160, 4):
        changes = []
        for i in range(max(0, at - 3), at + 4):
            for p in ("a", "b"):
                if rng.random() < (0.5 if p == "a" else 0.08):
                    gone = i < at and rng.random() < 0.2
                    changes.append((i, p, None if gone else float(rng.normal())))
        newest = state.get("final")
        for i, p, v in changes:
            if newest is not None and i <= newest:
                continue
            truth[p].pop(i, None)
            if v is not None:
                truth[p][i] = v
        for p, first, v, tail, lost in RO.advance(state, changes, HOURS, 4):
            for n in HOURS:
                for j, x in enumerate(zip(*RO.frames(v, tail, n))):
                    stated[p, n, first + j] = x
            for i in lost:
                for n in HOURS:
                    stated.pop((p, n, i), None)
        assert all(len(s["tail"]) <= max(HOURS) - 1 and len(s["pending"]) <= 12 for s in state.get("of", {}).values())
    start = min(i for own in truth.values() for i in own)
    for p, own in truth.items():
        if own:
            want = brute_fill(own, min(start, state["start"]))
            for n in HOURS:
                for i, x in brute_frames(want, n).items():
                    assert stated[p, n, i] == pytest.approx(x, abs=1e-9), (p, n, i)


def test_an_epoch_written_twice_counts_once(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.createDataFrame([(T0, "p", 1.0), (T0 + timedelta(days=1), "p", 2.0)], "hour timestamp, parameter string, value double")
    V.write_epoch(df, table, 0, "hour")
    V.write_epoch(df.withColumn("value", F.col("value") * 10).limit(1), table, 1, "hour")
    V.write_epoch(df.withColumn("value", F.col("value") * 10), table, 1, "hour")
    assert V.read_versions(spark, table, df.schema).count() == 4
    got = V.read_latest(spark, table, df.schema, ["hour", "parameter"])
    assert sorted(r["value"] for r in got.collect()) == [10.0, 20.0]


def test_compaction_keeps_the_present_rows(spark, tmp_path):
    table, key = str(tmp_path / "t"), ["hour", "parameter"]
    df = spark.createDataFrame([(T0 + timedelta(hours=12 * i), "p", float(i)) for i in range(8)], "hour timestamp, parameter string, value double")
    for e in range(4):
        V.write_epoch(df.withColumn("value", F.col("value") + e), table, e, "hour")
    before = sorted(map(tuple, V.read_latest(spark, table, df.schema, key).collect()))
    for day in ("2024-01-03", "2024-01-03", "2024-01-04"):
        V.compact(spark, table, df.schema, key, "hour", day)
        assert sorted(map(tuple, V.read_latest(spark, table, df.schema, key).collect())) == before
    assert V.read_versions(spark, table, df.schema).filter("date < '2024-01-04'").count() == 6
    V.write_epoch(df.limit(1).withColumn("value", F.lit(-5.0)), table, 4, "hour")
    assert V.read_latest(spark, table, df.schema, key).filter("value = -5.0").count() == 1


def test_readers_of_a_table_that_is_not_there_yet(spark, tmp_path):
    schema = spark.createDataFrame([], READINGS).schema
    assert V.read_latest(spark, str(tmp_path / "none"), schema, ["datetime"]).count() == 0
