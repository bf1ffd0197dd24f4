"""Metrics, PSI, dedup, standardize, payloads, runs: edge cases from the
fixtures list, checked against small NumPy/pandas models."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.functions.metrics import align_predictions, compare_models, regression_metrics
from sensorspark.operators import clean as C
from sensorspark.operators import drift as D
from sensorspark.operators import quantiles as Q
from sensorspark.operators import ingest as I
from sensorspark.plans import forecast as FC
from sensorspark.plans import runs as RU
from sensorspark.sources import measurements as S


def np_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    e = p - y
    mse = np.mean(e ** 2)
    sst = np.sum((y - y.mean()) ** 2)
    ssr = np.sum(e ** 2)
    r2 = (1.0 if ssr == 0 else 0.0) if sst == 0 else 1 - ssr / sst
    den = np.maximum(np.abs(y), 1.0)
    ioa = 1 - ssr / (np.sum((np.abs(p - y.mean()) + np.abs(y - y.mean())) ** 2) + 1e-8)
    return dict(mse=mse, rmse=np.sqrt(mse), mae=np.mean(np.abs(e)), r2=r2,
                mape=np.mean(np.abs(e) / den) * 100, within_25pct=np.mean(np.abs(e) / den <= 0.25) * 100,
                within_50=np.mean(np.abs(e) <= 50) * 100, bias=np.mean(e), index_of_agree=ioa)


@pytest.mark.parametrize("y,p", [
    ([0.0, 0.5, 10.0, 80.0], [1.0, 0.0, 12.0, 20.0]),     # y = 0: denominator floor
    ([5.0, 5.0, 5.0], [5.0, 5.0, 5.0]),                   # constant y, perfect
    ([5.0, 5.0, 5.0], [4.0, 5.0, 6.0]),                   # constant y, not perfect
    ([42.0], [40.0]),                                     # one row
])
def test_regression_metrics(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "y double, pred double")
    got = regression_metrics(df).first().asDict()
    for k, v in np_metrics(y, p).items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12), k


def test_compare_models_claim(spark):
    """Errors of 4 and 2 units: the mean squared error falls from 16 to 4."""
    y = [10.0, 30.0, 20.0, 60.0]
    rows = [(v, v + s * 4, v - s * 2) for v, s in zip(y, (1, -1, 1, -1))] + [(None, 1.0, 1.0), (5.0, None, 5.0)]
    r = compare_models(spark.createDataFrame(rows, "y double, b double, h double"), "y", "b", "h").first()
    assert r["n"] == 4 and r["baseline_mse"] == 16.0 and r["candidate_mse"] == 4.0
    assert r["mse_improvement_pct"] == pytest.approx(75.0) and r["mae_improvement_pct"] == pytest.approx(50.0) and r["meets_claim"]
    same = compare_models(spark.createDataFrame([(1.0, 2.0, 2.0)], "y double, b double, h double"), "y", "b", "h").first()
    assert same["mse_improvement_pct"] == 0.0 and not same["meets_claim"]


def test_align_predictions_by_key(spark):
    """The tables come in different orders and with different gaps."""
    truth = spark.createDataFrame([(k, 10.0 * k) for k in range(5)], "t long, y double")
    one = spark.createDataFrame([(3, 33.0), (1, 11.0), (2, 22.0), (9, 0.0)], "t long, pred double")
    two = spark.createDataFrame([(2, 20.5), (3, 30.5), (4, 40.5)], "t long, pred double")
    got = sorted(tuple(r) for r in align_predictions(truth, one, two, ["t"]).collect())
    assert got == [(2, 20.0, 22.0, 20.5), (3, 30.0, 33.0, 30.5)]
    left = {r["t"]: (r["pred_baseline"], r["pred_candidate"]) for r in align_predictions(truth, one, two, ["t"], how="left").collect()}
    assert left == {0: (None, None), 1: (11.0, None), 2: (22.0, 20.5), 3: (33.0, 30.5), 4: (None, 40.5)}


def _psi(ref_counts, cur_counts):
    """PSI worked out from bin counts."""
    shares = [[max(c / sum(side), 1e-10) for c in side] for side in (ref_counts, cur_counts)]
    return sum((c - r) * np.log(c / r) for r, c in zip(*shares))


def test_psi_from_counts(spark):
    """1..100 has the edges 10.9, 20.8 ... 90.1, hence ten values a bin; the
    counts of the other columns are as simple to see."""
    ref = [(float(i + 1), 3.0, float(i % 2), float(i + 1) if i >= 50 else None, "s", 1.0) for i in range(100)]
    cur = [(float(min(100, 2 * i + 1)), 3.0 + (i % 4 - 1), float(i % 2), float(i + 51), 1.0) for i in range(50)]
    rdf = spark.createDataFrame(ref, "even double, const double, two double, withnull double, label string, only_ref double")
    cdf = spark.createDataFrame(cur, "even double, const double, two double, withnull double, only_cur double")
    got = {r["feature"]: r["psi"] for r in D.psi_by_feature(rdf, cdf).collect()}
    assert set(got) == {"even", "const", "two", "withnull"}      # string and one-sided columns are skipped
    assert got["even"] == pytest.approx(_psi([10] * 10, [5] * 10))                     # odd numbers: five a bin
    # all edges are 3: what is below falls into the first bin, the rest into the last
    assert got["const"] == pytest.approx(_psi([0] * 9 + [100], [13] + [0] * 8 + [37]))
    assert got["two"] == pytest.approx(0.0)
    assert got["withnull"] == pytest.approx(_psi([5] * 10, [5] * 10))
    empty = cdf.filter("false")
    assert D.psi_by_feature(rdf, empty).count() == 0
    s = D.psi_summary(D.psi_by_feature(rdf, empty)).first()
    assert s["psi_score"] == 0.0 and s["recommendation"] == "skip" and not s["judged"]


def test_too_few_features_are_not_judged(spark):
    psi = spark.createDataFrame([(f"f{i}", 0.9) for i in range(4)], "feature string, psi double")
    assert tuple(D.psi_summary(psi).first()) == (0.0, 4, False, "none", "skip")
    assert tuple(D.psi_summary(psi, min_features=4).first()) == (pytest.approx(0.9), 4, True, "significant", "retrain")


POINTS = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]


def quantile_frame(spark, n):
    rng = np.random.default_rng(n)
    cols = {"cont": rng.normal(0, 1, n).tolist(), "ties": rng.integers(0, 5, n).astype(float).tolist(), "const": [2.5] * n,
            "heavy": [7.0 if rng.random() < 0.9 else float(rng.normal(7, 3)) for _ in range(n)],
            "holes": [None if i % 3 == 0 else float("nan") if i % 3 == 1 and n > 2 else float(rng.normal()) for i in range(n)]}
    return spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(3), cols


@pytest.mark.parametrize("n,most", [(1, 10), (2, 1), (7, 2), (216, 20), (3000, 40), (3000, 1_000_000)])
def test_bracketed_quantiles_are_exact(spark, n, most):
    df, cols = quantile_frame(spark, n)
    want = {c: [x for x in v if x is not None and x == x] for c, v in cols.items()}
    for small in (0, 1_000_000):
        got = Q.exact_quantiles(df, list(cols), POINTS, accuracy=100, small=small, most=most)
        for c, v in want.items():
            assert got[c][0] == len(v)
            assert got[c][1] == (pytest.approx([np.percentile(v, 100 * p) for p in POINTS], abs=1e-12) if v else None)


def test_narrowing_bounds_what_is_put_in_order(spark):
    """Three scans of a table whose brackets are small; no bracket of unlike
    values over the limit goes to one task."""
    df, cols = quantile_frame(spark, 3000)
    scans, ordered = [], []
    with pytest.MonkeyPatch.context() as m:
        for f in ("_sketch", "_count", "_order"):
            real = getattr(Q, f)

            def spy(d, b, *a, real=real, f=f):
                scans.append(f)
                if f == "_order":
                    ordered.extend(b)
                return real(d, b, *a)
            m.setattr(Q, f, spy)
        Q.exact_quantiles(df, list(cols), POINTS, small=0)
        assert scans == ["_sketch", "_count", "_order"]
        ordered.clear()
        Q.exact_quantiles(df, ["cont", "holes"], POINTS, accuracy=100, small=0, most=30)
        assert ordered and all(b.inside <= 30 for b in ordered)
        ordered.clear()
        Q.exact_quantiles(df, ["heavy"], [0.3, 0.5, 0.6], accuracy=100, small=0, most=30)
        assert all(b.lo == b.hi == 7.0 for b in ordered)


def test_a_wrong_sketch_is_found_out(spark, monkeypatch):
    df, cols = quantile_frame(spark, 216)
    monkeypatch.setattr(Q, "_sketch", lambda d, c, p, a: ([216], [[5.0, 6.0] * len(p)]))
    assert Q.exact_quantiles(df, ["cont"], POINTS, accuracy=100, small=0, most=10)["cont"][1] == pytest.approx(
        [np.percentile(cols["cont"], 100 * p) for p in POINTS], abs=1e-12)


def test_quantiles_of_an_empty_table(spark):
    df, _ = quantile_frame(spark, 7)
    assert Q.exact_quantiles(df.filter("false"), ["cont"], POINTS, small=0) == {"cont": (0, None)}
    assert D.describe_numeric(df.filter("false"), ["cont"]).count() == 0 and D.psi_edges(df.filter("false"), ["cont"]).count() == 0


def test_saved_baseline(spark, tmp_path):
    path = str(tmp_path / "base")
    cols = ["a", "b", "c", "d", "e"]
    ref = spark.createDataFrame([tuple(float(i * (k + 1)) for k in range(5)) for i in range(200)], ", ".join(f"{c} double" for c in cols))
    first = D.drift_against_baseline(ref, path).first()
    assert first["first_run"] and first["recommendation"] == "retrain" and first["features_analyzed"] == 5
    again = D.drift_against_baseline(ref, path).first()
    assert not again["first_run"] and again["psi_score"] == pytest.approx(0.0) and again["recommendation"] == "skip"
    moved = ref.select(*[(F.col(c) + 100.0).alias(c) for c in cols], F.lit(1.0).alias("new"))
    want = D.psi_summary(D.psi_by_feature(ref, moved)).first()
    got = D.drift_against_baseline(moved, path).first()
    assert got["psi_score"] == pytest.approx(want["psi_score"]) and got["features_analyzed"] == 5 and got["recommendation"] == "retrain"
    assert not D.drift_against_baseline(ref.select("a", "b"), path).first()["judged"]
    profile = {r["feature"]: r["mean"] for r in spark.read.parquet(path).collect()}
    assert profile["a"] == pytest.approx(99.5)


def test_dedup_keeps_first_shard(spark):
    t = datetime(2024, 1, 2)
    rows = [(t, "pm25", "a", 1.0, "m_20240108_20240116", 5), (t, "pm25", "a", 2.0, "m_20240101_20240109", 9),
            (t, "pm10", "a", 3.0, "m_20240101_20240109", 1)]
    df = spark.createDataFrame(rows, "datetime timestamp, parameter string, location string, value double, shard string, arrival long")
    out = {(r["parameter"]): r["value"] for r in I.dedup_first(df).collect()}
    assert out == {"pm25": 2.0, "pm10": 3.0}
    dc = I.duplicate_count(df).first()
    assert dc["duplicates_removed"] == 1


def test_standardize_fills_unit_and_utc(spark):
    rows = [("2024-01-01T05:30:00+05:30", 1.0, "pm25", 7, "28.5", "77.1"), ("2024-01-01 00:00:00", 2.0, "xyz", 8, "1", "2")]
    df = spark.createDataFrame(rows, "datetime string, value double, parameter string, location int, latitude string, longitude string")
    out = C.standardize(df).orderBy("value").collect()
    assert out[0]["datetime"] == datetime(2024, 1, 1, 0, 0) and out[0]["unit"] == "µg/m³"
    assert out[1]["unit"] is None and out[0]["location"] == "7" and out[0]["latitude"] == 28.5
    assert C.validate_columns(df.drop("value")) == ["value", "unit"]
    assert C.validate_columns(C.standardize(df)) == []


def test_flatten_payloads(spark, tmp_path):
    recs = [
        {"location": {"id": 1, "name": "A", "coordinates": {"latitude": 28.6, "longitude": 77.2}},
         "sensor": {"id": 10, "parameter": {"name": "PM25", "units": "µg/m³"}},
         "measurements": [{"value": 5.0, "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}},
                          {"value": 6.0, "period": {"datetimeFrom": "2024-01-01T01:00:00Z"}},
                          {"value": 7.0, "period": {}}]},
        {"location": {"id": 2, "name": "B"},
         "sensor": {"id": 11, "parameter": {"name": "so2", "units": "ppb"}},
         "measurements": [{"value": 1.0, "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}}]},
        {"location": {"id": 3, "name": "C"},
         "sensor": {"id": 12, "parameter": {"name": "o3", "units": "ppm"}},
         "measurements": [{"value": 2.0, "period": {"datetimeFrom": {"utc": "2024-01-01T02:00:00Z"}}}]},
    ]
    p = tmp_path / "payload.json"
    p.write_text("\n".join(json.dumps(r) for r in recs))
    out = S.flatten_payloads(S.read_payloads(spark, str(p)), ["pm25", "o3"]).orderBy("datetime").collect()
    assert [r["value"] for r in out] == [5.0, 6.0, 2.0]      # missing time skipped, so2 filtered
    assert out[0]["parameter"] == "pm25" and out[2]["latitude"] is None


def test_champion_rule(spark):
    rows = [("r1", datetime(2024, 1, 1), 10.0), ("r2", datetime(2024, 1, 2), 10.0),
            ("r3", datetime(2024, 1, 3), 9.0), ("r4", datetime(2024, 1, 4), 9.5)]
    df = spark.createDataFrame(rows, "run_id string, run_ts timestamp, candidate_rmse double")
    got = {r["run_id"]: r["promoted"] for r in RU.champion_history(df).collect()}
    assert got == {"r1": True, "r2": False, "r3": True, "r4": False}


def test_upsert_latest_wins(spark):
    a = spark.createDataFrame([("r1", datetime(2024, 1, 1), 1.0), ("r2", datetime(2024, 1, 2), 2.0)],
                              "run_id string, run_ts timestamp, v double")
    b = spark.createDataFrame([("r2", datetime(2024, 1, 2, 1), 5.0), ("r3", datetime(2024, 1, 3), 3.0)],
                              "run_id string, run_ts timestamp, v double")
    got = {r["run_id"]: r["v"] for r in RU.runs_upsert(a, b).collect()}
    assert got == {"r1": 1.0, "r2": 5.0, "r3": 3.0}


def test_offset_strings_are_shifted_once(spark):
    rows = [("2024-01-01T00:00:00+05:30",), ("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:00",), ("2024-01-01",), ("2024-01-01T00:00:00.25-0300",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(F.date_format(C.to_utc(F.col("t"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2023-12-31 18:30", "2024-01-01 00:00", "2023-12-31 18:30", "2023-12-31 18:30", "2024-01-01 03:00"]
    full = spark.createDataFrame([(datetime(2024, 1, 1), 1.0, "pm25", "a", 1.0, 2.0)],
                                 "datetime timestamp, value double, parameter string, location string, latitude double, longitude double")
    one = C.standardize(full, "Asia/Kolkata").select(F.date_format("datetime", "yyyy-MM-dd HH:mm")).first()[0]
    assert one == "2024-01-01 00:00"                                 # an instant already
    ntz = C.standardize(full.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")), "Asia/Kolkata")
    assert ntz.select(F.date_format("datetime", "yyyy-MM-dd HH:mm")).first()[0] == "2023-12-31 18:30"


def test_bbox_and_radius(spark):
    rows = [(f"loc_{k:02}", 28.4 + 0.02 * k, 76.8 + 0.02 * k) for k in range(30)]
    df = spark.createDataFrame(rows, "location string, latitude double, longitude double")
    assert C.bbox_filter(df).count() == 26                           # no limit on the locations
    assert sorted(r[0] for r in C.bbox_filter(df, limit=3).collect()) == ["loc_00", "loc_01", "loc_02"]
    assert 0 < C.radius_filter(df, 28.4, 76.8, 25000).count() < 30
    with pytest.raises(ValueError):
        C.radius_filter(df, 28.4, 76.8, 25001)


def test_pivot_columns_are_the_callers(spark):
    from sensorspark.operators.resample import hourly_wide, pivot_mean
    t = datetime(2024, 1, 1)
    m = spark.createDataFrame([(t, "so2", 4.0), (t, "pm25", 1.0)], "datetime timestamp, parameter string, value double")
    assert hourly_wide(m, ["so2"]).first()["so2"] == 4.0 and pivot_mean(m, ["pm25", "so2"]).first()["so2"] == 4.0
    with pytest.raises(TypeError):
        hourly_wide(m)


def test_column_difference(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 2)], "y int, z int")
    assert C.column_set_diff(a, b) == {"match": False, "only_left": ["x"], "only_right": ["z"]}
    assert C.column_set_diff(a, a)["match"] and C.common_columns(a, b) == ["y"]


def test_recursive_forecast(spark):
    """y = y 168 hours ago: the forecast repeats the last week."""
    f = spark.createDataFrame([(s, p, datetime(2024, 1, 1) + timedelta(hours=p), float(p)) for s, n in (("long", 200), ("short", 100)) for p in range(n)]
                              + [("holes", p, datetime(2024, 1, 1) + timedelta(hours=p), 1.0) for p in range(0, 400, 2)],
                              "s string, pos long, datetime timestamp, pm25 double")
    model = spark.createDataFrame([(s, 0.0, 1.0) for s in ("long", "short", "holes")], "s string, intercept double, lag_168 double")
    got = {(r["s"], r["h"]): r["forecast"] for r in FC.recursive_forecast(f, model, [168], 3, series_cols=("s",)).collect()}
    assert [got["long", h] for h in (1, 2, 3)] == [32.0, 33.0, 34.0]
    assert all(got[s, h] is None for s in ("short", "holes") for h in (1, 2, 3))
    two = spark.createDataFrame([(1.0, 0.5, 0.25)], "intercept double, lag_1 double, lag_3 double")
    one = f.filter("s = 'long'").drop("s")
    y = [float(p) for p in range(200)]
    for _ in range(5):
        y.append(1.0 + 0.5 * y[-1] + 0.25 * y[-3])
    rows = FC.recursive_forecast(one, two, [1, 3], 5).orderBy("h").collect()
    assert [r["forecast"] for r in rows] == pytest.approx(y[200:]) and rows[0]["ts"] == datetime(2024, 1, 1) + timedelta(hours=200)


def test_two_lag_fit(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 80), rng.normal(0, 1, 80)
    y = 2.0 + 0.5 * a - 0.25 * b + rng.normal(0, 0.1, 80)
    rows = [(float(u), float(v), float(w), "train" if i < 60 else "test") for i, (u, v, w) in enumerate(zip(a, b, y))]
    r = FC.ar_fit(spark.createDataFrame(rows, "l1 double, l2 double, y double, split string"), {1: "l1", 24: "l2"}).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(60), a[:60], b[:60]]), y[:60], rcond=None)[0]
    assert [r["intercept"], r["lag_1"], r["lag_24"]] == pytest.approx(want) and r["n_train"] == 60


def test_scoring_keeps_rows_with_nulls(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (40, 2))
    y = x @ [2.0, -1.0] + 0.5
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0)], "a double, b double, y_scaled double")
    va, model, left_out = FC.fit_linear_forecaster(df, ["a", "b"])
    out = FC.batch_score(df, va, model).collect()
    assert left_out == 1 and len(out) == 41
    for r in out:
        if r["a"] is None:
            assert r["pred_scaled"] is None
        else:
            assert r["pred_scaled"] == pytest.approx(2 * r["a"] - r["b"] + 0.5, abs=1e-6)


def test_fetch_plan(spark):
    s = spark.createDataFrame([(datetime(2024, 1, 5, 12), "m_20240105_20240110")], "datetime timestamp, shard string")
    plan = lambda *a, **k: tuple(I.fetch_plan(*a, **k).select("days", "label", "status").first())
    assert plan(s, "2024-01-06 11:00:00") == (0, "m_20240105_20240106", "skipped")
    assert plan(s, "2024-01-06 11:00:00", force=True)[2] == "fetch"
    assert plan(s, "2024-01-10 12:00:00") == (5, "m_20240105_20240110", "stored")
    assert plan(s, "2024-01-11 00:00:00") == (5, "m_20240105_20240111", "fetch")
    assert plan(s.filter("false"), "2024-04-01 00:00:00") == (90, "m_20240102_20240401", "fetch")


def test_dedup_by_one_order_column_needs_no_sort(spark):
    t = datetime(2024, 1, 2)
    df = spark.createDataFrame([(t, "p", "a", 1.0, 7), (t, "p", "a", 2.0, 3), (t, "q", "a", None, 5)],
                               "datetime timestamp, parameter string, location string, value double, arrival long")
    out = I.dedup_first(df, order=("arrival",))
    assert sorted(((r["parameter"], r["value"], r["arrival"]) for r in out.collect())) == [("p", 2.0, 3), ("q", None, 5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_r2_of_a_truth_that_is_constant_up_to_rounding(spark):
    """The mean of equal doubles need not equal them in the last digit."""
    for y in (0.1, 22.752048, 1e-9, 3e7 + 0.1):
        df = spark.createDataFrame([(y, y + 1.0, y) for _ in range(87)], "y double, a double, b double").repartition(5)
        m = compare_models(df, "y", "a", "b").first()
        assert (m.baseline_r2, m.candidate_r2) == (0.0, 1.0)
    df = spark.createDataFrame([(1e6 + i * 1e-3, 1e6) for i in range(50)], "y double, pred double")
    assert regression_metrics(df).first().r2 < 0.5           # small, but a variance
