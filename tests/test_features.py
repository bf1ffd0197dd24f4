"""Features, windows, split and scalers against their definitions."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import windows as W
from sensorspark.operators.features import (feature_columns, feature_table, input_columns,
                                            sequence_windows)

T0 = datetime(2024, 1, 1)
PARAMS = ["pm25", "pm10", "no2", "o3"]


def _wide(n, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"hour": [T0 + timedelta(hours=i) for i in range(n)]})
    for p in PARAMS:
        v = rng.normal(60, 15, n).round(2)
        if gaps:
            v[rng.random(n) < 0.2] = np.nan
        v[0] = 50.0
        v[-1] = 55.0
        pdf[p] = v
    return pdf


def _filled(v):
    """Gap fill by its closed form: a reading stays; up to 6 hours after a
    reading lie on the line to the next one, hours 7 to 9 keep the 6th; what is
    left takes the next reading."""
    out = list(v)
    known = [i for i, x in enumerate(v) if not np.isnan(x)]
    for i, x in enumerate(v):
        if not np.isnan(x):
            continue
        before, after = [k for k in known if k < i], [k for k in known if k > i]
        if before and i - before[-1] <= 9:
            a = before[-1]
            out[i] = v[a] + (v[after[0]] - v[a]) * min(i - a, 6) / (after[0] - a) if after else v[a]
        else:
            out[i] = v[after[0]] if after else np.nan
    return out


def _expected(pdf):
    """Feature rows from their definitions, hour by hour: values k hours back,
    mean and sample deviation of the last w hours, angles of the calendar."""
    col = {p: _filled(pdf[p].to_numpy()) for p in PARAMS}
    rows = {}
    for i, t in enumerate(pdf["hour"]):
        if i < 72:
            continue                                    # no value 72 hours back
        r = {p: col[p][i] for p in PARAMS}
        for name in feature_columns():
            parts = name.split("_")
            if "lag" in parts:
                r[name] = col[parts[0]][i - int(parts[2][:-1])]
            elif "rmean" in parts or "rstd" in parts:
                last = col["pm25"][i - int(parts[2][:-1]) + 1:i + 1]
                mean = sum(last) / len(last)
                r[name] = mean if "rmean" in parts else (sum((x - mean) ** 2 for x in last) / (len(last) - 1)) ** 0.5
        for name, value, period in (("hour", t.hour, 24), ("dow", t.weekday(), 7), ("month", t.month, 12)):
            angle = 2 * np.pi * value / period
            r[f"{name}_sin"], r[f"{name}_cos"] = np.sin(angle), np.cos(angle)
        rows[t] = r
    return pd.DataFrame.from_dict(rows, orient="index")


def _to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype({p: float for p in PARAMS})).withColumn(
        "hour", F.col("hour").cast("timestamp"))


@pytest.mark.parametrize("block", [720, 50])
def test_feature_table_matches_definitions(spark, block):
    pdf = _wide(400)
    got = feature_table(_to_spark(spark, pdf), block=block).orderBy("datetime").toPandas()
    exp = _expected(pdf)
    assert len(got) == len(exp)
    for c in feature_columns():
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float),
                                   rtol=1e-9, atol=1e-9, err_msg=c)


def test_windows_split_and_scaler(spark):
    pdf = _wide(330, seed=3)
    hourly = _to_spark(spark, pdf)
    exp = _expected(pdf)
    T = 72
    X = exp[input_columns()].to_numpy()
    y = exp["pm25"].to_numpy()
    n = len(X) - T
    got = W.chrono_split(sequence_windows(feature_table(hourly, block=64), block=64)).orderBy("ts").toPandas()
    assert len(got) == n
    np.testing.assert_allclose(got["y"].to_numpy(dtype=float), y[T:])
    first = np.array([r[0]["pm10"] for r in got["x"]])
    np.testing.assert_allclose(first, exp["pm10"].to_numpy()[:n])
    assert all(len(r) == T for r in got["x"])
    n_tr, n_va = int(n * 0.70), int(n * 0.15)
    assert (got["split"] == "train").sum() == n_tr
    assert (got["split"] == "val").sum() == n_va
    # scaler fitted by weights equals the scaler fitted on stacked train windows
    stacked = np.concatenate([X[i:i + T] for i in range(n_tr)])
    feats = feature_table(hourly, block=64)
    sc = W.fit_feature_scaler(feats, input_columns(), T).toPandas().set_index("feature")
    mu, sd = stacked.mean(axis=0), stacked.std(axis=0)
    sd[sd < 1e-12] = 1.0      # sklearn treats near-zero scales as zero
    np.testing.assert_allclose(sc.loc[input_columns(), "mean"].to_numpy(dtype=float), mu, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(sc.loc[input_columns(), "scale"].to_numpy(dtype=float), sd, rtol=1e-9)


def test_window_boundaries(spark):
    # valid feature rows = hours - 72; T = 3: 3 rows -> no window, 4 rows -> one
    for hours, expected in ((75, 0), (76, 1)):
        pdf = _wide(hours, gaps=False)
        got = sequence_windows(feature_table(_to_spark(spark, pdf)), seq_length=3).count()
        assert got == expected


def test_split_sizes(spark):
    df = spark.createDataFrame([(90,), (0,), (1,), (170,)], "n long")
    tr, va = W.split_sizes(F.col("n"))
    rows = {r["n"]: (r["tr"], r["va"]) for r in df.select("n", tr.alias("tr"), va.alias("va")).collect()}
    assert rows[90] == (62, 13)          # int(90*0.7) = 62 in double arithmetic, not 63
    assert rows[0] == (0, 0) and rows[1] == (0, 0)
    assert rows[170] == (int(170 * 0.7), int(170 * 0.15))


def test_constant_feature_scale_is_one(spark):
    pdf = _wide(200, gaps=False)
    pdf["o3"] = 7.0
    feats = feature_table(_to_spark(spark, pdf))
    sc = W.fit_feature_scaler(feats, ["o3", "pm25_rstd_24h"], 72).toPandas().set_index("feature")
    assert sc.loc["o3", "scale"] == 1.0


def test_calendar_monday_zero(spark):
    from sensorspark.operators.features import cyclic_exprs
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 7),)], "t timestamp")
    r = df.select(F.weekday("t").alias("d"), *cyclic_exprs(F.col("t"))).collect()
    assert r[0]["d"] == 0 and r[1]["d"] == 6
    assert r[0]["dow_sin"] == pytest.approx(0.0)


def test_split_and_scaler_with_interior_holes(spark):
    """Hours 50..59 and 120 are missing: the split goes by rank, the scaler by
    the train windows that exist."""
    T = 6
    pos = [i for i in range(160) if not 50 <= i < 60 and i != 120]
    rng = np.random.default_rng(11)
    x = {i: float(rng.normal(5, 2)) for i in pos}
    f = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=i), x[i], 3.25e6) for i in pos], "pos long, datetime timestamp, pm25 double, flat double")
    targets = [i for i in pos if all(k in x for k in range(i - T, i))]
    n = len(targets)
    w = f.filter(F.col("pos").isin(targets)).select("pos", F.col("datetime").alias("ts"), F.col("pm25").alias("y"))
    got = {r["pos"]: (r["widx"], r["split"]) for r in W.chrono_split(w).collect()}
    n_tr, n_va = int(n * 0.70), int(n * 0.15)
    assert got == {p: (k, "train" if k < n_tr else "val" if k < n_tr + n_va else "test") for k, p in enumerate(targets)}
    stacked = [x[k] for p in targets[:n_tr] for k in range(p - T, p)]
    for block in (720, 16):
        weights = {r["pos"]: r["_w"] for r in W.train_weights(f, T, block=block).collect()}
        assert weights == {k: c for k in pos if (c := sum(p - T <= k < p for p in targets[:n_tr]))}
    sc = {r["feature"]: (r["mean"], r["scale"]) for r in W.fit_feature_scaler(f, ["pm25", "flat"], T).collect()}
    assert sc["pm25"] == (pytest.approx(np.mean(stacked)), pytest.approx(np.std(stacked)))
    assert sc["flat"] == (pytest.approx(3.25e6), 1.0)


def test_scaler_keeps_tiny_but_real_spreads(spark):
    """A spread of 1e-13 around zero is no rounding."""
    f = spark.createDataFrame([(i, 1e-13 * (i % 2)) for i in range(60)], "pos long, tiny double")
    r = W.fit_feature_scaler(f, ["tiny"], 5).first()
    assert r["scale"] == pytest.approx(5e-14, rel=0.05)


def test_series_rank_across_blocks(spark):
    from sensorspark.operators.blocks import series_rank
    rows = [(s, p) for s in ("a", "b") for p in (3, 4, 9, 17, 18, 40)]
    got = {(r["s"], r["pos"]): r["_rank"] for r in series_rank(spark.createDataFrame(rows, "s string, pos long"), ("s",), block=8).collect()}
    assert got == {(s, p): k for s in ("a", "b") for k, p in enumerate((3, 4, 9, 17, 18, 40))}


def test_window_last_row(spark):
    f = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=i), float(i), 10.0 * i) for i in range(12)],
                              "pos long, datetime timestamp, pm25 double, o3 double")
    got = sequence_windows(f, seq_length=4, block=5, with_x=False, last=["o3"]).collect()
    assert {r["pos"]: r["x_o3"] for r in got} == {i: 10.0 * (i - 1) for i in range(4, 12)}
