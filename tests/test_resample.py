"""Hourly resample, spine and gap fill against closed forms, including block edges."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.constants import PARAMETERS
from sensorspark.operators import resample as R

T0 = datetime(2024, 1, 1)


def _hourly_df(spark, values):
    rows = [(T0 + timedelta(hours=i), v) for i, v in enumerate(values)]
    pdf = pd.DataFrame(rows, columns=["hour", "pm25"])
    pdf = pdf[pdf.pm25.notna()]
    df = spark.createDataFrame(pdf).withColumn("hour", F.col("hour").cast("timestamp"))
    for p in ("pm10", "no2", "o3"):
        df = df.withColumn(p, F.lit(1.0))
    return df


def _expected_fill(values):
    """The span between the first and last reading, gaps filled by the closed
    form: up to 6 hours along the line to the next reading, hours 7 to 9 keep
    the 6th, the rest takes the next reading (the last one at the end)."""
    v = [float(x) for x in values]
    known = [i for i, x in enumerate(v) if not np.isnan(x)]
    out = []
    for i in range(known[0], known[-1] + 1):
        a = max(k for k in known if k <= i)
        b = min(k for k in known if k >= i)
        out.append(v[i] if a == i else v[b] if i - a > 9 else v[a] + (v[b] - v[a]) * min(i - a, 6) / (b - a))
    return np.array(out)


def _series_with_gaps():
    vals = [np.nan] * 3 + [1.0, 2.0]                    # leading gap
    for gap in (1, 6, 7, 9, 10, 12):
        vals += [np.nan] * gap + [float(gap * 3), float(gap * 3 + 1)]
    vals += [np.nan] * 9 + [5.0] + [np.nan] * 10 + [7.0]
    return vals


@pytest.mark.parametrize("block", [720, 16, 11])
def test_gap_fill_matches_closed_form(spark, block):
    vals = _series_with_gaps()
    got = R.gap_fill(_hourly_df(spark, vals), block=block).orderBy("datetime").toPandas()
    exp = _expected_fill(vals)
    assert len(got) == len(exp)
    np.testing.assert_allclose(got["pm25"].to_numpy(dtype=float), exp, rtol=1e-12, atol=1e-12)


def test_gap_fill_random_series(spark):
    rng = np.random.default_rng(42)
    for _ in range(3):
        n = 300
        v = rng.normal(50, 10, n)
        v[rng.random(n) < 0.45] = np.nan
        v[0] = 1.0
        v[-1] = 2.0
        got = R.gap_fill(_hourly_df(spark, list(v)), block=24).orderBy("datetime").toPandas()
        np.testing.assert_allclose(got["pm25"].to_numpy(dtype=float), _expected_fill(v), rtol=1e-12)


def test_trailing_gap_stays_null(spark):
    # the trailing gap belongs to another parameter: pm10 ends early
    vals = [1.0] * 30
    df = _hourly_df(spark, vals).withColumn(
        "pm10", F.when(F.col("hour") < F.lit(T0 + timedelta(hours=15)), F.lit(2.0)))
    got = R.gap_fill(df, block=8).orderBy("datetime").toPandas()
    pm10 = got["pm10"].to_numpy(dtype=float)
    assert np.all(pm10[:24] == 2.0)          # 9 trailing steps filled (6 interp-as-hold + 3 ffill)
    assert np.all(np.isnan(pm10[24:]))       # the 10th and later stay NULL


def test_hourly_mean_is_mean_of_means(spark):
    rows = [(T0, "pm25", 1.0, "a"), (T0, "pm25", 3.0, "b"), (T0 + timedelta(minutes=10), "pm25", 8.0, "a")]
    m = spark.createDataFrame(rows, "datetime timestamp, parameter string, value double, location string")
    h = R.hourly_wide(m, PARAMETERS).collect()
    assert len(h) == 1 and h[0]["pm25"] == pytest.approx(5.0)   # flat mean would be 4.0


def test_spine_ignores_null_only_hour(spark):
    rows = [(T0, "pm25", 1.0), (T0 + timedelta(hours=2), "pm25", 3.0), (T0 + timedelta(hours=5), "pm25", None)]
    m = spark.createDataFrame(rows, "datetime timestamp, parameter string, value double")
    g = R.gap_fill(R.hourly_wide(m, PARAMETERS)).orderBy("datetime").toPandas()
    assert len(g) == 3                        # hours 0..2, the NULL-only hour 5 does not extend it
    assert g["pm25"].tolist() == [1.0, 2.0, 3.0]


def test_pivot_and_hour_spine(spark):
    rows = [(T0, "pm25", 1.0), (T0, "no2", 4.0), (T0 + timedelta(hours=3), "pm25", 2.0)]
    m = spark.createDataFrame(rows, "datetime timestamp, parameter string, value double")
    p = R.pivot_mean(m, PARAMETERS).orderBy("datetime").collect()
    assert p[0]["no2"] == 4.0 and p[1]["no2"] is None
    sp = R.hour_spine(R.hourly_wide(m, PARAMETERS)).orderBy("datetime").toPandas()
    assert len(sp) == 4 and sp["pm25"].isna().sum() == 2
