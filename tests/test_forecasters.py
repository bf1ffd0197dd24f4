"""Least squares, boosted trees, feature recursion and the ``pyspark.ml`` model
against NumPy."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.constants import CROSS_LAGS, CROSS_PARAMS, PARAMETERS, ROLLING_WINDOWS, TARGET, TARGET_LAGS
from sensorspark.operators.features import feature_columns, input_columns
from sensorspark.plans import boosting as BO
from sensorspark.plans import catalog
from sensorspark.plans import least_squares as LS
from sensorspark.plans import recursion as RC

SF = "/root/testdata/sf0.001"


def regression_rows(seed, n, k, series=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for s in series:
        x = rng.normal(5, 3, (n, k)) * np.arange(1, k + 1)
        y = x @ rng.normal(0, 1, k) + rng.normal(0, 0.5, n) + 7
        rows += [(s, float(t), *map(float, r)) for t, r in zip(y, x)]
    return rows


def table(spark, rows, k):
    return spark.createDataFrame(rows, ", ".join(["s string", "y double", *[f"x{i} double" for i in range(k)]])).repartition(4)


@pytest.mark.parametrize("k", [1, 2, 5, 12])
def test_least_squares_equals_numpy(spark, k):
    rows = regression_rows(k, 60, k)
    df = table(spark, rows + [("a", None, *[1.0] * k), ("b", 3.0, *[None] * k), ("empty", None, *[1.0] * k)], k)
    got = {r.s: r for r in LS.least_squares(df, [f"x{i}" for i in range(k)], "y", ["s"]).collect()}
    assert set(got) == {"a", "b"}
    for s, r in got.items():
        x = np.array([[1.0, *row[2:]] for row in rows if row[0] == s])
        want = np.linalg.lstsq(x, np.array([row[1] for row in rows if row[0] == s]), rcond=None)[0]
        assert r.n_train == 60 and [r.intercept, *r.coefficients] == pytest.approx(want.tolist(), rel=1e-8, abs=1e-8)
    pooled = LS.least_squares(df, ["x0"]).first()
    assert pooled.n_train == 120


def test_least_squares_of_dependent_and_constant_columns(spark):
    rows = [(s, y, x, 2 * x, 0.1, z) for s, y, x, z in regression_rows(3, 40, 2, ("a",))]
    r = LS.least_squares(table(spark, rows, 4), ["x0", "x1", "x2", "x3"], "y", ["s"]).first()
    assert r.coefficients[2] == 0.0
    pred = [r.intercept + sum(c * v for c, v in zip(r.coefficients, row[2:])) for row in rows]
    x = np.array([[1.0, row[2], row[5]] for row in rows])
    y = np.array([row[1] for row in rows])
    assert pred == pytest.approx((x @ np.linalg.lstsq(x, y, rcond=None)[0]).tolist(), rel=1e-3, abs=1e-3)     # the ridge splits the weight
    one = LS.least_squares(table(spark, rows[:1], 4), ["x0", "x3"], "y", ["s"]).first()
    assert one.coefficients == [0.0, 0.0] and one.intercept == rows[0][1]


def test_linear_score_is_null_without_model_or_input(spark):
    rows = regression_rows(4, 30, 2)
    df = table(spark, rows, 2)
    m = LS.least_squares(df.filter("s = 'a'"), ["x0", "x1"], "y", ["s"])
    out = LS.linear_score(df.unionByName(table(spark, [("a", 1.0, None, 2.0)], 2)), m, ["x0", "x1"], ["s"])
    assert out.count() == 61 and out.filter("pred IS NULL").count() == 31
    c = m.first()
    for r in out.filter("pred IS NOT NULL").collect():
        assert r.pred == pytest.approx(c.intercept + c.coefficients[0] * r.x0 + c.coefficients[1] * r.x1)


# ------------------------------------------------------------------ trees
def plain_boost(x, y, rounds, depth, rate, bins, min_rows):
    """Greedy trees over the same edges, on whole arrays."""
    edges = [np.unique(np.percentile(x[:, c], [100 * i / bins for i in range(1, bins)])) for c in range(x.shape[1])]
    pred = np.full(len(y), y.mean())
    score = lambda r: r.sum() ** 2 / len(r)

    def grow(at, res, level):
        if level < depth:
            gains = []
            for c in range(x.shape[1]):
                for e in edges[c]:
                    left = at[x[at, c] < e]
                    right = at[x[at, c] >= e]
                    if min(len(left), len(right)) >= min_rows:
                        gains.append((score(res[left]) + score(res[right]) - score(res[at]), c, e))
            best = max((g for g, _, _ in gains), default=0)
            for g, c, e in gains:
                if g > 1e-9 and g >= best * (1 - 1e-9):
                    grow(at[x[at, c] < e], res, level + 1)
                    grow(at[x[at, c] >= e], res, level + 1)
                    return
        step[at] = rate * res[at].mean()
    for _ in range(rounds):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), y - pred, 0)
        pred = pred + step
    return pred


@pytest.mark.parametrize("depth,rounds", [(1, 4), (2, 5), (3, 3)])
def test_boosted_trees_equal_plain_greedy_trees(spark, depth, rounds):
    rng = np.random.default_rng(depth)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.integers(0, 3, (150, 1)).astype(float)], axis=1)
    y = np.sin(x[:, 0]) + (x[:, 1] > 0.3) * x[:, 3] + rng.normal(0, 0.1, 150)
    cols = ["x0", "x1", "x2", "x3"]
    df = table(spark, [("a", float(t), *map(float, r)) for t, r in zip(y, x)], 4)
    m = BO.fit_boosted(df.unionByName(table(spark, [("a", 9.0, None, 1.0, 1.0, 1.0)], 4)), cols, "y", rounds, depth, 0.5, 8, 6)
    want = plain_boost(x, y, rounds, depth, 0.5, 8, 6)
    assert BO.boosted_predict(m, x) == pytest.approx(want, abs=1e-9)
    scored = {r.x0: r.pred for r in BO.boosted_score(df, m).collect()}
    assert [scored[v] for v in x[:, 0]] == pytest.approx(want.tolist(), abs=1e-9)
    assert ((want - y) ** 2).mean() < 0.5 * y.var()
    assert BO.boosted_score(table(spark, [("a", 1.0, None, 1.0, 1.0, 1.0)], 4), m).first().pred is None
    assert math.isnan(BO.boosted_predict(m, np.array([[np.nan, 1, 1, 1]]))[0])


def test_boosting_without_rows_or_splits(spark):
    df = table(spark, [("a", 2.0, 1.0)] * 8, 1)
    assert BO.fit_boosted(df.filter("false"), ["x0"]) is None
    m = BO.fit_boosted(df, ["x0"])
    assert m.trees == () and BO.boosted_score(df, m).first().pred == 2.0 and BO.boosted_score(df, None).first().pred is None


def test_a_tree_takes_one_pass_a_level(spark, monkeypatch):
    rows = regression_rows(5, 80, 3, ("a",))
    seen = []
    real = BO._grow
    monkeypatch.setattr(BO, "_grow", lambda r, *a: seen.append(re.findall("Exchange", r.groupBy().count()._jdf.queryExecution().executedPlan().toString())) or real(r, *a))
    BO.fit_boosted(table(spark, rows, 3), ["x0", "x1", "x2"], rounds=2)
    assert len(seen) == 2 and all(len(s) == 1 for s in seen)       # the rows themselves are not shuffled


# ------------------------------------------------------------------ recursion
def loop_forecast(hist, last_hour, predict, steps):
    """Hour by hour on plain lists."""
    h = {p: list(v) for p, v in hist.items()}
    out = []
    for i in range(steps):
        t = np.datetime64(0, "s") + np.timedelta64(int(last_hour + i) * 3600, "s")
        x = [h[p][-1] for p in sorted(PARAMETERS)] + [h[TARGET][-1 - k] for k in TARGET_LAGS]
        for w in ROLLING_WINDOWS:
            x += [np.mean(h[TARGET][-w:]), np.std(h[TARGET][-w:], ddof=1)]
        x += [h[p][-1 - k] for p in CROSS_PARAMS for k in CROSS_LAGS]
        d = t.astype(object)
        for v, n in ((d.hour, 24), (d.weekday(), 7), (d.month, 12)):
            x += [math.sin(2 * math.pi * v / n), math.cos(2 * math.pi * v / n)]
        y = predict(np.array([x]))[0]
        out.append(y)
        for p in h:
            h[p].append(y if p == TARGET else h[p][-1])
    return out


def panel(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, hist = [], {}
    for s, n, hole in (("a", 80, None), ("b", 73, None), ("short", 72, None), ("hole", 90, 60), ("nomodel", 75, None)):
        v = {p: rng.normal(50, 10, n) for p in PARAMETERS}
        hist[s] = {p: x[-73:] for p, x in v.items()}
        rows += [(s, 473_000 + i, *[float(v[p][i]) for p in sorted(PARAMETERS)]) for i in range(n) if i != hole]
    df = spark.createDataFrame(rows, "s string, pos long, " + ", ".join(f"{p} double" for p in sorted(PARAMETERS)))
    return df.withColumn("datetime", F.timestamp_seconds(F.col("pos") * 3600)), hist


def test_feature_recursion_equals_a_loop(spark):
    df, hist = panel(spark)
    rng = np.random.default_rng(1)
    width = len(feature_columns())
    coef = {s: rng.normal(0, 0.05, width) for s in ("a", "b", "short", "hole")}
    model = spark.createDataFrame([(s, 3.0, c.tolist()) for s, c in coef.items()], "s string, intercept double, coefficients array<double>")
    got = {}
    for r in RC.feature_forecast(df, model, 30, series_cols=["s"]).collect():
        got.setdefault(r.s, {})[r.h] = r.forecast
    assert {s: len(v) for s, v in got.items()} == dict.fromkeys(hist, 30)
    for s, n in (("a", 80), ("b", 73)):
        want = loop_forecast(hist[s], 473_000 + n - 1, lambda x: 3.0 + x @ coef[s], 30)
        assert [got[s][h] for h in range(1, 31)] == pytest.approx(want, rel=1e-9)
    for s in ("short", "hole", "nomodel"):
        assert set(got[s].values()) == {None}


def test_tree_recursion_equals_a_loop(spark):
    df, hist = panel(spark, 2)
    x = np.random.default_rng(3).normal(50, 10, (100, len(feature_columns())))
    m = BO.Boosted(tuple(feature_columns()), 50.0, tuple(BO.Split(c, 1, float(np.median(x[:, c])), -1.0 - c, 2.0 + c) for c in range(0, 20, 3)))
    got = {(r.s, r.h): r.forecast for r in RC.feature_forecast(df, m, 12, series_cols=["s"]).collect()}
    for s, n in (("a", 80), ("b", 73), ("nomodel", 75)):
        want = loop_forecast(hist[s], 473_000 + n - 1, lambda x: BO.boosted_predict(m, x), 12)
        assert [got[s, h] for h in range(1, 13)] == pytest.approx(want, rel=1e-9)
    assert got["short", 1] is None and got["hole", 5] is None


# ------------------------------------------------------------------ pyspark.ml
def test_registered_linear_model_equals_numpy(spark):
    """``batch_score`` and ``linear_forecast`` by lstsq on the registered
    features, windows and split."""
    f = sorted(catalog.features(spark, SF).collect(), key=lambda r: r.pos)
    cols, n = input_columns(), len(f) - catalog.T_LEN
    x = np.array([[r[c] for c in cols] for r in f])[catalog.T_LEN - 1:-1]
    y = np.array([r[TARGET] for r in f])[catalog.T_LEN:]
    train, val = int(n * 0.7), int(n * 0.15)
    a = np.concatenate([np.ones((n, 1)), x], axis=1)
    pred = a @ np.linalg.lstsq(a[:train], y[:train], rcond=None)[0]
    got = sorted(catalog.registered()["batch_score"](spark, SF).collect(), key=lambda r: r.ts)
    assert len(got) == n and [r.split for r in got].count("train") == train
    assert [r.y for r in got] == pytest.approx(y.tolist(), abs=1e-5)
    assert [r.pred_linear for r in got] == pytest.approx(pred.tolist(), rel=1e-4, abs=1e-3)
    e = pred[train + val:] - y[train + val:]
    m = catalog.registered()["linear_forecast"](spark, SF).first()
    assert m.n == len(e) and m.rmse == pytest.approx(float(np.sqrt((e ** 2).mean())), rel=1e-4) and m.mae == pytest.approx(float(np.abs(e).mean()), rel=1e-4)
