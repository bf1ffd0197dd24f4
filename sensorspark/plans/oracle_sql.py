"""DuckDB oracle SQL for every registered query that SQL can express.

Written from the operator definitions as plain window/aggregate SQL (the
spine and gap fill use whole-series windows and the textbook
last/first-non-NULL form), independent of the Spark code paths.  Output
columns follow the same normalisation as ``catalog.finalize``.
"""

from __future__ import annotations

PARAMS = ["pm25", "pm10", "no2", "o3"]
FEAT_PARAMS = sorted(PARAMS)          # no2, o3, pm10, pm25
TARGET_LAGS = [1, 2, 3, 6, 12, 24, 48, 72]
ROLL = [24, 48, 72]
CROSS = [(p, k) for p in ("pm10", "no2", "o3") for k in (24, 48, 72)]
CYC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def feature_cols():
    cols = list(FEAT_PARAMS) + [f"pm25_lag_{k}h" for k in TARGET_LAGS]
    for w in ROLL:
        cols += [f"pm25_rmean_{w}h", f"pm25_rstd_{w}h"]
    cols += [f"{p}_lag_{k}h" for p, k in CROSS]
    return cols + CYC


def input_cols():
    return [c for c in feature_cols() if c != "pm25"]


def fin(core: str, spec: str) -> str:
    """Final projection: ``name:kind`` with d=double, t=timestamp, dt=date,
    i=integer, s=string, b=boolean."""
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        q = f'"{name}"'
        if kind == "d":
            out.append(f"round(CAST({q} AS DOUBLE) + 1e-9, 6) + 0.0 AS {q}")
        elif kind == "t":
            out.append(f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}")
        elif kind == "dt":
            out.append(f"strftime({q}, '%Y-%m-%d') AS {q}")
        elif kind == "i":
            out.append(f"CAST({q} AS BIGINT) AS {q}")
        else:
            out.append(q)
    return f"{core}\nSELECT {', '.join(out)} FROM final_"


# ------------------------------------------------------------------ CTEs
MV = """mv AS (
  SELECT time_bucket(INTERVAL '10 minutes', ts) AS datetime,
         value,
         CASE event_type WHEN 'click' THEN 'pm25' WHEN 'error' THEN 'pm10' WHEN 'purchase' THEN 'no2'
                         WHEN 'view' THEN 'o3' WHEN 'signup' THEN 'other' END AS parameter,
         'loc_' || CAST(user_id % 10 AS VARCHAR) AS location,
         CAST(28.3 AS DOUBLE) + CAST(0.07 AS DOUBLE) * CAST(user_id % 10 AS DOUBLE) AS latitude,
         CAST(76.7 AS DOUBLE) + CAST(0.08 AS DOUBLE) * CAST(user_id % 10 AS DOUBLE) AS longitude,
         user_id AS sensor_id,
         event_id AS arrival
  FROM events)"""

PF = "pf AS (SELECT * FROM mv WHERE parameter IN ('pm25','pm10','no2','o3'))"

CLEAN = """clean AS (
  SELECT datetime, value, parameter, location, latitude, longitude, sensor_id, arrival FROM (
    SELECT *, row_number() OVER (PARTITION BY datetime, parameter, location ORDER BY arrival) AS rn FROM pf)
  WHERE rn = 1)"""

HW = """a1 AS (SELECT datetime, parameter, avg(value) AS v FROM clean WHERE value IS NOT NULL GROUP BY datetime, parameter),
hw AS (SELECT date_trunc('hour', datetime) AS hour,
  """ + ",\n  ".join(f"avg(v) FILTER (WHERE parameter = '{p}') AS {p}" for p in PARAMS) + """
  FROM a1 GROUP BY date_trunc('hour', datetime))"""


def _gap(p):
    return (f"CASE WHEN {p} IS NOT NULL THEN {p} "
            f"WHEN pi_{p} IS NOT NULL AND i - pi_{p} <= 9 AND ni_{p} IS NOT NULL "
            f"THEN pv_{p} + (nv_{p} - pv_{p}) * least(i - pi_{p}, 6) / (ni_{p} - pi_{p}) "
            f"WHEN pi_{p} IS NOT NULL AND i - pi_{p} <= 9 THEN pv_{p} "
            f"ELSE nv_{p} END AS {p}")


GRID = """sp AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hw),
g0 AS (SELECT sp.hour, row_number() OVER (ORDER BY sp.hour) - 1 AS i, """ + \
    ", ".join(f"hw.{p}" for p in PARAMS) + """ FROM sp LEFT JOIN hw ON sp.hour = hw.hour),
g1 AS (SELECT *, """ + ",\n  ".join(
    f"max(CASE WHEN {p} IS NOT NULL THEN i END) OVER wb AS pi_{p}, "
    f"min(CASE WHEN {p} IS NOT NULL THEN i END) OVER wf AS ni_{p}, "
    f"last_value({p} IGNORE NULLS) OVER wb AS pv_{p}, "
    f"first_value({p} IGNORE NULLS) OVER wf AS nv_{p}" for p in PARAMS) + """
  FROM g0 WINDOW wb AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 wf AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
grid AS (SELECT hour AS datetime, i, """ + ", ".join(_gap(p) for p in PARAMS) + """ FROM g1)"""


def _feat_exprs():
    e = [f"lag(pm25, {k}) OVER (ORDER BY i) AS pm25_lag_{k}h" for k in TARGET_LAGS]
    for w in ROLL:
        fr = f"(ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        e += [f"avg(pm25) OVER {fr} AS pm25_rmean_{w}h",
              f"coalesce(stddev_samp(pm25) OVER {fr}, 0) AS pm25_rstd_{w}h"]
    e += [f"lag({p}, {k}) OVER (ORDER BY i) AS {p}_lag_{k}h" for p, k in CROSS]
    e += ["sin(2 * pi() * hour(datetime) / 24) AS hour_sin", "cos(2 * pi() * hour(datetime) / 24) AS hour_cos",
          "sin(2 * pi() * (isodow(datetime) - 1) / 7) AS dow_sin",
          "cos(2 * pi() * (isodow(datetime) - 1) / 7) AS dow_cos",
          "sin(2 * pi() * month(datetime) / 12) AS month_sin", "cos(2 * pi() * month(datetime) / 12) AS month_cos"]
    return e


FT = ("f0 AS (SELECT datetime, i, " + ", ".join(FEAT_PARAMS) + ", " + ", ".join(_feat_exprs()) + " FROM grid),\n"
      "ft AS (SELECT * FROM f0 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in feature_cols()) + "),\n"
      "ftj AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS j, count(*) OVER () AS nf FROM ft)")

WIN = """win AS (SELECT datetime AS ts, i, j, pm25 AS y, pm25_lag_1h, pm25_lag_24h, j - 72 AS widx, nf - 72 AS n
  FROM ftj WHERE j >= 72),
ws AS (SELECT *, CASE WHEN widx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
                      WHEN widx < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val'
                      ELSE 'test' END AS split FROM win)"""

AR1 = """ar AS (SELECT count(*) AS n_train, regr_intercept(y, pm25_lag_1h) AS ar_a, regr_slope(y, pm25_lag_1h) AS ar_phi
  FROM ws WHERE split = 'train'),
mp AS (SELECT ws.*, pm25_lag_1h AS pred_persistence, pm25_lag_24h AS pred_seasonal,
         ar.ar_a + ar.ar_phi * pm25_lag_1h AS pred_ar1 FROM ws, ar)"""

SHARDS = """sh0 AS (SELECT *, CAST(date_trunc('week', datetime) AS DATE) AS wk,
                  datetime < date_trunc('week', datetime) + INTERVAL 1 DAY AS ov FROM pf),
sh1 AS (SELECT * EXCLUDE (wk, ov), wk AS ws_ FROM sh0
        UNION ALL SELECT * EXCLUDE (wk, ov), CAST(wk - INTERVAL 7 DAY AS DATE) AS ws_ FROM sh0 WHERE ov),
shards AS (SELECT * EXCLUDE (ws_), 'm_' || strftime(ws_, '%Y%m%d') || '_' || strftime(ws_ + INTERVAL 8 DAY, '%Y%m%d') AS shard
           FROM sh1)"""

STD_UNIT = "CASE parameter WHEN 'pm25' THEN 'µg/m³' WHEN 'pm10' THEN 'µg/m³' WHEN 'no2' THEN 'µg/m³' WHEN 'o3' THEN 'µg/m³' END"

MERGED = SHARDS + """,
ret AS (SELECT *, """ + STD_UNIT + """ AS unit FROM shards WHERE datetime >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY),
merged AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY datetime, parameter, location ORDER BY shard, arrival) AS rn FROM ret)
  WHERE rn = 1)"""

RUNS_BODY = """rp{x} AS (SELECT *, CAST(ts AS DATE) AS run_date FROM {src}),
rl{x} AS (SELECT run_date, y, 'baseline' AS model, {base} AS pred FROM rp{x}
       UNION ALL SELECT run_date, y, 'candidate' AS model, {cand} AS pred FROM rp{x}),
rm0{x} AS (SELECT run_date, model, avg(y) AS ybar FROM rl{x} GROUP BY run_date, model),
rm{x} AS (SELECT rl{x}.run_date, rl{x}.model, count(*) AS n,
         avg((pred - y) * (pred - y)) AS mse, avg(abs(pred - y)) AS mae,
         sum((pred - y) * (pred - y)) AS ssres, sum((y - ybar) * (y - ybar)) AS sstot, max(ybar) AS yb,
         avg(abs(pred - y) / greatest(abs(y), 1.0)) * 100 AS mape,
         avg(CASE WHEN abs(pred - y) / greatest(abs(y), 1.0) <= 0.25 THEN 1.0 ELSE 0.0 END) * 100 AS within_25pct,
         avg(CASE WHEN abs(pred - y) <= 50 THEN 1.0 ELSE 0.0 END) * 100 AS within_50,
         avg(pred - y) AS bias,
         sum((abs(pred - ybar) + abs(y - ybar)) * (abs(pred - ybar) + abs(y - ybar))) AS ioa_den
       FROM rl{x} JOIN rm0{x} USING (run_date, model) GROUP BY rl{x}.run_date, rl{x}.model),
rm2{x} AS (SELECT run_date, model, n, mse, sqrt(mse) AS rmse, mae,
          CASE WHEN sstot <= 1e-24 * n * yb * yb THEN CASE WHEN ssres <= 1e-24 * n * yb * yb THEN 1.0 ELSE 0.0 END ELSE 1.0 - ssres / sstot END AS r2,
          mape, within_25pct, within_50, bias, 1.0 - ssres / (ioa_den + 1e-8) AS index_of_agree FROM rm{x}),
pr{x} AS (SELECT run_date, sqrt(avg((y - {pers}) * (y - {pers}))) AS persistence_rmse FROM rp{x} GROUP BY run_date),
runs0{x} AS (SELECT b.run_date,
  'batch_' || strftime(b.run_date, '%Y%m%d') AS batch_id, 'run_' || strftime(b.run_date, '%Y%m%d') AS run_id,
  CAST(b.run_date AS TIMESTAMP) + INTERVAL 23 HOUR {shift} AS run_ts,
  b.n AS n, """ + ", ".join(f"{m}.{c} AS {m2}_{c}" for m, m2 in (("b", "baseline"), ("c", "candidate"))
                            for c in ["mse", "rmse", "mae", "r2", "mape", "within_25pct", "within_50", "bias",
                                      "index_of_agree"]) + """,
  (b.mse - c.mse) / (b.mse + 1e-8) * 100 AS mse_improvement_pct,
  (b.mae - c.mae) / (b.mae + 1e-8) * 100 AS mae_improvement_pct,
  (b.rmse - c.rmse) / (b.rmse + 1e-8) * 100 AS rmse_improvement_pct,
  pr{x}.persistence_rmse,
  (b.mse - c.mse) / (b.mse + 1e-8) * 100 >= 7.5 AS meets_claim
  FROM rm2{x} b JOIN rm2{x} c ON b.run_date = c.run_date AND b.model = 'baseline' AND c.model = 'candidate'
  JOIN pr{x} ON pr{x}.run_date = b.run_date),
{name} AS (SELECT *, candidate_rmse < coalesce(min(candidate_rmse) OVER (ORDER BY run_ts, run_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('inf' AS DOUBLE)) AS promoted FROM runs0{x})"""


def runs_cte(src="mp", base="pred_seasonal", cand="pred_persistence", name="runs", shift="", x=""):
    return RUNS_BODY.format(src=src, base=base, cand=cand, pers="pred_persistence", name=name, shift=shift, x=x)


def W(*ctes):
    return "WITH " + ",\n".join(ctes)


BASE = [MV, PF, CLEAN, HW]
CHAIN = BASE + [GRID, FT]
WCHAIN = CHAIN + [WIN, AR1]
RUNS = WCHAIN + [runs_cte()]
METRIC_COLS = ["mse", "rmse", "mae", "r2", "mape", "within_25pct", "within_50", "bias", "index_of_agree"]


def metrics_sql(src: str, group: str) -> list[str]:
    """Regression metrics of (y, pred) rows of ``src`` grouped by ``group``."""
    g = group
    return [
        f"mm0 AS (SELECT {g}, avg(y) AS ybar FROM {src} GROUP BY {g})",
        f"""mm1 AS (SELECT s.{g}, count(*) AS n, avg((pred - y) * (pred - y)) AS mse, avg(abs(pred - y)) AS mae,
            sum((pred - y) * (pred - y)) AS ssres, sum((y - ybar) * (y - ybar)) AS sstot, max(ybar) AS yb,
            avg(abs(pred - y) / greatest(abs(y), 1.0)) * 100 AS mape,
            avg(CASE WHEN abs(pred - y) / greatest(abs(y), 1.0) <= 0.25 THEN 1.0 ELSE 0.0 END) * 100 AS within_25pct,
            avg(CASE WHEN abs(pred - y) <= 50 THEN 1.0 ELSE 0.0 END) * 100 AS within_50,
            avg(pred - y) AS bias,
            sum((abs(pred - ybar) + abs(y - ybar)) * (abs(pred - ybar) + abs(y - ybar))) AS ioa_den
          FROM {src} s JOIN mm0 USING ({g}) GROUP BY s.{g})""",
        f"""mm AS (SELECT {g}, n, mse, sqrt(mse) AS rmse, mae,
            CASE WHEN sstot <= 1e-24 * n * yb * yb THEN CASE WHEN ssres <= 1e-24 * n * yb * yb THEN 1.0 ELSE 0.0 END ELSE 1.0 - ssres / sstot END AS r2,
            mape, within_25pct, within_50, bias, 1.0 - ssres / (ioa_den + 1e-8) AS index_of_agree FROM mm1)"""]


def compare_sql(src: str, base: str, cand: str) -> list[str]:
    """Baseline vs candidate comparison on rows of ``src``: one row."""
    return [f"""cl AS (SELECT 'baseline' AS model, y, {base} AS pred FROM {src}
                     UNION ALL SELECT 'candidate' AS model, y, {cand} AS pred FROM {src})"""] + \
        metrics_sql("cl", "model") + [
        """cmp AS (SELECT b.n AS n, """ + ", ".join(
            f"{m}.{c} AS {m2}_{c}" for m, m2 in (("b", "baseline"), ("c", "candidate")) for c in METRIC_COLS) + """,
          (b.mse - c.mse) / (b.mse + 1e-8) * 100 AS mse_improvement_pct,
          (b.mae - c.mae) / (b.mae + 1e-8) * 100 AS mae_improvement_pct,
          (b.rmse - c.rmse) / (b.rmse + 1e-8) * 100 AS rmse_improvement_pct,
          (b.mse - c.mse) / (b.mse + 1e-8) * 100 >= 7.5 AS meets_claim
          FROM mm b, mm c WHERE b.model = 'baseline' AND c.model = 'candidate')"""]


PERS = """pers AS (SELECT count(*) AS pairs, sqrt(avg((y - pm25_lag_1h) * (y - pm25_lag_1h))) AS persistence_rmse
  FROM ws WHERE split = 'test' AND widx > (SELECT min(widx) FROM ws WHERE split = 'test'))"""

CMP_SPEC = "n:i " + " ".join(f"{m}_{c}:d" for m in ("baseline", "candidate") for c in METRIC_COLS) + \
    " mse_improvement_pct:d mae_improvement_pct:d rmse_improvement_pct:d meets_claim:b"

RUN_COLS = ("batch_id:s run_id:s run_ts:t data_path:s rolling_days:i n:i " +
            " ".join(f"{m}_{c}:d" for m in ("baseline", "candidate") for c in METRIC_COLS) +
            " mse_improvement_pct:d mae_improvement_pct:d rmse_improvement_pct:d persistence_rmse:d"
            " meets_claim:b promoted:b")


def psi_sql(ref: str, cur: str, cols, exact_names=True) -> list[str]:
    """PSI per feature between two relations holding numeric ``cols``."""
    def long(rel, name):
        return f"{name} AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {rel} WHERE {c} IS NOT NULL AND NOT isnan({c})"
            for c in cols) + ")"
    return [long(ref, "rlong"), long(cur, "clong"),
            """edges AS (SELECT feature, quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e,
                  count(*) AS ref_n FROM rlong GROUP BY feature),
cnt_c AS (SELECT feature, count(*) AS cur_n FROM clong GROUP BY feature),
edges2 AS (SELECT edges.* FROM edges JOIN cnt_c USING (feature)),
rb AS (SELECT r.feature, len(list_filter(e, lambda v: r.x >= v)) AS bin FROM rlong r JOIN edges2 USING (feature)),
cb AS (SELECT c.feature, len(list_filter(e, lambda v: c.x >= v)) AS bin FROM clong c JOIN edges2 USING (feature)),
bins AS (SELECT feature, unnest(range(0, 10)) AS bin FROM edges2),
rh AS (SELECT feature, bin, count(*) AS c FROM rb GROUP BY feature, bin),
ch AS (SELECT feature, bin, count(*) AS c FROM cb GROUP BY feature, bin),
rt AS (SELECT feature, count(*) AS t FROM rb GROUP BY feature),
ct AS (SELECT feature, count(*) AS t FROM cb GROUP BY feature),
hist AS (SELECT bins.feature, bins.bin,
           coalesce(rh.c, 0) AS ref_count, greatest(coalesce(rh.c, 0) / rt.t, 1e-10) AS ref,
           coalesce(ch.c, 0) AS cur_count, greatest(coalesce(ch.c, 0) / ct.t, 1e-10) AS cur
         FROM bins LEFT JOIN rh USING (feature, bin) LEFT JOIN ch USING (feature, bin)
         JOIN rt USING (feature) JOIN ct USING (feature)),
psi AS (SELECT feature, sum((cur - ref) * ln(cur / ref)) AS psi FROM hist GROUP BY feature)"""]


FEAT_PERIODS = """fp AS (SELECT ft.*, (SELECT count(*) FROM ft) AS n_, (SELECT min(i) FROM ft) AS a_ FROM ft),
pref AS (SELECT * FROM fp WHERE i - a_ < floor(n_ / 3)),
pcur AS (SELECT * FROM fp WHERE i - a_ >= n_ - floor(n_ / 3))"""

LI_PERIODS = """lref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'),
lcur AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')"""

PSI_SUMMARY = """psum AS (SELECT coalesce(avg(psi), 0.0) AS psi_score, count(*) AS features_analyzed, count(*) >= 4 AS judged FROM psi),
psum2 AS (SELECT *, CASE WHEN psi_score < 0.1 THEN 'none' WHEN psi_score <= 0.25 THEN 'moderate' ELSE 'significant' END AS band,
            CASE WHEN psi_score > 0.15 THEN 'retrain' ELSE 'skip' END AS recommendation FROM psum)"""

PRED_LOG = """plog AS (SELECT ts AS timestamp, pred_persistence AS predicted, 'persistence' AS model_version FROM mp
  UNION ALL SELECT ts, pred_ar1, 'ar1' FROM mp)"""


def _haversine(lat, lon):
    return (f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(latitude - {lat}) / 2), 2) + "
            f"cos(radians(latitude)) * cos(radians({lat})) * pow(sin(radians(longitude - {lon}) / 2), 2))))")


def _feat_subset(cols):
    return fin(W(*CHAIN, "final_ AS (SELECT datetime, " + ", ".join(cols) + " FROM ft)"),
               "datetime:t " + " ".join(f"{c}:d" for c in cols))


def ar2_sql(cols="", group=""):
    """Two-lag least squares from the covariances."""
    return f"""cv AS (SELECT {cols}count(*) AS n_train, avg(y) AS my, avg(pm25_lag_1h) AS m1, avg(pm25_lag_24h) AS m2, var_pop(pm25_lag_1h) AS v1,
    var_pop(pm25_lag_24h) AS v2, covar_pop(pm25_lag_1h, pm25_lag_24h) AS c12, covar_pop(pm25_lag_1h, y) AS c1, covar_pop(pm25_lag_24h, y) AS c2
  FROM ws WHERE split = 'train' {group}),
cb AS (SELECT *, CASE WHEN v1 * v2 - c12 * c12 > 0 THEN (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) END AS lag_1,
    CASE WHEN v1 * v2 - c12 * c12 > 0 THEN (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) END AS lag_24 FROM cv),
ar2 AS (SELECT {cols}n_train, my - lag_1 * m1 - lag_24 * m2 AS intercept, lag_1, lag_24 FROM cb)"""


def rec2_sql(panel=False):
    """The two-lag recursion, step by step over the last 24 hours."""
    key, on, by = ("location, ", " JOIN ar2 USING (location)", " GROUP BY location") if panel else ("", ", ar2", "")
    rank = "(PARTITION BY location ORDER BY i DESC)" if panel else "(ORDER BY i DESC)"
    return f"""tl AS (SELECT * FROM (SELECT {key}datetime, i, pm25, row_number() OVER {rank} AS rn FROM ft) WHERE rn <= 24),
h0 AS (SELECT {key}max(datetime) AS last_ts, list(pm25 ORDER BY i) AS hist FROM tl{by}),
rec AS (SELECT {key}last_ts, 0 AS h, hist FROM h0 WHERE len(hist) = 24
  UNION ALL SELECT {key}last_ts, h + 1, list_append(hist[2:], intercept + lag_1 * hist[24] + lag_24 * hist[1]) FROM rec{on} WHERE h < 24)"""


def ols_sql(src: str, cols, out: str, by: str = "location") -> list[str]:
    """Least squares of y on ``cols`` in every ``by`` by Gauss-Jordan elimination
    of the correlations; a ridge where a pivot vanishes."""
    k = len(cols)
    cov = "[" + ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in cols) + "]" for a in cols) + "]"

    def eliminate(name, start):
        return f"""{name} AS (SELECT {by}, 0 AS step, aug, CAST(1e308 AS DOUBLE) AS low FROM {start}
  UNION ALL SELECT {by}, step + 1, list_transform(aug, lambda row, i: CASE WHEN i = step + 1 THEN list_transform(row, lambda v: v / aug[step + 1][step + 1])
      ELSE list_transform(row, lambda v, j: v - row[step + 1] * aug[step + 1][j] / aug[step + 1][step + 1]) END), least(low, aug[step + 1][step + 1])
  FROM {name} WHERE step < {k})"""
    return [
        f"""{out}a AS MATERIALIZED (SELECT {by}, count(*) AS n_train, avg(y) AS my, [{", ".join(f"avg({c})" for c in cols)}] AS mean, [{", ".join(f"var_pop({c})" for c in cols)}] AS var,
  [{", ".join(f"covar_pop({c}, y)" for c in cols)}] AS cy, {cov} AS cov FROM {src} WHERE split = 'train' GROUP BY {by})""",
        f"{out}s AS (SELECT *, list_transform(var, lambda v, i: CASE WHEN v > 1e-20 * mean[i] * mean[i] THEN sqrt(v) END) AS sd FROM {out}a)",
        f"""{out}r AS (SELECT {by}, list_transform(cov, lambda row, i: list_append(list_transform(row, lambda v, j: CASE WHEN i = j THEN 1.0 ELSE coalesce(v / (sd[i] * sd[j]), 0) END),
  coalesce(cy[i] / sd[i], 0))) AS aug FROM {out}s)""",
        eliminate(f"{out}e", f"{out}r"),
        f"""{out}q AS (SELECT {by}, list_transform(aug, lambda row, i: list_transform(row, lambda v, j: v + CASE WHEN i = j AND low <= 1e-9 THEN 1e-6 ELSE 0 END)) AS aug
  FROM {out}r JOIN (SELECT {by}, low FROM {out}e WHERE step = {k}) USING ({by}))""",
        eliminate(f"{out}f", f"{out}q"),
        f"""{out}b AS (SELECT {by}, n_train, my, mean, list_transform(aug, lambda row, i: coalesce(row[{k + 1}] / sd[i], 0)) AS coef FROM {out}f JOIN {out}s USING ({by}) WHERE step = {k})""",
        f"{out} AS (SELECT {by}, n_train, my - list_sum(list_transform(coef, lambda v, i: v * mean[i])) AS intercept, coef FROM {out}b)"]


def _x(cols):
    return [f"x_{c}" for c in cols]


def feature_recursion_sql() -> list[str]:
    """The linear model ``lm`` over the feature vector, iterated for 24 hours."""
    p = {"no2": "hn", "o3": "ho", "pm10": "hm", "pm25": "hy"}
    x = [f"{p[c]}[73]" for c in FEAT_PARAMS] + [f"hy[{73 - k}]" for k in TARGET_LAGS]
    for w in ROLL:
        x += [f"list_avg(hy[{74 - w}:73])", f"list_aggregate(hy[{74 - w}:73], 'stddev_samp')"]
    x += [f"{p[c]}[{73 - k}]" for c, k in CROSS]
    t = "(last_ts + h * INTERVAL 1 HOUR)"
    x += [f"{f}(2 * pi() * {v} / {n})" for v, n in ((f"hour({t})", 24), (f"(isodow({t}) - 1)", 7), (f"month({t})", 12)) for f in ("sin", "cos")]
    return [
        """tl AS (SELECT * FROM (SELECT location, datetime, i, no2, o3, pm10, pm25, row_number() OVER (PARTITION BY location ORDER BY i DESC) AS rn FROM ft) WHERE rn <= 73)""",
        "h0 AS (SELECT location, max(datetime) AS last_ts, " + ", ".join(f"list({c} ORDER BY i) AS {h}" for c, h in p.items()) + " FROM tl GROUP BY location HAVING max(i) - min(i) = 72)",
        f"""rec AS (SELECT location, last_ts, 0 AS h, hn, ho, hm, hy FROM h0
  UNION ALL SELECT location, last_ts, h + 1, list_append(hn[2:], hn[73]), list_append(ho[2:], ho[73]), list_append(hm[2:], hm[73]),
    list_append(hy[2:], intercept + list_sum(list_transform([{", ".join(x)}], lambda v, i: v * coef[i])))
  FROM rec JOIN lm USING (location) WHERE h < 24)"""]


def boosting_sql(cols, rounds=10, rate=0.3, bins=16, min_rows=5) -> list[str]:
    """Trees of two levels on the rows of ``wx``; predictions in ``bt``."""
    q = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    out = [
        f"br AS MATERIALIZED (SELECT row_number() OVER () AS r, location, ts, y, split = 'train' AS fit, [{', '.join(cols)}] AS x FROM wx)",
        "be AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i + 1} AS c, list_sort(list_distinct(quantile_cont({c}, {q}))) AS e FROM wx WHERE split = 'train'" for i, c in enumerate(cols)) + ")",
        "bb AS MATERIALIZED (SELECT r, fit, c, len(list_filter(e, lambda v: x[c] >= v)) AS b FROM br, be)",
        "bk AS MATERIALIZED (SELECT c, unnest(range(1, len(e) + 1)) AS k FROM be)",
        "p0 AS MATERIALIZED (SELECT r, fit, y - (SELECT avg(y) FROM br WHERE fit) AS res FROM br)"]

    def best(name, hist, part):
        return [f"""{name}c AS (SELECT {part}c, k, coalesce(sum(n) FILTER (b < k), 0) AS nl, coalesce(sum(s) FILTER (b < k), 0) AS sl, sum(n) AS n, sum(s) AS s
  FROM {hist} JOIN bk USING (c) GROUP BY ALL)""",
                f"""{name}g AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM {name}c WHERE nl >= {min_rows} AND n - nl >= {min_rows})""",
                f"""{name} AS MATERIALIZED (SELECT {part}c, k FROM (SELECT *, row_number() OVER ({"PARTITION BY " + part[:-2] if part else ""} ORDER BY c, k) AS rn
  FROM (SELECT *, max(gain) OVER ({"PARTITION BY " + part[:-2] if part else ""}) AS top FROM {name}g) WHERE gain > 1e-9 AND gain >= top * (1 - 1e-9)) WHERE rn = 1)"""]
    for t in range(rounds):
        out += [f"ha{t} AS (SELECT c, b, count(*) AS n, sum(res) AS s FROM bb JOIN p{t} USING (r) WHERE bb.fit GROUP BY c, b)",
                *best(f"sa{t}", f"ha{t}", ""),
                f"na{t} AS MATERIALIZED (SELECT p.r, p.fit, res, CAST(b >= k AS INTEGER) AS side FROM p{t} p, sa{t} s, bb WHERE bb.r = p.r AND bb.c = s.c)",
                f"hb{t} AS (SELECT side, c, b, count(*) AS n, sum(res) AS s FROM bb JOIN na{t} USING (r) WHERE bb.fit GROUP BY side, c, b)",
                *best(f"sb{t}", f"hb{t}", "side, "),
                f"""nb{t} AS MATERIALIZED (SELECT n.r, n.fit, res, side * 2 + coalesce(CAST(b >= k AS INTEGER), 0) AS leaf
  FROM na{t} n LEFT JOIN sb{t} s USING (side) LEFT JOIN bb ON bb.r = n.r AND bb.c = s.c)""",
                f"lv{t} AS (SELECT leaf, {rate} * sum(res) / count(*) AS v FROM nb{t} WHERE fit GROUP BY leaf)",
                f"p{t + 1} AS MATERIALIZED (SELECT r, fit, res - v AS res FROM nb{t} JOIN lv{t} USING (leaf))"]
    return out + [f"bt AS (SELECT location, ts, y, y - res AS pred_tree FROM br JOIN p{rounds} USING (r))"]


def _panel(sql: str) -> str:
    """A chain CTE with every window and every output per location."""
    return sql.replace("OVER (ORDER BY", "OVER (PARTITION BY location ORDER BY").replace("AS (ORDER BY", "AS (PARTITION BY location ORDER BY")


PANEL = [
    """a1 AS (SELECT location, datetime, parameter, avg(value) AS v FROM clean WHERE value IS NOT NULL GROUP BY ALL),
hw AS (SELECT location, date_trunc('hour', datetime) AS hour, """ + ", ".join(f"avg(v) FILTER (WHERE parameter = '{p}') AS {p}" for p in PARAMS) + """
  FROM a1 GROUP BY ALL)""",
    "sp AS (SELECT location, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour FROM (SELECT location, min(hour) AS a, max(hour) AS b FROM hw GROUP BY location)),\n"
    "g0 AS (SELECT location, hour, row_number() OVER (PARTITION BY location ORDER BY hour) - 1 AS i, " + ", ".join(PARAMS) + " FROM sp LEFT JOIN hw USING (location, hour)),\n"
    + _panel(GRID[GRID.index("g1 AS"):]).replace("SELECT hour AS datetime, i,", "SELECT location, hour AS datetime, i,"),
    "f0 AS (SELECT location, datetime, i, " + ", ".join(FEAT_PARAMS) + ", " + ", ".join(_panel(e) for e in _feat_exprs()) + ", "
    + ", ".join(f"bool_or({p} IS NOT NULL) OVER (PARTITION BY location) AS has_{p}" for p in PARAMS) + " FROM grid),\n"
    "ft AS (SELECT * FROM f0 WHERE " + " AND ".join(
        f"({c} IS NOT NULL" + next((f" OR NOT has_{p}" for p in ("pm10", "no2", "o3") if c == p or c.startswith(p + "_")), "") + ")" for c in feature_cols()) + "),\n"
    "ftj AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY location) AS nf FROM ft)",
    WIN.replace("SELECT datetime AS ts,", "SELECT location, datetime AS ts,"),
    """ar AS (SELECT location, count(*) AS n_train, regr_intercept(y, pm25_lag_1h) AS ar_a, regr_slope(y, pm25_lag_1h) AS ar_phi
  FROM ws WHERE split = 'train' GROUP BY location),
mp AS (SELECT ws.*, pm25_lag_1h AS pred_persistence, pm25_lag_24h AS pred_seasonal, ar.ar_a + ar.ar_phi * pm25_lag_1h AS pred_ar1 FROM ws LEFT JOIN ar USING (location))""",
]


def panel_runs() -> list[str]:
    """The daily backtest per location: the day and the location as one key."""
    day = ["""rd AS (SELECT *, location || '|' || strftime(CAST(ts AS DATE), '%Y%m%d') AS k FROM mp)"""]
    both = ["""cl AS (SELECT k || '|b' AS lm, y, pred_seasonal AS pred FROM rd UNION ALL SELECT k || '|c', y, pred_persistence FROM rd)""", *metrics_sql("cl", "lm")]
    return day + both + [
        """pk AS (SELECT k, any_value(location) AS location, any_value(CAST(ts AS DATE)) AS run_date,
             sqrt(avg((y - pred_persistence) * (y - pred_persistence))) AS persistence_rmse FROM rd GROUP BY k)""",
        """runs0 AS (SELECT pk.location, pk.run_date, 'batch_' || strftime(pk.run_date, '%Y%m%d') AS batch_id, 'run_' || strftime(pk.run_date, '%Y%m%d') AS run_id,
          CAST(pk.run_date AS TIMESTAMP) + INTERVAL 23 HOUR AS run_ts, b.n AS n, """ + ", ".join(
            f"{m}.{c} AS {m2}_{c}" for m, m2 in (("b", "baseline"), ("c", "candidate")) for c in METRIC_COLS) + """,
          (b.mse - c.mse) / (b.mse + 1e-8) * 100 AS mse_improvement_pct, (b.mae - c.mae) / (b.mae + 1e-8) * 100 AS mae_improvement_pct,
          (b.rmse - c.rmse) / (b.rmse + 1e-8) * 100 AS rmse_improvement_pct, pk.persistence_rmse, (b.mse - c.mse) / (b.mse + 1e-8) * 100 >= 7.5 AS meets_claim
          FROM pk JOIN mm b ON b.lm = pk.k || '|b' JOIN mm c ON c.lm = pk.k || '|c')""",
        """runs AS (SELECT *, candidate_rmse < coalesce(min(candidate_rmse) OVER (PARTITION BY location ORDER BY run_ts, run_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('inf' AS DOUBLE)) AS promoted FROM runs0)"""]


def build() -> dict:
    q = {}
    q["scan_measurements"] = fin(W(MV, "final_ AS (SELECT * FROM mv)"),
                                 "datetime:t value:d parameter:s location:s latitude:d longitude:d sensor_id:i arrival:i")
    q["standardize"] = fin(W(MV, f"final_ AS (SELECT *, {STD_UNIT} AS unit FROM mv)"),
                           "datetime:t value:d parameter:s unit:s location:s latitude:d longitude:d arrival:i")
    q["retention_filter"] = fin(W(MV, "final_ AS (SELECT * FROM mv WHERE datetime >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)"),
                                "datetime:t parameter:s location:s value:d arrival:i")
    q["param_filter"] = fin(W(MV, PF, "final_ AS (SELECT * FROM pf)"), "arrival:i parameter:s")
    q["bbox_filter"] = fin(W(MV, """bb AS (SELECT * FROM mv WHERE longitude BETWEEN 76.8 AND 77.4 AND latitude BETWEEN 28.4 AND 28.9)""",
                             "final_ AS (SELECT * FROM bb)"),
                           "arrival:i location:s")
    q["radius_filter"] = fin(W(MV, f"final_ AS (SELECT * FROM mv WHERE {_haversine(28.6139, 77.2090)} <= 25000)"),
                             "arrival:i location:s")
    q["country_filter"] = fin(W("""codes AS (SELECT * FROM (VALUES ('IN',13),('US',5),('FR',67),('DE',73),('GB',2),('CN',20),
        ('PK',163),('BD',16),('NP',155),('TN',212),('NG',157),('MX',142)) t(iso, country_id))""",
                                "final_ AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN "
                                "(SELECT country_id FROM codes WHERE iso IN ('IN','US','GB','CN','FR')))"),
                              "n_nationkey:i n_name:s")
    q["sensor_range_topn"] = fin(W(MV, """final_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id
        ORDER BY datetime, arrival) AS rn FROM mv WHERE datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')
        WHERE rn <= 5)"""), "sensor_id:i datetime:t arrival:i value:d")
    q["pivot_mean"] = fin(W(*BASE, "final_ AS (SELECT datetime, " + ", ".join(
        f"avg(v) FILTER (WHERE parameter = '{p}') AS {p}" for p in PARAMS) + " FROM a1 GROUP BY datetime)"),
        "datetime:t " + " ".join(f"{p}:d" for p in PARAMS))
    q["hourly_mean"] = fin(W(*BASE, "final_ AS (SELECT * FROM hw)"), "hour:t " + " ".join(f"{p}:d" for p in PARAMS))
    q["hour_spine"] = fin(W(*BASE, GRID, "final_ AS (SELECT hour AS datetime, " + ", ".join(PARAMS) + " FROM g0)"),
                          "datetime:t " + " ".join(f"{p}:d" for p in PARAMS))
    q["gap_fill"] = fin(W(*BASE, GRID, "final_ AS (SELECT * FROM grid)"), "datetime:t " + " ".join(f"{p}:d" for p in PARAMS))
    q["feature_table"] = fin(W(*CHAIN, "final_ AS (SELECT * FROM ft)"),
                             "datetime:t " + " ".join(f"{c}:d" for c in feature_cols()))
    q["target_lags"] = _feat_subset([f"pm25_lag_{k}h" for k in TARGET_LAGS])
    q["cross_lags"] = _feat_subset([f"{p}_lag_{k}h" for p, k in CROSS])
    q["rolling_mean"] = _feat_subset([f"pm25_rmean_{w}h" for w in ROLL])
    q["rolling_std"] = _feat_subset([f"pm25_rstd_{w}h" for w in ROLL])
    q["cyclic_features"] = _feat_subset(CYC)
    q["dropna_features"] = fin(W(*CHAIN, """final_ AS (SELECT (SELECT count(*) FROM grid) AS spine_rows,
        (SELECT count(*) FROM ft) AS feature_rows, (SELECT count(*) FROM grid) - (SELECT count(*) FROM ft) AS dropped_rows)"""),
        "spine_rows:i feature_rows:i dropped_rows:i")
    q["sequence_windows"] = fin(W(*CHAIN, f"""sw AS (SELECT datetime AS ts, j, pm25 AS y,
        count(*) OVER (ORDER BY j ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS n_steps,
        sum(pm10) OVER (ORDER BY j ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS x_pm10_sum,
        lag(pm25_lag_1h, 1) OVER (ORDER BY j) AS x_last_lag1,
        lag(hour_sin, 72) OVER (ORDER BY j) AS x_first_hour_sin,
        (sum(j * ({" + ".join(input_cols())})) OVER (ORDER BY j ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)
         - (j - 73) * sum({" + ".join(input_cols())}) OVER (ORDER BY j ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)) / (72 * 72 * {len(input_cols())}.0) AS x_digest FROM ftj)""",
                                  "final_ AS (SELECT * FROM sw WHERE j >= 72)"),
                                "ts:t y:d n_steps:i x_pm10_sum:d x_last_lag1:d x_first_hour_sin:d x_digest:d")
    q["chrono_split"] = fin(W(*WCHAIN, "final_ AS (SELECT * FROM ws)"), "ts:t widx:i split:s")
    q["split_summary"] = fin(W(*WCHAIN, "final_ AS (SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ws GROUP BY split)"),
                             "split:s n:i first_ts:t last_ts:t")
    q["window_summary"] = fin(W(*WCHAIN, "final_ AS (SELECT count(*) AS n, avg(y) AS y_mean, stddev_pop(y) AS y_std, min(y) AS y_min, max(y) AS y_max FROM ws)"),
                              "n:i y_mean:d y_std:d y_min:d y_max:d")
    q["latest_windows"] = fin(W(*WCHAIN, "final_ AS (SELECT ts, y FROM ws ORDER BY ts DESC LIMIT 100)"), "ts:t y:d")
    # feature scaler: every train window stacked, row by row
    scal = ["""tw AS (SELECT j FROM ws JOIN ftj USING (j) WHERE split = 'train')""",
            """cw AS (SELECT f.j, count(*) AS w FROM ftj f JOIN tw ON f.j BETWEEN tw.j - 72 AND tw.j - 1 GROUP BY f.j)""",
            "sl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, w, CAST({c} AS DOUBLE) AS x FROM ftj JOIN cw USING (j)"
                                           for c in input_cols()) + ")",
            "sm AS (SELECT feature, sum(w * x) / sum(w) AS mean, CAST(sum(w) AS DOUBLE) AS n FROM sl GROUP BY feature)",
            """sv AS (SELECT sl.feature, any_value(sm.mean) AS mean, any_value(sm.n) AS n, sum(w * (x - sm.mean) * (x - sm.mean)) / any_value(sm.n) AS var
                     FROM sl JOIN sm USING (feature) GROUP BY sl.feature)""",
            "scaler AS (SELECT feature, mean, CASE WHEN var <= n * pow(2, -52) * var + pow(n * pow(2, -52) * mean, 2) THEN 1.0 ELSE sqrt(var) END AS scale FROM sv)"]
    q["fit_feature_scaler"] = fin(W(*CHAIN, WIN, *scal, "final_ AS (SELECT * FROM scaler)"), "feature:s mean:d scale:d")
    tscal = """tsc AS (SELECT avg(y) AS y_mean, CASE WHEN var_pop(y) <= count(y) * pow(2, -52) * var_pop(y) + pow(count(y) * pow(2, -52) * avg(y), 2)
                 THEN 1.0 ELSE stddev_pop(y) END AS y_scale
                 FROM ws WHERE split = 'train')"""
    q["fit_target_scaler"] = fin(W(*WCHAIN, tscal, "final_ AS (SELECT * FROM tsc)"), "y_mean:d y_scale:d")
    sel = ", ".join(f"({c} - (SELECT mean FROM scaler WHERE feature = '{c}')) / (SELECT scale FROM scaler WHERE feature = '{c}') AS {c}"
                    for c in input_cols())
    q["scale_features"] = fin(W(*CHAIN, WIN, *scal, f"final_ AS (SELECT datetime, {sel} FROM ft)"),
                              "datetime:t " + " ".join(f"{c}:d" for c in input_cols()))
    q["inverse_transform"] = fin(W(*WCHAIN, tscal, """final_ AS (SELECT ts, (y - y_mean) / y_scale AS y_scaled,
        (pm25_lag_1h - y_mean) / y_scale AS pred_scaled,
        ((pm25_lag_1h - y_mean) / y_scale) * y_scale + y_mean AS pred_raw FROM ws, tsc)"""),
        "ts:t y_scaled:d pred_scaled:d pred_raw:d")
    q["naive_forecast"] = fin(W(*WCHAIN, "final_ AS (SELECT ts, y, pm25_lag_1h AS pred_persistence, pm25_lag_24h AS pred_seasonal FROM ws)"),
                              "ts:t y:d pred_persistence:d pred_seasonal:d")
    q["persistence_rmse"] = fin(W(*WCHAIN, PERS, "final_ AS (SELECT * FROM pers)"), "pairs:i persistence_rmse:d")
    q["regression_metrics"] = fin(W(*WCHAIN, """rl AS (SELECT 'persistence' AS model, y, pred_persistence AS pred FROM mp WHERE split = 'test'
        UNION ALL SELECT 'seasonal', y, pred_seasonal FROM mp WHERE split = 'test'
        UNION ALL SELECT 'ar1', y, pred_ar1 FROM mp WHERE split = 'test')""", *metrics_sql("rl", "model"),
                                    "final_ AS (SELECT * FROM mm)"),
                                  "model:s n:i " + " ".join(f"{c}:d" for c in METRIC_COLS))
    q["compare_models"] = fin(W(*WCHAIN, "tst AS (SELECT * FROM mp WHERE split = 'test')",
                                *compare_sql("tst", "pred_seasonal", "pred_persistence"), "final_ AS (SELECT * FROM cmp)"),
                              CMP_SPEC)
    q["forecast_eval"] = fin(W(*WCHAIN, PERS, "tst AS (SELECT * FROM mp WHERE split = 'test')",
                               *compare_sql("tst", "pred_seasonal", "pred_ar1"),
                               "final_ AS (SELECT cmp.*, pers.*, cmp.candidate_rmse > pers.persistence_rmse * 3.0 AS quality_alarm FROM cmp, pers)"),
                             CMP_SPEC + " pairs:i persistence_rmse:d quality_alarm:b")
    q["quality_alarm"] = fin(W(*WCHAIN, PERS, "tst AS (SELECT *, CAST(0 AS DOUBLE) AS pred_zero FROM mp WHERE split = 'test')",
                               *compare_sql("tst", "pred_zero", "pred_ar1"),
                               """final_ AS (SELECT candidate_rmse, baseline_rmse, persistence_rmse,
        candidate_rmse > persistence_rmse * 3.0 AS candidate_alarm, baseline_rmse > persistence_rmse * 3.0 AS baseline_alarm
        FROM cmp, pers)"""),
                             "candidate_rmse:d baseline_rmse:d persistence_rmse:d candidate_alarm:b baseline_alarm:b")
    q["align_predictions"] = fin(W(*WCHAIN, """cand AS (SELECT ts, pred_ar1 FROM mp WHERE split <> 'train')""",
                                   "tst AS (SELECT mp.ts, y, pred_seasonal, cand.pred_ar1 FROM mp JOIN cand ON mp.ts = cand.ts)",
                                   *compare_sql("tst", "pred_seasonal", "pred_ar1"), "final_ AS (SELECT * FROM cmp)"), CMP_SPEC)
    q["ar1_fit"] = fin(W(*WCHAIN, "final_ AS (SELECT * FROM ar)"), "n_train:i ar_a:d ar_phi:d")
    q["ar1_predict"] = fin(W(*WCHAIN, "final_ AS (SELECT ts, y, pred_ar1 FROM mp WHERE split = 'test')"), "ts:t y:d pred_ar1:d")
    q["recursive_forecast"] = fin("WITH RECURSIVE " + ",\n".join([*WCHAIN, """lastobs AS (SELECT max(datetime) AS last_ts, arg_max(pm25, datetime) AS last_y FROM ft)""",
        """rec(h, y) AS (SELECT 0, last_y FROM lastobs UNION ALL SELECT h + 1, ar_a + ar_phi * y FROM rec, ar WHERE h < 24)""",
        """final_ AS (SELECT last_ts + h * INTERVAL 1 HOUR AS ts, h, y AS forecast, 'recursive' AS forecast_type FROM rec, lastobs WHERE h > 0)"""]),
                                  "ts:t h:i forecast:d forecast_type:s")
    q["ar_fit"] = fin(W(*WCHAIN, ar2_sql(), "final_ AS (SELECT * FROM ar2)"), "n_train:i intercept:d lag_1:d lag_24:d")
    q["recursive_forecast_general"] = fin("WITH RECURSIVE " + ",\n".join([*WCHAIN, ar2_sql(), rec2_sql(),
        """final_ AS (SELECT last_ts + h * INTERVAL 1 HOUR AS ts, h, hist[24] AS forecast, 'recursive' AS forecast_type FROM rec WHERE h > 0)"""]),
                                          "ts:t h:i forecast:d forecast_type:s")
    q["forecast_grid"] = fin(W(*CHAIN, """final_ AS (SELECT h, (SELECT max(datetime) FROM ft) + h * INTERVAL 1 HOUR AS ts
        FROM (SELECT unnest(range(1, 25)) AS h))"""), "h:i ts:t")
    q["dedup_first"] = fin(W(MV, PF, SHARDS, """final_ AS (SELECT * FROM (SELECT *, row_number() OVER
        (PARTITION BY datetime, parameter, location ORDER BY shard, arrival) AS rn FROM shards) WHERE rn = 1)"""),
                           "datetime:t parameter:s location:s value:d shard:s arrival:i")
    q["duplicate_count"] = fin(W(MV, PF, """final_ AS (SELECT count(*) AS rows_before,
        (SELECT count(*) FROM (SELECT DISTINCT datetime, parameter, location FROM pf)) AS rows_after,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT datetime, parameter, location FROM pf)) AS duplicates_removed FROM pf)"""),
                               "rows_before:i rows_after:i duplicates_removed:i")
    q["merge_shards"] = fin(W(MV, PF, SHARDS, "final_ AS (SELECT shard, count(*) AS rows, count(DISTINCT arrival) AS readings FROM shards GROUP BY shard)"),
                            "shard:s rows:i readings:i")
    q["shard_roundtrip"] = fin(W(MV, PF, MERGED, "final_ AS (SELECT * FROM merged)"),
                               "datetime:t parameter:s location:s value:d unit:s shard:s arrival:i")
    q["ingest_runs"] = fin(W(MV, PF, """n1 AS (SELECT TIMESTAMP '2024-01-08 12:00:00' AS e, TIMESTAMP '2024-01-08 12:00:00' - INTERVAL 14 DAY AS s),
n2 AS (SELECT TIMESTAMP '2024-01-20 06:00:00' AS e, (SELECT max(datetime) FROM pf, n1 WHERE datetime BETWEEN s AND e) AS s),
n3 AS (SELECT TIMESTAMP '2024-01-20 09:00:00' AS e, (SELECT max(datetime) FROM pf, n2 WHERE datetime BETWEEN s AND e) AS s),
n4 AS (SELECT TIMESTAMP '2024-01-31' AS e, (SELECT max(datetime) FROM pf, n3 WHERE datetime BETWEEN s AND e) AS s),
spans AS (SELECT 0 AS no, * FROM n1 UNION ALL SELECT 1, * FROM n2 UNION ALL SELECT 2, * FROM n3 UNION ALL SELECT 3, * FROM n4),
took AS (SELECT pf.*, no, 'm_' || strftime(s, '%Y%m%d') || '_' || strftime(e, '%Y%m%d') AS shard, """ + STD_UNIT + """ AS unit
  FROM pf JOIN spans ON datetime BETWEEN s AND e WHERE datetime >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)""",
                               """final_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY datetime, parameter, location ORDER BY no, arrival) AS rn FROM took) WHERE rn = 1)"""),
                           "datetime:t parameter:s location:s value:d unit:s shard:s arrival:i")
    q["fetch_plan"] = fin(W(MV, PF, SHARDS, """lst AS (SELECT max(datetime) AS m FROM shards),
cases AS (SELECT 'as_of' AS "case", m AS fetch_start, TIMESTAMP '2024-01-31' AS fetch_end, false AS forced FROM lst
  UNION ALL SELECT 'soon', m, m + INTERVAL 1 HOUR, false FROM lst
  UNION ALL SELECT 'forced', m, m + INTERVAL 1 HOUR, true FROM lst
  UNION ALL SELECT 'first', TIMESTAMP '2024-01-31' - INTERVAL 90 DAY, TIMESTAMP '2024-01-31', false),
dy AS (SELECT *, CAST(floor((epoch(fetch_end) - epoch(fetch_start)) / 86400) AS BIGINT) AS days,
         'm_' || strftime(fetch_start, '%Y%m%d') || '_' || strftime(fetch_end, '%Y%m%d') AS label FROM cases)""",
                              """final_ AS (SELECT *, CASE WHEN forced THEN 'fetch' WHEN days < 1 THEN 'skipped'
        WHEN label IN (SELECT shard FROM shards) THEN 'stored' ELSE 'fetch' END AS status FROM dy)"""),
                          "case:s fetch_start:t fetch_end:t days:i label:s status:s")
    q["nested_payloads"] = fin(W(MV, PF, "final_ AS (SELECT *, 'u' AS unit FROM pf)"),
                               "datetime:t value:d parameter:s unit:s location:s latitude:d longitude:d")
    q["stream_ingest"] = fin(W(MV, "final_ AS (SELECT parameter, count(*) AS rows, max(datetime) AS watermark FROM mv GROUP BY parameter)"),
                             "parameter:s rows:i watermark:t")
    q["stream_dedup"] = fin(W(MV, PF, CLEAN, "final_ AS (SELECT * FROM clean)"), "datetime:t parameter:s location:s value:d arrival:i")
    q["stream_late"] = fin(W(MV, PF, CLEAN, "final_ AS (SELECT * FROM clean WHERE datetime >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)"),
                           "datetime:t parameter:s location:s arrival:i")
    q["stream_upsert"] = fin(W(MV, PF, CLEAN, "final_ AS (SELECT * FROM clean)"), "datetime:t parameter:s location:s value:d arrival:i")
    q["stream_hourly"] = fin(W(MV, PF, CLEAN, """sm1 AS (SELECT datetime, parameter, avg(value) AS v FROM clean WHERE value IS NOT NULL GROUP BY ALL)""",
                               "final_ AS (SELECT date_trunc('hour', datetime) AS hour, parameter, avg(v) AS value, count(*) AS readings FROM sm1 GROUP BY 1, 2)"),
                             "hour:t parameter:s value:d readings:i")

    def slide(over="", by="", col=""):
        """W3/W4 of every parameter over the filled hours up to its last observed one."""
        return " UNION ALL ".join(
            f"""SELECT {col}{n} AS length, hour - INTERVAL {n - 1} HOUR AS window_start, hour + INTERVAL 1 HOUR AS window_end, '{p}' AS parameter,
        avg({p}) OVER w AS mean, coalesce(stddev_samp({p}) OVER w, 0) AS std, count({p}) OVER w AS n
        FROM (SELECT {col}g.i, g.datetime AS hour, g.{p} FROM grid g JOIN g1 USING ({by}i) WHERE ni_{p} IS NOT NULL)
        WINDOW w AS ({over}ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)""" for n in ROLL for p in PARAMS)
    q["stream_sliding"] = fin(W(MV, PF, CLEAN, HW, GRID, f"final_ AS ({slide()})"), "length:i window_start:t window_end:t parameter:s mean:d std:d n:i")
    panel = [MV, PF, CLEAN, *PANEL]
    q["stream_sliding_panel"] = fin(W(*panel[:3], *PANEL[:3], f"final_ AS ({slide('PARTITION BY location ', 'location, ', 'location, ')})"),
                                    "location:s length:i window_start:t window_end:t parameter:s mean:d std:d n:i")
    q["feature_table_panel"] = fin(W(*panel, "final_ AS (SELECT * FROM ft)"), "location:s datetime:t " + " ".join(f"{c}:d" for c in feature_cols()))
    q["panel_split_summary"] = fin(W(*panel, "final_ AS (SELECT location, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ws GROUP BY ALL)"),
                                   "location:s split:s n:i first_ts:t last_ts:t")
    pscal = [x.replace("SELECT j FROM ws JOIN ftj USING (j)", "SELECT location, j FROM ws")
              .replace("SELECT f.j, count(*) AS w FROM ftj f JOIN tw ON f.j", "SELECT f.location, f.j, count(*) AS w FROM ftj f JOIN tw ON f.location = tw.location AND f.j")
              .replace("GROUP BY f.j)", "GROUP BY f.location, f.j)").replace("USING (j)", "USING (location, j)").replace("USING (feature)", "USING (location, feature)")
              .replace("' AS feature, w", "' AS feature, location, w").replace("SELECT feature, sum", "SELECT location, feature, sum").replace("SELECT sl.feature", "SELECT sl.location, sl.feature")
              .replace("GROUP BY feature)", "GROUP BY location, feature)").replace("GROUP BY sl.feature)", "GROUP BY sl.location, sl.feature)")
              .replace("SELECT feature, mean, CASE", "SELECT location, feature, mean, CASE") for x in scal]
    q["panel_feature_scaler"] = fin(W(*panel, *pscal, "final_ AS (SELECT * FROM scaler)"), "location:s feature:s mean:d scale:d")
    pcmp = ["""cl AS (SELECT location || '|b' AS lm, y, pred_seasonal AS pred FROM mp WHERE split = 'test'
               UNION ALL SELECT location || '|c', y, pred_ar1 FROM mp WHERE split = 'test')""", *metrics_sql("cl", "lm"),
            "cmp AS (SELECT b.lm[:-3] AS location, b.n AS n, " + ", ".join(f"{m}.{c} AS {m2}_{c}" for m, m2 in (("b", "baseline"), ("c", "candidate")) for c in METRIC_COLS) + """,
          (b.mse - c.mse) / (b.mse + 1e-8) * 100 AS mse_improvement_pct, (b.mae - c.mae) / (b.mae + 1e-8) * 100 AS mae_improvement_pct,
          (b.rmse - c.rmse) / (b.rmse + 1e-8) * 100 AS rmse_improvement_pct, (b.mse - c.mse) / (b.mse + 1e-8) * 100 >= 7.5 AS meets_claim
          FROM mm b JOIN mm c ON b.lm[:-3] = c.lm[:-3] AND b.lm LIKE '%|b' AND c.lm LIKE '%|c')"""]
    q["panel_metrics"] = fin(W(*panel, *pcmp, "final_ AS (SELECT * FROM cmp)"), "location:s " + CMP_SPEC)
    q["panel_ar1_fit"] = fin(W(*panel, "final_ AS (SELECT * FROM ar)"), "location:s n_train:i ar_a:d ar_phi:d")
    q["panel_recursive_forecast"] = fin("WITH RECURSIVE " + ",\n".join([*panel, ar2_sql("location, ", "GROUP BY location"), rec2_sql(True),
        """final_ AS (SELECT location, last_ts + h * INTERVAL 1 HOUR AS ts, h, hist[24] AS forecast, 'recursive' AS forecast_type FROM rec WHERE h > 0)"""]),
                                        "location:s ts:t h:i forecast:d forecast_type:s")
    q["panel_backtest_runs"] = fin(W(*panel, *panel_runs(), """final_ AS (SELECT location, batch_id, run_id, run_ts, 'events.parquet' AS data_path, 14 AS rolling_days,
        * EXCLUDE (location, batch_id, run_id, run_ts, run_date) FROM runs)"""), "location:s " + RUN_COLS)
    lags = [f"pm25_lag_{k}h" for k in TARGET_LAGS]
    wl = "wl AS (SELECT ws.location, ws.ts, ws.y, ws.split, " + ", ".join(f"f.{c}" for c in lags) + " FROM ws JOIN ftj f USING (location, j))"
    coefs = ", ".join(f"coef[{i + 1}] AS lag_{k}" for i, k in enumerate(TARGET_LAGS))
    q["panel_ar_lags"] = fin("WITH RECURSIVE " + ",\n".join([*panel, wl, *ols_sql("wl", lags, "lm"), f"final_ AS (SELECT location, n_train, intercept, {coefs} FROM lm)"]),
                             "location:s n_train:i intercept:d " + " ".join(f"lag_{k}:d" for k in TARGET_LAGS))
    step = " + ".join(f"coef[{i + 1}] * hist[{73 - k}]" for i, k in enumerate(TARGET_LAGS))
    q["panel_ar_lags_forecast"] = fin("WITH RECURSIVE " + ",\n".join([*panel, wl, *ols_sql("wl", lags, "lm"),
        """tl AS (SELECT * FROM (SELECT location, datetime, i, pm25, row_number() OVER (PARTITION BY location ORDER BY i DESC) AS rn FROM ft) WHERE rn <= 72)""",
        "h0 AS (SELECT location, max(datetime) AS last_ts, list(pm25 ORDER BY i) AS hist FROM tl GROUP BY location)",
        f"""rec AS (SELECT location, last_ts, 0 AS h, hist FROM h0 WHERE len(hist) = 72
  UNION ALL SELECT location, last_ts, h + 1, list_append(hist[2:], intercept + {step}) FROM rec JOIN lm USING (location) WHERE h < 24)""",
        """final_ AS (SELECT location, last_ts + h * INTERVAL 1 HOUR AS ts, h, hist[72] AS forecast, 'recursive' AS forecast_type FROM rec WHERE h > 0)"""]),
                                      "location:s ts:t h:i forecast:d forecast_type:s")
    wx = "wx AS MATERIALIZED (SELECT ws.location, ws.ts, ws.y, ws.split, " + ", ".join(f"f.{c} AS x_{c}" for c in feature_cols()) + \
        " FROM ws JOIN ftj f ON f.location = ws.location AND f.j = ws.j - 1)"
    q["panel_feature_forecast"] = fin("WITH RECURSIVE " + ",\n".join([*panel, wx, *ols_sql("wx", _x(feature_cols()), "lm"), *feature_recursion_sql(),
        """final_ AS (SELECT location, last_ts + h * INTERVAL 1 HOUR AS ts, h, hy[73] AS forecast, 'recursive' AS forecast_type FROM rec WHERE h > 0)"""]),
                                      "location:s ts:t h:i forecast:d forecast_type:s")
    q["panel_linear_score"] = fin("WITH RECURSIVE " + ",\n".join([*panel, wx, *ols_sql("wx", _x(feature_cols()), "lm"),
        f"""final_ AS (SELECT location, ts, split, y, intercept + list_sum(list_transform([{", ".join(_x(feature_cols()))}], lambda v, i: v * coef[i])) AS pred_linear
  FROM wx JOIN lm USING (location))"""]), "location:s ts:t split:s y:d pred_linear:d")
    view = "['arrival', 'datetime', 'latitude', 'location', 'longitude', 'parameter', 'sensor_id', 'unit', 'value']"
    need = "['datetime', 'value', 'parameter', 'unit', 'location', 'latitude', 'longitude']"
    counts = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("events", "lineitem", "nation"))
    q["column_checks"] = fin(f"""WITH have AS (SELECT table_name AS "table", list(column_name) AS c FROM information_schema.columns WHERE table_name IN ('events', 'lineitem', 'nation') GROUP BY 1
  UNION ALL SELECT 'view', {view}),
n AS ({counts} UNION ALL SELECT 'view', count(*) FROM events),
final_ AS (SELECT "table", rows, array_to_string(list_sort(list_filter({need}, lambda x: NOT list_contains(c, x))), ',') AS missing,
  list_sort(c) = {view} AS match, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains({view}, x))), ',') AS only_here FROM have JOIN n USING ("table"))""",
                             "table:s rows:i missing:s match:b only_here:s")
    tcmp = [x.replace("pred_seasonal", "pred_ar1", 1).replace("y, pred_ar1 FROM mp WHERE split = 'test')", "y, pred_tree FROM bt JOIN mp USING (location, ts, y) WHERE split = 'test')")
            if x.startswith("cl AS") else x for x in pcmp]
    q["tree_forecast"] = fin("WITH RECURSIVE " + ",\n".join([*panel, wx, *boosting_sql(_x(feature_cols())), *tcmp, "final_ AS (SELECT * FROM cmp)"]), "location:s " + CMP_SPEC)
    q["shard_contribution"] = fin(W(MV, PF, SHARDS, """final_ AS (SELECT shard, count(*) AS original_rows,
        CAST(min(datetime) AS DATE) AS first_date, CAST(max(datetime) AS DATE) AS last_date,
        count(*) FILTER (WHERE datetime >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY) AS retained_rows
        FROM shards GROUP BY shard HAVING count(*) FILTER (WHERE datetime >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY) > 0)"""),
                                  "shard:s original_rows:i first_date:dt last_date:dt retained_rows:i")
    q["rolling_merge"] = fin(W(MV, PF, MERGED, "final_ AS (SELECT * FROM merged)"),
                             "datetime:t parameter:s location:s value:d unit:s shard:s arrival:i")
    q["ingest_new_only"] = fin(W(MV, PF, """final_ AS (SELECT * FROM pf i WHERE datetime >= TIMESTAMP '2024-01-14'
        AND NOT EXISTS (SELECT 1 FROM pf s WHERE s.datetime < TIMESTAMP '2024-01-15' AND s.datetime = i.datetime
                        AND s.parameter = i.parameter AND s.location = i.location))"""),
                               "datetime:t parameter:s location:s arrival:i")
    q["incremental_batch"] = fin(W(MV, PF, """nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY datetime, parameter, location
        ORDER BY arrival) AS rn FROM pf WHERE datetime > TIMESTAMP '2024-01-20') WHERE rn = 1)""",
                                   "final_ AS (SELECT parameter, count(*) AS rows, max(datetime) AS new_watermark FROM nw GROUP BY parameter)"),
                                 "parameter:s rows:i new_watermark:t")
    q["span_profile"] = fin(W(MV, PF, MERGED, """final_ AS (SELECT min(datetime) AS first_ts, max(datetime) AS last_ts, count(*) AS rows,
        CAST(floor((epoch(max(datetime)) - epoch(min(datetime))) / 86400) AS BIGINT) AS span_days,
        CAST(floor((epoch(max(datetime)) - epoch(min(datetime))) / 86400) AS BIGINT) < 30 AS short_span FROM merged)"""),
                            "first_ts:t last_ts:t rows:i span_days:i short_span:b")
    q["distinct_dims"] = fin(W(*BASE[:3], """final_ AS (SELECT DISTINCT 'parameter' AS dimension, parameter AS value FROM clean
        UNION SELECT DISTINCT 'location', location FROM clean)"""), "dimension:s value:s")
    q["availability"] = fin(W(*BASE[:3], "final_ AS (SELECT parameter, min(datetime) AS earliest, max(datetime) AS latest, count(*) AS records FROM clean GROUP BY parameter)"),
                            "parameter:s earliest:t latest:t records:i")
    q["profile_compare"] = fin(W(MV, PF, MERGED,
                                 "oa AS (SELECT parameter, min(value) AS orig_min, max(value) AS orig_max, min(datetime) AS orig_first, max(datetime) AS orig_last FROM mv GROUP BY parameter)",
                                 "ma AS (SELECT parameter, min(value) AS merged_min, max(value) AS merged_max, min(datetime) AS merged_first, max(datetime) AS merged_last FROM merged GROUP BY parameter)",
                                 """final_ AS (SELECT coalesce(oa.parameter, ma.parameter) AS parameter,
        (orig_min IS NOT NULL AND merged_min IS NOT NULL) AS in_both,
        CASE WHEN orig_min IS NOT NULL AND merged_min IS NOT NULL THEN orig_min END AS orig_min,
        CASE WHEN orig_min IS NOT NULL AND merged_min IS NOT NULL THEN orig_max END AS orig_max,
        CASE WHEN orig_min IS NOT NULL AND merged_min IS NOT NULL THEN merged_min END AS merged_min,
        CASE WHEN orig_min IS NOT NULL AND merged_min IS NOT NULL THEN merged_max END AS merged_max,
        merged_last > orig_last AS has_newer, merged_first > orig_first AS starts_later
        FROM oa FULL OUTER JOIN ma ON oa.parameter = ma.parameter)"""),
                               "parameter:s in_both:b orig_min:d orig_max:d merged_min:d merged_max:d has_newer:b starts_later:b")
    q["describe_numeric"] = fin(W(*BASE[:3], "dl AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM clean WHERE {c} IS NOT NULL AND NOT isnan({c})"
        for c in ("value", "latitude", "longitude")) + ")",
                                  """final_ AS (SELECT feature, count(*) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
        quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
        FROM dl GROUP BY feature)"""),
                                "feature:s count:i mean:d std:d min:d p25:d p50:d p75:d max:d")
    li_psi = psi_sql("lref", "lcur", LI)
    q["psi_edges"] = fin(W(LI_PERIODS, li_psi[0], """edges AS (SELECT feature, quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM rlong GROUP BY feature)""",
                           "final_ AS (SELECT feature, unnest(range(0, 9)) AS edge_idx, unnest(e) AS edge FROM edges)"),
                         "feature:s edge_idx:i edge:d")
    q["psi_edges_bracketed"] = q["psi_edges"]
    q["describe_bracketed"] = fin(W("dl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM lineitem WHERE {c} IS NOT NULL" for c in LI) + ")",
                                    """final_ AS (SELECT feature, count(*) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
        quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max FROM dl GROUP BY feature)"""),
                                  "feature:s count:i mean:d std:d min:d p25:d p50:d p75:d max:d")
    q["psi_histogram"] = fin(W(LI_PERIODS, *li_psi, "final_ AS (SELECT * FROM hist)"),
                             "feature:s bin:i ref_count:i ref:d cur_count:i cur:d")
    q["psi_lineitem"] = fin(W(LI_PERIODS, *li_psi, "final_ AS (SELECT * FROM psi)"), "feature:s psi:d")
    f_psi = psi_sql("pref", "pcur", feature_cols())
    q["psi_by_feature"] = fin(W(*CHAIN, FEAT_PERIODS, *f_psi, "final_ AS (SELECT * FROM psi)"), "feature:s psi:d")
    q["psi_summary"] = fin(W(*CHAIN, FEAT_PERIODS, *f_psi, PSI_SUMMARY, "final_ AS (SELECT * FROM psum2)"),
                           "psi_score:d features_analyzed:i band:s recommendation:s")
    q["head_sample"] = fin(W("""hr AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'
        ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 1000)""",
                             """hc AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01'
        ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 1000)""",
                             "final_ AS (SELECT 'reference' AS period, * FROM hr UNION ALL SELECT 'current', * FROM hc)"),
                           "period:s l_orderkey:i l_linenumber:i " + " ".join(f"{c}:d" for c in LI))
    q["drift_report"] = fin(W(LI_PERIODS, *li_psi, PSI_SUMMARY, """final_ AS (SELECT psum2.*,
        (SELECT count(*) FROM lref) AS reference_samples, (SELECT count(*) FROM lcur) AS current_samples,
        (SELECT string_agg(feature || '=' || printf('%.6f', psi), ',' ORDER BY feature) FROM psi) AS feature_psi FROM psum2)"""),
                            "psi_score:d features_analyzed:i band:s recommendation:s reference_samples:i current_samples:i feature_psi:s judged:b")
    q["drift_baseline"] = fin(W(LI_PERIODS, *li_psi, PSI_SUMMARY, """final_ AS (
        SELECT 1 AS run, 1.0 AS psi_score, 4 AS features_analyzed, true AS judged, 'significant' AS band, 'retrain' AS recommendation, true AS first_run
        UNION ALL SELECT 2, psi_score, features_analyzed, judged, band, recommendation, false FROM psum2
        UNION ALL SELECT 3, 0.0, 3, false, 'none', 'skip', false)"""),
                              "run:i psi_score:d features_analyzed:i judged:b band:s recommendation:s first_run:b")
    q["drift_decision"] = fin(W(*RUNS, FEAT_PERIODS, *f_psi, PSI_SUMMARY, """final_ AS (SELECT psi_score, band, recommendation,
        coalesce((SELECT max(CAST(promoted AS INT)) FROM runs), 0) = 1 AS has_champion,
        psi_score > 0.15 OR false OR NOT (coalesce((SELECT max(CAST(promoted AS INT)) FROM runs), 0) = 1) AS retrain FROM psum2)"""),
                              "psi_score:d band:s recommendation:s has_champion:b retrain:b")
    dp = "'events.parquet'"
    runs_final = RUNS + [f"final_ AS (SELECT batch_id, run_id, run_ts, {dp} AS data_path, 14 AS rolling_days, * EXCLUDE (batch_id, run_id, run_ts, run_date) FROM runs)"]
    q["backtest_runs"] = fin(W(*runs_final), RUN_COLS)
    q["champion_history"] = fin(W(*RUNS, "final_ AS (SELECT run_id, candidate_rmse, promoted FROM runs)"),
                                "run_id:s candidate_rmse:d promoted:b")
    q["runs_upsert"] = fin(W(*RUNS, "mp2 AS (SELECT * FROM mp WHERE ts >= TIMESTAMP '2024-01-24')",
                             runs_cte("mp2", "pred_seasonal", "pred_ar1", "runs_b", "+ INTERVAL 1 HOUR", "_b"),
                             """final_ AS (SELECT * FROM (SELECT run_id, run_ts, candidate_rmse, baseline_rmse,
        row_number() OVER (PARTITION BY run_id ORDER BY run_ts DESC, src DESC) AS rn FROM
        (SELECT *, 0 AS src FROM runs UNION ALL SELECT *, 1 AS src FROM runs_b)) WHERE rn = 1)"""),
                           "run_id:s run_ts:t candidate_rmse:d baseline_rmse:d")
    q["merged_roundtrip"] = q["rolling_merge"]
    q["splits_roundtrip"] = fin(W(*WCHAIN, """final_ AS (SELECT ws.ts, ws.split, ws.y, (ws.y - (SELECT avg(y) FROM ws WHERE split = 'train')) / (SELECT stddev_pop(y) FROM ws WHERE split = 'train') AS y_scaled,
        72 AS n_steps, x.pm25_lag_1h AS x_last_lag1 FROM ws JOIN ftj x ON x.j = ws.j - 1)"""), "ts:t split:s y:d y_scaled:d n_steps:i x_last_lag1:d")
    q["predictions_roundtrip"] = fin(W(*WCHAIN, PRED_LOG, """final_ AS (SELECT form, model_version, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts, avg(predicted) AS mean
        FROM plog, (SELECT unnest(['parquet', 'csv']) AS form) GROUP BY ALL)"""), "form:s model_version:s n:i first_ts:t last_ts:t mean:d")
    q["runs_export"] = fin(W(*RUNS, "final_ AS (SELECT run_id, run_ts, candidate_rmse, baseline_rmse, row_number() OVER (ORDER BY run_ts DESC) AS place FROM runs)"),
                           "run_id:s run_ts:t candidate_rmse:d baseline_rmse:d place:i")
    q["drift_report_json"] = fin(W(LI_PERIODS, *psi_sql("lref", "lcur", LI), PSI_SUMMARY, "final_ AS (SELECT psi_score, features_analyzed, band, recommendation, feature, psi FROM psum2, psi)"),
                                 "psi_score:d features_analyzed:i band:s recommendation:s feature:s psi:d")
    q["runs_table_upsert"] = q["runs_upsert"]
    q["runs_trend_rmse"] = fin(W(*RUNS, "final_ AS (SELECT run_ts AS time, candidate_rmse, baseline_rmse FROM runs)"),
                               "time:t candidate_rmse:d baseline_rmse:d")
    q["runs_trend_mae"] = fin(W(*RUNS, "final_ AS (SELECT run_ts AS time, candidate_mae, baseline_mae FROM runs)"),
                              "time:t candidate_mae:d baseline_mae:d")
    q["runs_last10"] = fin(W(*RUNS, "final_ AS (SELECT batch_id, mse_improvement_pct FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 10)"),
                           "batch_id:s mse_improvement_pct:d")
    q["latest_rmse"] = fin(W(*RUNS, "final_ AS (SELECT candidate_rmse FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 1)"), "candidate_rmse:d")
    q["latest_r2"] = fin(W(*RUNS, "final_ AS (SELECT candidate_r2 FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 1)"), "candidate_r2:d")
    q["last_run"] = fin(W(*RUNS, "final_ AS (SELECT run_ts AS time, batch_id FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 1)"), "time:t batch_id:s")
    q["run_history20"] = fin(W(*RUNS, """final_ AS (SELECT batch_id, run_ts, candidate_rmse, baseline_rmse, mse_improvement_pct, candidate_r2
        FROM runs ORDER BY run_ts DESC, run_id DESC LIMIT 20)"""),
                             "batch_id:s run_ts:t candidate_rmse:d baseline_rmse:d mse_improvement_pct:d candidate_r2:d")
    q["runs_total"] = fin(W(*RUNS, "final_ AS (SELECT count(*) AS total_runs FROM runs)"), "total_runs:i")
    q["runs_summary"] = fin(W(*RUNS, """final_ AS (SELECT arg_max(candidate_rmse, run_ts) AS latest_rmse,
        min(candidate_rmse) AS best_rmse, arg_min(run_id, (candidate_rmse, run_id)) AS best_run_id, count(*) AS total_runs FROM runs)"""),
                            "latest_rmse:d best_rmse:d best_run_id:s total_runs:i")
    q["run_status_bands"] = fin(W(*RUNS, """final_ AS (SELECT run_id, run_ts,
        CASE WHEN mse_improvement_pct IS NULL THEN NULL WHEN mse_improvement_pct >= 7.5 THEN 'green' WHEN mse_improvement_pct >= 5 THEN 'yellow' ELSE 'red' END AS mse_improvement_status,
        CASE WHEN candidate_rmse IS NULL THEN NULL WHEN candidate_rmse >= 35 THEN 'red' WHEN candidate_rmse >= 20 THEN 'yellow' ELSE 'green' END AS rmse_status,
        CASE WHEN candidate_r2 IS NULL THEN NULL WHEN candidate_r2 >= 0.85 THEN 'green' WHEN candidate_r2 >= 0.7 THEN 'yellow' ELSE 'red' END AS r2_status
        FROM runs)"""), "run_id:s run_ts:t mse_improvement_status:s rmse_status:s r2_status:s")
    q["daily_metrics"] = fin(W(*WCHAIN, PRED_LOG, """final_ AS (SELECT CAST(timestamp AS DATE) AS date, model_version,
        avg(predicted) AS avg_prediction, min(predicted) AS min_prediction, max(predicted) AS max_prediction,
        count(*) AS predictions_count FROM plog GROUP BY CAST(timestamp AS DATE), model_version)"""),
                             "date:dt model_version:s avg_prediction:d min_prediction:d max_prediction:d predictions_count:i")
    q["prediction_summary"] = fin(W(*WCHAIN, PRED_LOG, """final_ AS (SELECT model_version, min(predicted) AS min, max(predicted) AS max,
        avg(predicted) AS mean, stddev_pop(predicted) AS std, count(*) AS n FROM plog GROUP BY model_version)"""),
                                  "model_version:s min:d max:d mean:d std:d n:i")
    q["shard_labels"] = fin(W(MV, PF, SHARDS, """final_ AS (SELECT shard, strftime(min(datetime), '%Y%m%d') AS start_label,
        strftime(max(datetime), '%Y%m%d') AS end_label, strftime(min(datetime), '%Y-%m-%dT%H:%M:%S') AS start_iso,
        'batch_' || strftime(max(datetime), '%Y%m%d_%H%M%S') AS batch_id FROM shards GROUP BY shard)"""),
                            "shard:s start_label:s end_label:s start_iso:s batch_id:s")
    q["flatten_payloads"] = fin(W("""final_ AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k_or_default FROM events)"""),
                                "event_id:i k:i k_or_default:i")
    return q


def oracle() -> dict:
    """Oracle SQL by query name."""
    return build()
