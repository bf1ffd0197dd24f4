"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, run over the whole test tables.

The measurement view over ``events`` (see ``sources.measurements``) stands in
for the sensor readings; ``lineitem`` serves the two-period drift check and
``nation`` the country lookup.  Every output is passed through
:func:`finalize` (doubles rounded to 6 decimals, -0.0 removed, timestamps as
``yyyy-MM-dd HH:mm:ss`` text, integers as bigint) so it can be compared with
the DuckDB oracle value by value.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorspark.constants import PARAMETERS, TARGET, TARGET_LAGS
from sensorspark.functions import metrics as MT
from sensorspark.operators import clean as C
from sensorspark.operators import drift as D
from sensorspark.operators import ingest as I
from sensorspark.operators import profile as P
from sensorspark.operators import resample as R
from sensorspark.operators import windows as W
from sensorspark.operators.features import (CYCLIC, feature_columns, feature_table, input_columns,
                                            sequence_windows)
from sensorspark.plans import boosting as BO
from sensorspark.plans import forecast as FC
from sensorspark.plans import ingest_run as IR
from sensorspark.plans import least_squares as LS
from sensorspark.plans import recursion as RC
from sensorspark.operators.blocks import join_series_stats
from sensorspark.plans import runs as RU
from sensorspark.session import checkpoint_dir, ensure_utc, materialize
from sensorspark.sources import measurements as S
from sensorspark.sources import run_store as RS
from sensorspark.sources.sinks import (append_runs, drift_report_frame, export_runs_csv, write_json_report, write_merged, write_predictions,
                                       write_shards, write_splits)

AS_OF = "2024-01-31 00:00:00"
RETENTION_DAYS = 14
SPLIT_TS = "1998-06-01"
LINEITEM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CENTRE = (28.6139, 77.2090)
T_LEN = 72
LAG1, LAG24 = f"{TARGET}_lag_1h", f"{TARGET}_lag_24h"


def finalize(df: DataFrame) -> DataFrame:
    """Comparison-friendly output types (see module docstring); the oracle
    applies the identical normalisation."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # +1e-9 moves the rounding tie away from values like x.xxxxxx5 that
            # averages of 2-decimal data hit exactly, where the last bits of a
            # differently ordered sum would decide the 6th decimal
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def join_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (broadcast, equi-join on a constant key)."""
    return join_series_stats(df, one_row, ())


# ---------------------------------------------------------------- shared bases
def mview(spark, sf, **bounds):
    """The measurement view; time bounds and parameters reach the scan."""
    ensure_utc(spark)
    return S.events_measurements(spark, sf, **bounds)


def allowed(spark, sf, **bounds):
    return C.param_filter(mview(spark, sf, parameters=PARAMETERS, **bounds))


def cleaned(spark, sf):
    """Allow-listed parameters, keep-first dedup by arrival."""
    return I.dedup_first(allowed(spark, sf), order=("arrival",))


def hourly(spark, sf, series=()):
    return R.hourly_wide(cleaned(spark, sf), PARAMETERS, series_cols=series)


def features(spark, sf, series=()):
    """The feature table, materialized: many queries reuse it several times."""
    return materialize(feature_table(hourly(spark, sf, series), series_cols=series))


def split_windows(spark, sf, feats=None, series=(), last=()):
    f = feats if feats is not None else features(spark, sf, series)
    w = sequence_windows(f, series_cols=series, with_x=False, keep=[LAG1, LAG24], last=last)
    return materialize(W.chrono_split(w, series))


def shards(spark, sf, **bounds):
    return S.week_shards(allowed(spark, sf, **bounds))


def shard_folder(spark, sf):
    """The weekly shards as files; returns their folder."""
    ensure_utc(spark)
    root = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(C.standardize(shards(spark, sf)), root)
    return root


SHARD_SCHEMA = T.StructType([*S.MEASUREMENT_SCHEMA.fields, T.StructField("sensor_id", T.LongType()), T.StructField("arrival", T.LongType())])


def retained_since():
    """First time that the retention keeps."""
    return str(datetime.fromisoformat(AS_OF) - timedelta(days=RETENTION_DAYS))


def first_of_shards(s):
    """Keep-first by shard, then arrival, without sorting the readings."""
    s = s.withColumn("_no", S.shard_number(F.col("shard")))
    return I.dedup_first(s, order=("_no", "arrival"), dictionary=("unit", "shard")).drop("_no")


def merged(spark, sf):
    """rolling merge: shards -> standardize -> retention -> keep-first dedup.
    The retention bound holds for all copies of a reading, so it is put on
    the scan."""
    s = C.standardize(shards(spark, sf, since=retained_since()))
    return first_of_shards(C.retention_filter(s, AS_OF, RETENTION_DAYS))


def naive_preds(spark, sf, feats=None, series=()):
    return FC.naive_forecast(split_windows(spark, sf, feats, series))


def model_preds(spark, sf, feats=None, series=()):
    """Windows with persistence, seasonal and AR(1) predictions."""
    sw = naive_preds(spark, sf, feats, series)
    model = FC.ar1_fit(sw, series_cols=series)
    return FC.ar1_predict(sw, model, series_cols=series)


def runs(spark, sf, preds=None, series=()):
    p = preds if preds is not None else naive_preds(spark, sf, series=series)
    return RU.backtest_runs(p, "pred_seasonal", "pred_persistence", "events.parquet", RETENTION_DAYS,
                            series_cols=series, persistence="pred_persistence")


def lineitem_counts(spark, sf):
    """Bin counts of lineitem before and from SPLIT_TS, in one scan."""
    li = S.read_table(spark, sf, "lineitem").select(*LINEITEM_COLS, "l_shipdate")
    before = F.col("l_shipdate").cast("timestamp") < F.lit(SPLIT_TS).cast("timestamp")
    return D.period_counts(li.filter("l_shipdate IS NOT NULL"), before, ~before, LINEITEM_COLS)


def feature_counts(spark, sf, feats=None):
    """Bin counts of the first and the last third of the feature rows (by time)."""
    f = feats if feats is not None else features(spark, sf)
    st = f.agg(F.min("pos").alias("_a"), F.count(F.lit(1)).alias("_n"))
    f = join_one(f, st)
    third = F.floor(F.col("_n") / F.lit(3))
    idx = F.col("pos") - F.col("_a")
    return D.period_counts(f, idx < third, idx >= F.col("_n") - third, feature_columns())


# ---------------------------------------------------------------- queries
def q_scan_measurements(spark, sf):
    return mview(spark, sf)


def q_standardize(spark, sf):
    return C.standardize(mview(spark, sf)).drop("sensor_id")


def q_retention_filter(spark, sf):
    s = C.retention_filter(C.standardize(mview(spark, sf, since=retained_since())), AS_OF, RETENTION_DAYS)
    return s.select("datetime", "parameter", "location", "value", "arrival")


def q_param_filter(spark, sf):
    return allowed(spark, sf).select("arrival", "parameter")


def q_bbox_filter(spark, sf):
    return C.bbox_filter(mview(spark, sf)).select("arrival", "location")


def q_radius_filter(spark, sf):
    return C.radius_filter(mview(spark, sf), *CENTRE, 25000).select("arrival", "location")


def q_country_filter(spark, sf):
    nation = S.read_table(spark, sf, "nation")
    return C.country_filter(nation, C.country_codes(spark), ["in", "Us", "gb", "cn", "fr"], "n_nationkey") \
            .select("n_nationkey", "n_name")


def q_sensor_range_topn(spark, sf):
    first, last = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    return C.sensor_range_topn(mview(spark, sf, since=first, until=last), first, last, 5) \
            .select("sensor_id", "datetime", "arrival", "value")


def q_pivot_mean(spark, sf):
    return R.pivot_mean(cleaned(spark, sf), PARAMETERS)


def q_hourly_mean(spark, sf):
    return hourly(spark, sf)


def q_hour_spine(spark, sf):
    return R.hour_spine(hourly(spark, sf))


def q_gap_fill(spark, sf):
    return R.gap_fill(hourly(spark, sf))


def q_feature_table(spark, sf):
    return features(spark, sf).drop("pos")


def _feat_subset(cols):
    def q(spark, sf):
        return features(spark, sf).select("datetime", *cols)
    return q


def q_dropna_features(spark, sf):
    h = materialize(hourly(spark, sf))
    g = R.gap_fill(h, checkpoint=False)
    f = feature_table(h, checkpoint=False)
    a = g.agg(F.count(F.lit(1)).alias("spine_rows"))
    b = f.agg(F.count(F.lit(1)).alias("feature_rows"))
    return join_one(a, b).withColumn("dropped_rows", F.col("spine_rows") - F.col("feature_rows"))


def q_sequence_windows(spark, sf):
    w = sequence_windows(features(spark, sf), with_x=True)
    x = F.col("x")
    return w.select("ts", "y", F.size(x).alias("n_steps"),
                    F.aggregate(x, F.lit(0.0), lambda a, s: a + s["pm10"]).alias("x_pm10_sum"),
                    F.element_at(x, -1)[LAG1].alias("x_last_lag1"),
                    F.element_at(x, 1)["hour_sin"].alias("x_first_hour_sin"),
                    # every value of the array, weighed by its place
                    (F.aggregate(F.transform(x, lambda r, i: (i + 1) * reduce(lambda a, b: a + b, [r[c] for c in input_columns()])),
                                 F.lit(0.0), lambda a, v: a + v) / F.lit(float(T_LEN * T_LEN * len(input_columns())))).alias("x_digest"))


def q_chrono_split(spark, sf):
    return split_windows(spark, sf).select("ts", "widx", "split")


def q_split_summary(spark, sf):
    return W.split_summary(split_windows(spark, sf))


def q_window_summary(spark, sf):
    return W.window_summary(split_windows(spark, sf))


def q_latest_windows(spark, sf):
    return W.latest_windows(split_windows(spark, sf), 100).select("ts", "y")


def q_fit_feature_scaler(spark, sf):
    return W.fit_feature_scaler(features(spark, sf), input_columns(), T_LEN)


def q_fit_target_scaler(spark, sf):
    return W.fit_target_scaler(split_windows(spark, sf))


def q_scale_features(spark, sf):
    f = features(spark, sf)
    sc = W.fit_feature_scaler(f, input_columns(), T_LEN)
    return W.scale_features(f.select("datetime", *input_columns()), sc, input_columns())


def q_inverse_transform(spark, sf):
    sw = naive_preds(spark, sf)
    ts = W.fit_target_scaler(sw)
    s = W.scale_target(sw, ts, col="pred_persistence", out="pred_scaled")
    s = W.scale_target(s, ts, col="y", out="y_scaled")
    return W.inverse_transform(s, ts, col="pred_scaled", out="pred_raw").select("ts", "y_scaled", "pred_scaled", "pred_raw")


def q_naive_forecast(spark, sf):
    return naive_preds(spark, sf).select("ts", "y", "pred_persistence", "pred_seasonal")


def q_persistence_rmse(spark, sf):
    return MT.persistence_rmse(split_windows(spark, sf), LAG1)


def q_regression_metrics(spark, sf):
    p = model_preds(spark, sf).filter(F.col("split") == "test")
    long = p.select("y", F.explode(F.array(
        F.struct(F.lit("persistence").alias("model"), F.col("pred_persistence").alias("pred")),
        F.struct(F.lit("seasonal").alias("model"), F.col("pred_seasonal").alias("pred")),
        F.struct(F.lit("ar1").alias("model"), F.col("pred_ar1").alias("pred")))).alias("m"))
    return MT.regression_metrics(long.select("y", "m.model", "m.pred"), group_cols=["model"], few_groups=True)


def q_compare_models(spark, sf):
    p = naive_preds(spark, sf).filter(F.col("split") == "test")
    return MT.compare_models(p, "y", "pred_seasonal", "pred_persistence")


def q_forecast_eval(spark, sf):
    """test-split comparison of seasonal naive (baseline) and AR(1)
    (candidate) with the persistence RMSE and the quality alarm."""
    sw = model_preds(spark, sf)
    cmp = MT.compare_models(sw.filter(F.col("split") == "test"), "y", "pred_seasonal", "pred_ar1")
    pr = MT.persistence_rmse(sw, LAG1)
    out = join_one(cmp, pr)
    return out.withColumn("quality_alarm", MT.quality_alarm(F.col("candidate_rmse"), F.col("persistence_rmse")))


def q_quality_alarm(spark, sf):
    """AR(1), persistence and a forecast of zero against the persistence RMSE
    (the last is bad enough to raise the alarm)."""
    sw = materialize(model_preds(spark, sf).withColumn("pred_zero", F.lit(0.0)))
    test = sw.filter(F.col("split") == "test")
    pr = MT.persistence_rmse(sw, LAG1).select("persistence_rmse")
    cmp = MT.compare_models(test, "y", "pred_zero", "pred_ar1").select("candidate_rmse", "baseline_rmse")
    j = join_one(cmp, pr)
    return j.select("candidate_rmse", "baseline_rmse", "persistence_rmse",
                    MT.quality_alarm(F.col("candidate_rmse"), F.col("persistence_rmse")).alias("candidate_alarm"),
                    MT.quality_alarm(F.col("baseline_rmse"), F.col("persistence_rmse")).alias("baseline_alarm"))


def q_align_predictions(spark, sf):
    """Two prediction tables (the candidate's holds no train rows) and the
    truth, aligned by time, then compared."""
    p = model_preds(spark, sf)
    candidate = p.filter("split <> 'train'").select("ts", F.col("pred_ar1").alias("pred"))
    a = MT.align_predictions(p, p.select("ts", F.col("pred_seasonal").alias("pred")), candidate, ["ts"])
    return MT.compare_models(a)


def q_ar1_fit(spark, sf):
    return FC.ar1_fit(split_windows(spark, sf))


def q_ar1_predict(spark, sf):
    return model_preds(spark, sf).filter(F.col("split") == "test").select("ts", "y", "pred_ar1")


def q_recursive_forecast(spark, sf):
    f = features(spark, sf)
    model = FC.ar1_fit(split_windows(spark, sf, feats=f))
    return FC.ar1_recursive_forecast(f, model, 24)


def q_forecast_grid(spark, sf):
    last = FC.last_observation(features(spark, sf))
    return FC.forecast_grid(last, 24).select("h", "ts")


def q_dedup_first(spark, sf):
    return first_of_shards(shards(spark, sf)) \
            .select("datetime", "parameter", "location", "value", "shard", "arrival")


def q_duplicate_count(spark, sf):
    return I.duplicate_count(allowed(spark, sf))


def q_merge_shards(spark, sf):
    """All shards of a folder as one table (U1), counted per shard."""
    u = S.read_shards(spark, shard_folder(spark, sf), schema=SHARD_SCHEMA)
    return u.groupBy("shard").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                  F.count_distinct("arrival").cast("bigint").alias("readings"))


def q_shard_roundtrip(spark, sf):
    """Shards written as files, scanned, merged, retained and deduplicated."""
    u = S.read_shards(spark, shard_folder(spark, sf), schema=SHARD_SCHEMA)
    m = first_of_shards(C.retention_filter(u, AS_OF, RETENTION_DAYS))
    return m.select("datetime", "parameter", "location", "value", "unit", "shard", "arrival")


def q_fetch_plan(spark, sf):
    """What the next ingest fetches: as of the retention date, one hour after
    the last reading, and that forced."""
    s = materialize(shards(spark, sf).select("datetime", "shard"))
    last = s.agg(F.max("datetime").alias("m")).first().m
    soon = None if last is None else str(last + timedelta(hours=1))
    plans = [("as_of", I.fetch_plan(s, AS_OF)), ("soon", I.fetch_plan(s, soon)), ("forced", I.fetch_plan(s, soon, force=True)),
             ("first", I.fetch_plan(s.filter("false"), AS_OF))]
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("case"), "*") for n, p in plans])


def q_shard_contribution(spark, sf):
    return I.shard_contribution(C.standardize(shards(spark, sf)), AS_OF, RETENTION_DAYS)


def q_rolling_merge(spark, sf):
    return merged(spark, sf).select("datetime", "parameter", "location", "value", "unit", "shard", "arrival")


def q_ingest_new_only(spark, sf):
    m = allowed(spark, sf)
    stored = m.filter(F.col("datetime") < F.lit("2024-01-15 00:00:00").cast("timestamp"))
    incoming = m.filter(F.col("datetime") >= F.lit("2024-01-14 00:00:00").cast("timestamp"))
    return I.new_rows(incoming, stored).select("datetime", "parameter", "location", "arrival")


def q_span_profile(spark, sf):
    return P.span_profile(merged(spark, sf))


def q_distinct_dims(spark, sf):
    return P.distinct_dims(cleaned(spark, sf))


def q_availability(spark, sf):
    return P.availability(cleaned(spark, sf))


def q_profile_compare(spark, sf):
    return P.profile_compare(C.standardize(mview(spark, sf)), merged(spark, sf))


def q_describe_numeric(spark, sf):
    cols = ["value", "latitude", "longitude"]
    return D.describe_numeric(materialize(cleaned(spark, sf).select(*cols)), cols)


def q_psi_edges(spark, sf):
    li = S.read_table(spark, sf, "lineitem").filter(F.col("l_shipdate").cast("timestamp") < F.lit(SPLIT_TS).cast("timestamp"))
    e = D.psi_edges(li, LINEITEM_COLS)
    return e.select("feature", F.posexplode("edges").alias("edge_idx", "edge"))


def q_psi_edges_bracketed(spark, sf):
    """The same by sketches and brackets, as a table of any size takes it."""
    li = S.read_table(spark, sf, "lineitem").filter(F.col("l_shipdate").cast("timestamp") < F.lit(SPLIT_TS).cast("timestamp"))
    e = D.psi_edges(li, LINEITEM_COLS, accuracy=200, small=0, most=500)
    return e.select("feature", F.posexplode("edges").alias("edge_idx", "edge"))


def q_describe_bracketed(spark, sf):
    """The profile of lineitem's columns by sketches and brackets."""
    return D.describe_numeric(S.read_table(spark, sf, "lineitem"), LINEITEM_COLS, accuracy=200, small=0, most=500)


def q_psi_histogram(spark, sf):
    return D.psi_histogram(lineitem_counts(spark, sf))


def q_psi_by_feature(spark, sf):
    return D.psi_of(feature_counts(spark, sf))


def q_psi_summary(spark, sf):
    return D.psi_summary(D.psi_of(feature_counts(spark, sf))).drop("judged")


def q_psi_lineitem(spark, sf):
    return D.psi_of(lineitem_counts(spark, sf))


def q_head_sample(spark, sf):
    """L4: the first 1000 rows of each period by time (a top-k report)."""
    li = S.read_table(spark, sf, "lineitem")
    before = F.col("l_shipdate").cast("timestamp") < F.lit(SPLIT_TS).cast("timestamp")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    cols = ["period", "l_orderkey", "l_linenumber", *LINEITEM_COLS]
    return D.head_sample(li.filter(before), order).withColumn("period", F.lit("reference")).select(*cols).unionByName(
        D.head_sample(li.filter(~before), order).withColumn("period", F.lit("current")).select(*cols))


def q_drift_report(spark, sf):
    """Score, sample counts and the PSI of every feature."""
    c = materialize(lineitem_counts(spark, sf))
    psi = D.psi_of(c)
    s = D.psi_summary(psi, min_features=len(LINEITEM_COLS))
    # rows with any value: the largest count of a feature
    n = c.agg(F.max("ref_n").cast("bigint").alias("reference_samples"), F.max("cur_n").cast("bigint").alias("current_samples"))
    r = drift_report_frame(join_one(s, n), psi)
    entry = lambda k: F.concat(k, F.lit("="), F.format_string("%.6f", F.col("feature_psi")[k]))
    return r.withColumn("feature_psi", F.array_join(F.transform(F.array_sort(F.map_keys("feature_psi")), entry), ","))


def q_drift_baseline(spark, sf):
    """The drift check with a saved baseline: the first run stores the early
    period and always retrains, the second holds the late one against it."""
    ensure_utc(spark)
    path = f"{checkpoint_dir(spark)}/baseline-{uuid.uuid4().hex}"
    li = S.read_table(spark, sf, "lineitem")
    before = F.col("l_shipdate").cast("timestamp") < F.lit(SPLIT_TS).cast("timestamp")
    run = lambda n, df: D.drift_against_baseline(df.select(*LINEITEM_COLS), path, min_features=4).withColumn("run", F.lit(n))
    first = run(1, li.filter(before))
    return first.unionByName(run(2, li.filter(~before))).unionByName(
        D.drift_against_baseline(li.select(*LINEITEM_COLS[:3]), path).withColumn("run", F.lit(3)))


def q_drift_decision(spark, sf):
    f = features(spark, sf)
    s = D.psi_summary(D.psi_of(feature_counts(spark, sf, f)))
    champ = runs(spark, sf, naive_preds(spark, sf, f)).agg(F.max(F.col("promoted").cast("int")).alias("_c"))
    j = join_one(s, champ)
    has = F.coalesce(F.col("_c"), F.lit(0)) == 1
    return j.select("psi_score", "band", "recommendation", has.alias("has_champion"),
                    D.retrain_decision(F.col("psi_score"), F.lit(False), has).alias("retrain"))


def q_backtest_runs(spark, sf):
    return runs(spark, sf)


def q_champion_history(spark, sf):
    return runs(spark, sf).select("run_id", "candidate_rmse", "promoted")


def q_runs_upsert(spark, sf):
    """Restated runs for the last 7 days (AR(1) as candidate, one hour later)
    replace the earlier versions; other days keep theirs."""
    p = materialize(model_preds(spark, sf))
    base = runs(spark, sf, p)
    p = p.filter(F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp"))
    again = RU.backtest_runs(p, "pred_seasonal", "pred_ar1", "events.parquet", RETENTION_DAYS,
                             persistence="pred_persistence")
    again = again.withColumn("run_ts", F.col("run_ts") + F.expr("INTERVAL 1 HOURS"))
    return RU.runs_upsert(base, again).select("run_id", "run_ts", "candidate_rmse", "baseline_rmse")


def q_runs_table_upsert(spark, sf):
    """The same restatement through the stored table: each batch is committed
    twice, one is staged and never committed, and the table is compacted between."""
    ensure_utc(spark)
    path = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    p = materialize(model_preds(spark, sf))
    base = materialize(runs(spark, sf, p))
    late = p.filter(F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp"))
    again = RU.backtest_runs(late, "pred_seasonal", "pred_ar1", "events.parquet", RETENTION_DAYS, persistence="pred_persistence")
    again = again.withColumn("run_ts", F.col("run_ts") + F.expr("INTERVAL 1 HOURS"))
    RS.stage_runs(base.withColumn("candidate_rmse", F.lit(-1.0)), path)
    for batch, rows in (("backtest", base), ("restated", again)):
        RS.commit_runs(rows, path, batch)
        RS.commit_runs(rows.withColumn("candidate_rmse", F.lit(-2.0)), path, batch)
        RS.compact_runs(spark, path, f"{batch}-compact")
    return RS.read_runs(spark, path).select("run_id", "run_ts", "candidate_rmse", "baseline_rmse")


def q_ingest_runs(spark, sf):
    """Ingest runs as of five moments over the stored readings: the second is
    within a day of the first reading's end, the third is lost before its
    commit and starts again, the fourth is forced."""
    ensure_utc(spark)
    root = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"

    def fetch(start, end):
        return allowed(spark, sf, since=start.replace("T", " "), until=end.replace("T", " "))

    def lost(step):
        if step == "merge":
            raise ConnectionError("lost")
    for now, options in (("2024-01-08 12:00:00", {}), ("2024-01-08 18:00:00", {}), ("2024-01-20 06:00:00", {"after_step": lost}), ("2024-01-20 06:00:00", {}),
                         ("2024-01-20 09:00:00", {"force": True}), (AS_OF, {})):
        try:
            IR.run_ingest(spark, fetch, root, now, RETENTION_DAYS, **options)
        except ConnectionError:
            continue
    return IR.read_merged(spark, root).select("datetime", "parameter", "location", "value", "unit", "shard", "arrival")


def _folder(spark, name):
    ensure_utc(spark)
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_merged_roundtrip(spark, sf):
    """The merged table written by date and read back."""
    path = _folder(spark, "merged")
    write_merged(merged(spark, sf), path)
    return spark.read.parquet(path).select("datetime", "parameter", "location", "value", "unit", "shard", "arrival")


def q_splits_roundtrip(spark, sf):
    """Windows with their whole arrays, scaled and raw target, by split."""
    path = _folder(spark, "splits")
    w = W.chrono_split(sequence_windows(features(spark, sf), with_x=True))
    ts = W.fit_target_scaler(w)
    write_splits(W.scale_target(w, ts, col="y", out="y_scaled").select("ts", "y", "y_scaled", "x", "split"), path)
    last = F.element_at("x", -1)
    return spark.read.parquet(path).select("ts", "split", "y", "y_scaled", F.size("x").alias("n_steps"), last[LAG1].alias("x_last_lag1"))


def q_predictions_roundtrip(spark, sf):
    """The prediction log as parquet and CSV; the day's metrics from the CSV."""
    path = _folder(spark, "predictions")
    log = materialize(_prediction_log(spark, sf))
    write_predictions(log, path)
    both = spark.read.parquet(f"{path}/parquet").select(F.lit("parquet").alias("form"), "*").unionByName(
        spark.read.schema(log.schema).option("header", True).csv(f"{path}/csv").select(F.lit("csv").alias("form"), "*"))
    return both.groupBy("form", "model_version").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
                                                     F.avg("predicted").alias("mean"))


def q_runs_export(spark, sf):
    """A batch of runs appended twice, exported newest first and read
    back, with the place of each line."""
    path = _folder(spark, "export")
    r = runs(spark, sf).select("run_id", "run_ts", "candidate_rmse", "baseline_rmse")
    r = materialize(r)
    for _ in range(2):
        append_runs(r, f"{path}/store", "backtest")
    export_runs_csv(RS.read_runs(spark, f"{path}/store"), f"{path}/csv")
    back = spark.read.schema(r.schema).option("header", True).csv(f"{path}/csv").select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    line = F.row_number().over(Window.partitionBy("_f").orderBy(F.col("run_ts").desc()))        # a file holds one range
    place = back.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return back.withColumn("_l", line).join(place.select("_f", before.alias("_o")), "_f").select(
        "run_id", "run_ts", "candidate_rmse", "baseline_rmse", (F.col("_o") + F.col("_l")).alias("place"))


def q_drift_report_json(spark, sf):
    """The drift report written as JSON and read back."""
    path = _folder(spark, "report")
    c = materialize(lineitem_counts(spark, sf))
    psi = D.psi_of(c)
    write_json_report(drift_report_frame(D.psi_summary(psi, min_features=len(LINEITEM_COLS)), psi), path)
    back = spark.read.schema("psi_score double, features_analyzed long, judged boolean, band string, recommendation string, feature_psi map<string,double>").json(path)
    return back.select("psi_score", "features_analyzed", "band", "recommendation", F.explode("feature_psi").alias("feature", "psi"))


def q_runs_trend_rmse(spark, sf):
    return runs(spark, sf).select(F.col("run_ts").alias("time"), F.col("candidate_rmse"), F.col("baseline_rmse"))


def q_runs_trend_mae(spark, sf):
    return runs(spark, sf).select(F.col("run_ts").alias("time"), F.col("candidate_mae"), F.col("baseline_mae"))


def q_runs_last10(spark, sf):
    return RU.latest_runs(runs(spark, sf), 10, ["batch_id", "mse_improvement_pct"])


def q_latest_rmse(spark, sf):
    return RU.latest_runs(runs(spark, sf), 1, ["candidate_rmse"])


def q_latest_r2(spark, sf):
    return RU.latest_runs(runs(spark, sf), 1, ["candidate_r2"])


def q_last_run(spark, sf):
    return RU.latest_runs(runs(spark, sf), 1, [F.col("run_ts").alias("time"), "batch_id"])


def q_run_history20(spark, sf):
    return RU.latest_runs(runs(spark, sf), 20, ["batch_id", "run_ts", "candidate_rmse", "baseline_rmse",
                                                "mse_improvement_pct", "candidate_r2"])


def q_runs_total(spark, sf):
    return runs(spark, sf).agg(F.count(F.lit(1)).cast("bigint").alias("total_runs"))


def q_runs_summary(spark, sf):
    return RU.runs_summary(runs(spark, sf))


def q_run_status_bands(spark, sf):
    return RU.run_status_bands(runs(spark, sf))


def _prediction_log(spark, sf):
    p = model_preds(spark, sf)
    return p.select(F.col("ts").alias("timestamp"), F.explode(F.array(
        F.struct(F.col("pred_persistence").alias("predicted"), F.lit("persistence").alias("model_version")),
        F.struct(F.col("pred_ar1").alias("predicted"), F.lit("ar1").alias("model_version")))).alias("p")) \
        .select("timestamp", "p.predicted", "p.model_version")


def q_daily_metrics(spark, sf):
    return RU.daily_metrics(_prediction_log(spark, sf))


def q_prediction_summary(spark, sf):
    return RU.prediction_summary(_prediction_log(spark, sf), by=["model_version"])


def q_shard_labels(spark, sf):
    s = shards(spark, sf).groupBy("shard").agg(F.min("datetime").alias("first_ts"), F.max("datetime").alias("last_ts"))
    return s.select("shard", F.date_format("first_ts", "yyyyMMdd").alias("start_label"),
                    F.date_format("last_ts", "yyyyMMdd").alias("end_label"),
                    F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_iso"),
                    F.concat(F.lit("batch_"), F.date_format("last_ts", "yyyyMMdd_HHmmss")).alias("batch_id"))


def q_flatten_payloads(spark, sf):
    ev = S.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select("event_id", k.alias("k"), F.coalesce(k, F.lit(-1)).alias("k_or_default"))


def q_nested_payloads(spark, sf):
    """Landed payloads (one per sensor, parameter and day, times as objects or
    plain strings) flattened to rows."""
    ensure_utc(spark)
    ev = S.read_table(spark, sf, "events")
    m = S.measurement_view(ev)
    iso = F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    when = F.when(F.col("value") < 50, F.concat(F.lit('{"utc":"'), iso, F.lit('"}'))).otherwise(iso)
    p = m.groupBy("sensor_id", "parameter", "location", "latitude", "longitude", F.to_date("datetime").alias("day")).agg(
        F.collect_list(F.struct("value", F.struct(when.alias("datetimeFrom")).alias("period"))).alias("measurements"))    # a sensor's day
    p = p.select(F.struct(F.col("sensor_id").alias("id"), F.col("location").alias("name"), F.struct("latitude", "longitude").alias("coordinates")).alias("location"),
                 F.struct(F.col("sensor_id").alias("id"), F.struct(F.upper("parameter").alias("name"), F.lit("u").alias("units")).alias("parameter")).alias("sensor"),
                 "measurements")
    return S.flatten_payloads(p, PARAMETERS)


def q_incremental_batch(spark, sf):
    """Batch form of the incremental ingest: readings after the high-watermark
    (2024-01-20), not yet stored, deduplicated; counted per parameter."""
    wm = "2024-01-20 00:00:00"
    m = allowed(spark, sf, since=wm)
    new = I.dedup_first(m.filter(F.col("datetime") > F.lit(wm).cast("timestamp")), order=("arrival",))
    return new.groupBy("parameter").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                        F.max("datetime").alias("new_watermark"))


def q_cyclic(spark, sf):
    return features(spark, sf).select("datetime", *CYCLIC)


def _linear_scored(spark, sf):
    """M2/M3: z-scored last-row features of each window -> pyspark.ml linear
    regression on the train split (z-scored target) -> scores for all
    windows, inverse-transformed to raw units."""
    f = features(spark, sf)
    cols = input_columns()
    sw = split_windows(spark, sf, f, last=cols)
    last = sw.select("ts", "y", "split", *[F.col(f"x_{c}").alias(c) for c in cols])
    sc = W.fit_feature_scaler(f, cols, T_LEN)
    scaled = W.scale_features(last, sc, cols)
    ts = W.fit_target_scaler(sw)
    # the fit makes several passes: cut the wide lineage once (this also keeps
    # Catalyst's constraint propagation away from ~100 aliased columns)
    scaled = materialize(W.scale_target(scaled, ts, col="y", out="y_scaled"))
    va, model, _ = FC.fit_linear_forecaster(scaled.filter(F.col("split") == "train"), cols)
    scored = FC.batch_score(scaled, va, model)
    return W.inverse_transform(scored, ts, col="pred_scaled", out="pred_linear")


def q_linear_forecast(spark, sf):
    p = _linear_scored(spark, sf).filter(F.col("split") == "test")
    return MT.regression_metrics(p, "y", "pred_linear")


def q_batch_score(spark, sf):
    return _linear_scored(spark, sf).select("ts", "split", "y", "pred_linear")


AR_LAGS = {1: LAG1, 24: LAG24}


def q_ar_fit(spark, sf):
    return FC.ar_fit(split_windows(spark, sf), AR_LAGS)


def q_recursive_forecast_general(spark, sf):
    """M4 with two lags (1 and 24 hours), coefficients fitted on the train split."""
    f = features(spark, sf)
    return FC.recursive_forecast(f, FC.ar_fit(split_windows(spark, sf, f), AR_LAGS), AR_LAGS, 24)


# ------------------------------------------------------------ per-location panel
LOC = ("location",)


def q_feature_table_panel(spark, sf):
    """The feature chain at the per-location grain (the scalable panel):
    spine, gap fill, lags and windows per location, blocked by time."""
    return feature_table(hourly(spark, sf, LOC), series_cols=LOC).drop("pos")


def q_panel_split_summary(spark, sf):
    return W.split_summary(split_windows(spark, sf, series=LOC), LOC)


def q_panel_feature_scaler(spark, sf):
    return W.fit_feature_scaler(features(spark, sf, LOC), input_columns(), T_LEN, LOC)


def q_panel_metrics(spark, sf):
    p = model_preds(spark, sf, series=LOC).filter(F.col("split") == "test")
    return MT.compare_models(p, "y", "pred_seasonal", "pred_ar1", LOC)


def q_panel_ar1_fit(spark, sf):
    return FC.ar1_fit(split_windows(spark, sf, series=LOC), series_cols=LOC)


def q_panel_recursive_forecast(spark, sf):
    """Recursion with two lags and each location's own coefficients."""
    f = features(spark, sf, LOC)
    return FC.recursive_forecast(f, FC.ar_fit(split_windows(spark, sf, f, LOC), AR_LAGS, LOC), AR_LAGS, 24, series_cols=LOC)


ALL_LAGS = {k: f"{TARGET}_lag_{k}h" for k in TARGET_LAGS}


def panel_rows(spark, sf, feats):
    """Every location's windows with the feature vector before the target."""
    w = sequence_windows(feats, series_cols=LOC, with_x=False, keep=[LAG1], last=feature_columns())
    return materialize(W.chrono_split(w, LOC))


def q_panel_ar_lags(spark, sf):
    """M2: least squares over the eight target lags, one model a location."""
    w = sequence_windows(features(spark, sf, LOC), series_cols=LOC, with_x=False, keep=list(ALL_LAGS.values()))
    return FC.ar_fit(W.chrono_split(w, LOC), ALL_LAGS, LOC)


def q_panel_ar_lags_forecast(spark, sf):
    """M4 over the eight lags, each location with its own coefficients."""
    f = features(spark, sf, LOC)
    w = sequence_windows(f, series_cols=LOC, with_x=False, keep=list(ALL_LAGS.values()))
    return FC.recursive_forecast(f, FC.ar_fit(W.chrono_split(w, LOC), ALL_LAGS, LOC), ALL_LAGS, 24, series_cols=LOC)


#: The feature vector of the hour before a window's target.
X_COLUMNS = [f"x_{c}" for c in feature_columns()]


def q_panel_feature_forecast(spark, sf):
    """M4 over the whole feature vector: each location's linear model of all
    features, iterated for a day."""
    f = features(spark, sf, LOC)
    train = panel_rows(spark, sf, f).filter("split = 'train'")
    return RC.feature_forecast(f, materialize(LS.least_squares(train, X_COLUMNS, "y", LOC)), 24, series_cols=LOC)


def q_panel_linear_score(spark, sf):
    """M2/M3: each location's least squares over the feature vector, scored on
    all its windows."""
    rows = panel_rows(spark, sf, features(spark, sf, LOC))
    model = materialize(LS.least_squares(rows.filter("split = 'train'"), X_COLUMNS, "y", LOC))
    return LS.linear_score(rows, model, X_COLUMNS, LOC, "pred_linear").select("location", "ts", "split", "y", "pred_linear")


def q_column_checks(spark, sf):
    """What required columns the stored tables lack and what they have
    that the measurement view has not, with their rows; the view lacks none."""
    ensure_utc(spark)
    view = C.standardize(mview(spark, sf))
    tables = {"view": view, **{n: S.read_table(spark, sf, n) for n in ("events", "lineitem", "nation")}}
    out = []
    for name, t in tables.items():
        d = C.column_set_diff(t, view)
        out.append(t.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(",".join(sorted(C.validate_columns(t)))).alias("missing"), F.lit(d["match"]).alias("match"),
            F.lit(",".join(d["only_left"])).alias("only_here")))
    return reduce(DataFrame.unionByName, out)


def q_tree_forecast(spark, sf):
    """M2/M3: boosted trees on the feature vectors of all locations, beside
    each location's AR(1), on the test windows."""
    rows = panel_rows(spark, sf, features(spark, sf, LOC))
    model = BO.fit_boosted(rows.filter("split = 'train'"), X_COLUMNS)
    p = BO.boosted_score(rows, model, "pred_tree")
    p = FC.ar1_predict(p, FC.ar1_fit(rows, series_cols=LOC), series_cols=LOC)
    return MT.compare_models(p.filter("split = 'test'"), "y", "pred_ar1", "pred_tree", LOC)


def q_panel_backtest_runs(spark, sf):
    return runs(spark, sf, series=LOC)


QUERIES = {
    "scan_measurements": q_scan_measurements,
    "standardize": q_standardize,
    "retention_filter": q_retention_filter,
    "param_filter": q_param_filter,
    "bbox_filter": q_bbox_filter,
    "radius_filter": q_radius_filter,
    "country_filter": q_country_filter,
    "sensor_range_topn": q_sensor_range_topn,
    "pivot_mean": q_pivot_mean,
    "hourly_mean": q_hourly_mean,
    "hour_spine": q_hour_spine,
    "gap_fill": q_gap_fill,
    "feature_table": q_feature_table,
    "target_lags": _feat_subset([f"{TARGET}_lag_{k}h" for k in (1, 2, 3, 6, 12, 24, 48, 72)]),
    "cross_lags": _feat_subset([f"{p}_lag_{k}h" for p in ("pm10", "no2", "o3") for k in (24, 48, 72)]),
    "rolling_mean": _feat_subset([f"{TARGET}_rmean_{w}h" for w in (24, 48, 72)]),
    "rolling_std": _feat_subset([f"{TARGET}_rstd_{w}h" for w in (24, 48, 72)]),
    "cyclic_features": q_cyclic,
    "dropna_features": q_dropna_features,
    "sequence_windows": q_sequence_windows,
    "chrono_split": q_chrono_split,
    "split_summary": q_split_summary,
    "window_summary": q_window_summary,
    "latest_windows": q_latest_windows,
    "fit_feature_scaler": q_fit_feature_scaler,
    "fit_target_scaler": q_fit_target_scaler,
    "scale_features": q_scale_features,
    "inverse_transform": q_inverse_transform,
    "naive_forecast": q_naive_forecast,
    "persistence_rmse": q_persistence_rmse,
    "regression_metrics": q_regression_metrics,
    "compare_models": q_compare_models,
    "quality_alarm": q_quality_alarm,
    "forecast_eval": q_forecast_eval,
    "ar1_fit": q_ar1_fit,
    "ar1_predict": q_ar1_predict,
    "recursive_forecast": q_recursive_forecast,
    "forecast_grid": q_forecast_grid,
    "dedup_first": q_dedup_first,
    "duplicate_count": q_duplicate_count,
    "merge_shards": q_merge_shards,
    "shard_contribution": q_shard_contribution,
    "rolling_merge": q_rolling_merge,
    "ingest_new_only": q_ingest_new_only,
    "incremental_batch": q_incremental_batch,
    "span_profile": q_span_profile,
    "distinct_dims": q_distinct_dims,
    "availability": q_availability,
    "profile_compare": q_profile_compare,
    "describe_numeric": q_describe_numeric,
    "psi_edges": q_psi_edges,
    "psi_histogram": q_psi_histogram,
    "psi_by_feature": q_psi_by_feature,
    "psi_summary": q_psi_summary,
    "psi_lineitem": q_psi_lineitem,
    "head_sample": q_head_sample,
    "drift_report": q_drift_report,
    "drift_decision": q_drift_decision,
    "backtest_runs": q_backtest_runs,
    "champion_history": q_champion_history,
    "runs_upsert": q_runs_upsert,
    "runs_trend_rmse": q_runs_trend_rmse,
    "runs_trend_mae": q_runs_trend_mae,
    "runs_last10": q_runs_last10,
    "latest_rmse": q_latest_rmse,
    "latest_r2": q_latest_r2,
    "last_run": q_last_run,
    "run_history20": q_run_history20,
    "runs_total": q_runs_total,
    "runs_summary": q_runs_summary,
    "run_status_bands": q_run_status_bands,
    "daily_metrics": q_daily_metrics,
    "prediction_summary": q_prediction_summary,
    "shard_labels": q_shard_labels,
    "flatten_payloads": q_flatten_payloads,
}

QUERIES.update({
    "shard_roundtrip": q_shard_roundtrip,
    "runs_table_upsert": q_runs_table_upsert,
    "ingest_runs": q_ingest_runs,
    "merged_roundtrip": q_merged_roundtrip,
    "splits_roundtrip": q_splits_roundtrip,
    "predictions_roundtrip": q_predictions_roundtrip,
    "runs_export": q_runs_export,
    "drift_report_json": q_drift_report_json,
    "fetch_plan": q_fetch_plan,
    "align_predictions": q_align_predictions,
    "nested_payloads": q_nested_payloads,
    "drift_baseline": q_drift_baseline,
    "psi_edges_bracketed": q_psi_edges_bracketed,
    "describe_bracketed": q_describe_bracketed,
    "ar_fit": q_ar_fit,
    "recursive_forecast_general": q_recursive_forecast_general,
    "feature_table_panel": q_feature_table_panel,
    "panel_split_summary": q_panel_split_summary,
    "panel_feature_scaler": q_panel_feature_scaler,
    "panel_metrics": q_panel_metrics,
    "panel_ar1_fit": q_panel_ar1_fit,
    "panel_recursive_forecast": q_panel_recursive_forecast,
    "panel_backtest_runs": q_panel_backtest_runs,
    "panel_ar_lags": q_panel_ar_lags,
    "panel_ar_lags_forecast": q_panel_ar_lags_forecast,
    "panel_feature_forecast": q_panel_feature_forecast,
    "tree_forecast": q_tree_forecast,
    "panel_linear_score": q_panel_linear_score,
    "column_checks": q_column_checks,
    # fitted by pyspark.ml: no SQL, tested against NumPy
    "linear_forecast": q_linear_forecast,
    "batch_score": q_batch_score,
})


def registered() -> dict:
    """name -> callable(spark, sf_dir) returning the finalized DataFrame."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {k: wrap(v) for k, v in QUERIES.items()}
