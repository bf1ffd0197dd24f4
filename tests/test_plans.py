"""Plan hygiene: pruned scans, pushed filters, map-side dedup, no
row-level window without a partition key."""

import re

from sensorspark.operators import clean as C
from sensorspark.operators import ingest as I
from sensorspark.operators.features import feature_table
from sensorspark.operators.resample import hourly_wide
from sensorspark.sources import measurements as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")      # else long filter lists are cut
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filter_pushed(spark, tmp_path):
    # a measurement table as landed: datetime is a stored column
    src = str(tmp_path / "m")
    C.standardize(S.events_measurements(spark, SF, with_ids=False)).write.parquet(src)
    m = S.scan_measurements(spark, src)
    p = _plan(C.retention_filter(m, "2024-01-31", 14).select("datetime", "value"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "unit" not in schema and "location" not in schema
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", p).group(1)
    assert "GreaterThanOrEqual(datetime" in pushed


def test_dedup_combines_map_side(spark):
    m = C.param_filter(S.events_measurements(spark, SF))
    p = _plan(I.dedup_first(m, order=("arrival",)))
    assert "partial_min_by" in p
    # partial aggregate sits below the shuffle
    assert p.index("Exchange hashpartitioning") < p.rindex("partial_min_by")


def test_row_windows_are_blocked(spark):
    m = I.dedup_first(C.param_filter(S.events_measurements(spark, SF)), order=("arrival",))
    p = _plan(feature_table(hourly_wide(m, ["pm25", "pm10", "no2", "o3"])))
    windows = [ln for ln in p.splitlines() if re.search(r"\bWindow \[", ln)]
    assert windows
    for ln in windows:
        # row windows are partitioned by (series, block); the only other one
        # orders the one-row-per-block summary by block
        assert "_blk" in ln, ln


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 648
    assert "pm25_lag_72h" in df.columns


def _registered(name):
    from sensorspark.plans import catalog
    return catalog.registered()[name]


def test_time_bound_reaches_the_scan_of_registered_queries(spark):
    for name in ("retention_filter", "rolling_merge", "sensor_range_topn", "incremental_batch"):
        pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", _plan(_registered(name)(spark, SF)))
        assert pushed and all("GreaterThanOrEqual(ts" in p for p in pushed), (name, pushed)
    for name in ("param_filter", "hourly_mean", "dedup_first"):
        pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", _plan(_registered(name)(spark, SF)))
        assert pushed and all("In(event_type" in p for p in pushed), (name, pushed)


def test_clean_dedup_hashes(spark):
    p = _plan(_registered("hourly_mean")(spark, SF))
    assert "partial_min_by" in p and "SortAggregate" not in p


def test_drift_reads_each_side_once(spark):
    from sensorspark.plans import catalog
    p = _plan(catalog.lineitem_counts(spark, SF))
    # one scan for the edges, one for the counts of both periods
    assert len(re.findall(r"FileScan parquet", p)) <= 2


def test_scaler_and_metrics_do_not_move_rows_by_few_keys(spark):
    for name, key in (("fit_feature_scaler", "feature"), ("regression_metrics", "model")):
        p = _plan(_registered(name)(spark, SF))
        joins = [ln for ln in p.splitlines() if re.search(r"(SortMergeJoin|ShuffledHashJoin) \[" + key + r"#", ln)]
        assert not joins, (name, joins)
