"""Distribution drift with the population stability index.

Bin edges come from wide quantile passes (``quantiles``); for the counts both
periods are turned into a long (feature, x) table once, the edges (one 9-element
array per feature: a size fixed by the caller's column list) are broadcast, the
bin id is a higher-order function, and histograms are grouped counts.  No Python
runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.constants import PSI_BANDS, PSI_BINS, PSI_FLOOR, PSI_MIN_FEATURES, PSI_RETRAIN, PSI_SAMPLE_ROWS
from sensorspark.operators.clean import numeric_columns
from sensorspark.operators.quantiles import exact_quantiles, value_of
from sensorspark.session import path_exists


def to_long(df: DataFrame, columns, keep=()) -> DataFrame:
    """Unpivot numeric columns into (feature, x), dropping NULL/NaN values."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                             for c in columns])).alias("_kv")
    out = df.select(*keep, kv).select(*keep, "_kv.feature", "_kv.x")
    return out.filter(F.col("x").isNotNull() & ~F.isnan("x"))


def drift_columns(reference: DataFrame, current: DataFrame, columns=None) -> list[str]:
    """Features eligible for PSI: numeric in the reference (P8) and present in
    the current data (P11)."""
    cols = columns or numeric_columns(reference)
    ok = set(numeric_columns(reference))
    cur = set(current.columns)
    return [c for c in cols if c in ok and c in cur]


def quantile_points(bins: int = PSI_BINS) -> list[float]:
    """Interior percentile positions of ``bins`` equal-count bins."""
    return [i / bins for i in range(1, bins)]


def psi_edges(reference: DataFrame, columns, bins: int = PSI_BINS, exact: bool = True, **options) -> DataFrame:
    """(feature, edges, ref_n) of every column with a value: percentiles
    with linear interpolation (the outer edges are -inf/+inf), exact through
    ``quantiles.exact_quantiles`` (which takes ``options``) or, with
    ``exact=False``, in one approximate pass.  One row per column."""
    points = quantile_points(bins)
    if exact:
        found = exact_quantiles(reference, columns, points, **options)
    else:
        row = reference.agg(*[F.struct(F.count(value_of(c)), F.percentile_approx(value_of(c), F.array(*[F.lit(q) for q in points]), F.lit(10_000))).alias(f"s{i}")
                              for i, c in enumerate(columns)]).first()
        found = {c: tuple(row[f"s{i}"]) for i, c in enumerate(columns)}
    rows = [(c, q, n) for c, (n, q) in found.items() if n]
    return reference.sparkSession.createDataFrame(rows, "feature string, edges array<double>, ref_n long")


def bin_id(x: Column, edges: Column) -> Column:
    """A18 bin: number of interior edges e with x >= e.  With duplicate edges
    this equals numpy.histogram (empty bins between equal edges, the right-
    most of equal edges wins)."""
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + (x >= e).cast("int"))


def period_counts(df: DataFrame, is_ref: Column, is_cur: Column, columns, bins: int = PSI_BINS, exact: bool = True, **options) -> DataFrame:
    """(feature, edges, ref_n, cur_n, ref, cur): the counts of both periods of
    ONE table per bin, as arrays.  ``is_ref``/``is_cur`` tag the rows.

    Edges come from the reference rows; then one scan bins both periods in
    one grouped count (each row goes to the side or sides it belongs to).
    """
    cols = list(columns)
    tagged = df.select(is_ref.alias("_ref"), is_cur.alias("_cur"), *cols).filter("_ref OR _cur")
    edges = psi_edges(tagged.filter("_ref"), cols, bins, exact, **options)
    e = F.broadcast(edges.select("feature", "edges"))            # one row per feature
    b = to_long(tagged, cols, ["_ref", "_cur"]).join(e, "feature").withColumn("_bin", bin_id(F.col("x"), F.col("edges")))
    count = lambda side, i: F.count(F.when(F.col(side) & (F.col("_bin") == i), 1))
    g = b.groupBy("feature").agg(F.first("edges").alias("edges"), F.array(*[count("_ref", i) for i in range(bins)]).alias("ref"),
                                 F.array(*[count("_cur", i) for i in range(bins)]).alias("cur"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return g.select("feature", "edges", total("ref").alias("ref_n"), total("cur").alias("cur_n"), "ref", "cur")


def _share(c: Column, n: Column) -> Column:
    return F.greatest(c / n, F.lit(PSI_FLOOR))


def psi_histogram(counts: DataFrame) -> DataFrame:
    """Per (feature, bin) count and share of both periods, floored at 1e-10."""
    x = counts.select("feature", "ref_n", "cur_n", F.posexplode(F.arrays_zip("ref", "cur")).alias("bin", "c"))
    return x.select("feature", "bin", F.col("c.ref").alias("ref_count"), _share(F.col("c.ref"), F.col("ref_n")).alias("ref"),
                    F.col("c.cur").alias("cur_count"), _share(F.col("c.cur"), F.col("cur_n")).alias("cur"))


def psi_of(counts: DataFrame) -> DataFrame:
    """PSI = sum over bins of (c - r) * ln(c / r) per feature; features
    empty on either side are skipped."""
    term = lambda z: (_share(z["cur"], F.col("cur_n")) - _share(z["ref"], F.col("ref_n"))) * F.log(
        _share(z["cur"], F.col("cur_n")) / _share(z["ref"], F.col("ref_n")))
    return counts.filter("ref_n > 0 AND cur_n > 0").select(
        "feature", F.aggregate(F.arrays_zip("ref", "cur"), F.lit(0.0), lambda a, z: a + term(z)).alias("psi"))


def psi_by_feature(reference: DataFrame, current: DataFrame, columns=None, bins: int = PSI_BINS,
                   exact: bool = True) -> DataFrame:
    """A19 for two tables: features absent on either side, non-numeric, or
    empty on either side are skipped.  (Two periods of one table:
    ``period_counts``, which scans it once less.)"""
    cols = drift_columns(reference, current, columns)
    if not cols:
        return reference.sparkSession.createDataFrame([], "feature string, psi double")
    both = reference.select(*cols, F.lit(True).alias("_is_ref")).unionByName(current.select(*cols, F.lit(False).alias("_is_ref")))
    return psi_of(period_counts(both, F.col("_is_ref"), ~F.col("_is_ref"), cols, bins, exact))


def psi_summary(psi: DataFrame, min_features: int = PSI_MIN_FEATURES) -> DataFrame:
    """Mean PSI over features, feature count, band and recommendation
    (retrain above 0.15).  With fewer than ``min_features`` features drift
    can't be judged: score 0, skip, and ``judged`` says so."""
    s = psi.agg(F.avg("psi").alias("_mean"), F.count(F.lit(1)).cast("bigint").alias("features_analyzed"))
    judged = F.col("features_analyzed") >= F.lit(int(min_features))
    s = s.select(F.when(judged, F.coalesce("_mean", F.lit(0.0))).otherwise(F.lit(0.0)).alias("psi_score"), "features_analyzed", judged.alias("judged"))
    return s.withColumn("band", psi_band(F.col("psi_score"))) \
            .withColumn("recommendation", F.when(F.col("psi_score") > PSI_RETRAIN, "retrain").otherwise("skip"))


def save_baseline(reference: DataFrame, path: str, columns=None, bins: int = PSI_BINS) -> None:
    """The reference of later drift checks as a small table: per feature its
    edges, bin counts and profile (A3)."""
    cols = columns or numeric_columns(reference)
    c = period_counts(reference, F.lit(True), F.lit(True), cols, bins).select("feature", "edges", "ref_n", "ref")
    c.join(describe_numeric(reference, cols), "feature").write.mode("overwrite").parquet(path)


def drift_against_baseline(current: DataFrame, path: str, columns=None, min_features: int = PSI_MIN_FEATURES) -> DataFrame:
    """Drift of ``current`` against the saved baseline, one row as
    ``psi_summary`` with ``first_run``.  Where no baseline is stored yet, it is
    made from ``current`` and the answer is to retrain (score 1)."""
    spark = current.sparkSession
    if not path_exists(spark, path):
        save_baseline(current, path, columns)
        n = len(columns or numeric_columns(current))
        return spark.range(1).select(F.lit(1.0).alias("psi_score"), F.lit(n).cast("bigint").alias("features_analyzed"), F.lit(True).alias("judged"),
                                     F.lit("significant").alias("band"), F.lit("retrain").alias("recommendation"), F.lit(True).alias("first_run"))
    base = spark.read.parquet(path)
    names = [r.feature for r in base.select("feature").collect()]        # one row per feature
    cols = [c for c in numeric_columns(current) if c in names]
    bins = len(base.select("ref").first().ref) if names else PSI_BINS
    if not cols:
        psi = spark.createDataFrame([], "feature string, psi double")
    else:
        b = to_long(current, cols).join(F.broadcast(base.select("feature", "edges")), "feature").withColumn("_bin", bin_id(F.col("x"), F.col("edges")))
        cur = b.groupBy("feature").agg(F.count(F.lit(1)).alias("cur_n"), F.array(*[F.count(F.when(F.col("_bin") == i, 1)) for i in range(bins)]).alias("cur"))
        psi = psi_of(base.select("feature", "ref_n", "ref").join(cur, "feature"))
    return psi_summary(psi, min_features).withColumn("first_run", F.lit(False))


def psi_band(psi: Column) -> Column:
    """F6 bands: < 0.1 none, 0.1-0.25 moderate, > 0.25 significant."""
    lo, hi = PSI_BANDS
    return F.when(psi < lo, "none").when(psi <= hi, "moderate").otherwise("significant")


def retrain_decision(psi: Column, force: Column, has_champion: Column) -> Column:
    """retrain when PSI > 0.15, or forced, or no champion exists yet."""
    return (psi > F.lit(PSI_RETRAIN)) | force | ~has_champion


def head_sample(df: DataFrame, order_cols, n: int = PSI_SAMPLE_ROWS) -> DataFrame:
    """L4: the first ``n`` rows in a deterministic order (top-k, no global sort)."""
    return df.orderBy(*order_cols).limit(int(n))


def describe_numeric(df: DataFrame, columns=None, exact: bool = True, **options) -> DataFrame:
    """A3: count, mean, std (ddof 1), min, 25/50/75 % and max per numeric
    column, one row per column (long form of ``describe``); a column without
    values has no row.  Wide aggregates: one pass beside the quantiles'."""
    cols = columns or numeric_columns(df)
    points = (0.25, 0.5, 0.75)
    x = {c: value_of(c) for c in cols}
    aggs = [F.struct(F.count(x[c]), F.avg(x[c]), F.stddev_samp(x[c]), F.min(x[c]), F.max(x[c]),
                     *([] if exact else [F.percentile_approx(x[c], F.array(*[F.lit(p) for p in points]), F.lit(10_000))])).alias(f"s{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    found = exact_quantiles(df, cols, points, **options) if exact else {c: (row[f"s{i}"][0], row[f"s{i}"][5]) for i, c in enumerate(cols)}
    rows = [(c, *row[f"s{i}"][:4], *found[c][1], row[f"s{i}"][4]) for i, c in enumerate(cols) if row[f"s{i}"][0]]
    return df.sparkSession.createDataFrame(rows, "feature string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
