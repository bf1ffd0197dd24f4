"""sensorspark: Spark-native sensor time-series operators.

Long measurement tables (time, parameter, value, location) are deduplicated,
resampled to an hourly grid, gap filled, turned into lag/rolling/cyclic
features, cut into sliding windows, split and scaled chronologically, scored
with simple forecasters and evaluated, all as DataFrame plans that Catalyst
optimises.  Every operator takes ``series_cols``: ``()`` is the pooled city
series, ``("location",)`` the per-location panel.
"""

from sensorspark.session import get_session, ensure_utc, checkpoint_dir

__all__ = ["get_session", "ensure_utc", "checkpoint_dir"]
