"""Rolling statistics over gaps as a stream (T5: W7/W8, then W3/W4).

The state of a series holds, for each parameter, the last filled hours (as many
as the longest window looks back), the last observed hour among them, and the
hours that are still pending: they may change, or end a gap later.  A batch of
changed hours is put into the pending ones; every hour up to the parameter's
newest observed one (its look-ahead is known) is filled in closed form and
stated with its windows; then all hours up to the last observed one that is
older than the delay are final and leave the state.  Empty hours cost nothing, so the state of a series is bounded
by its longest window and the hours that the delay spans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorspark.constants import FFILL_LIMIT, INTERP_LIMIT, ROLLING_WINDOWS
from sensorspark.operators.blocks import hour_pos
from sensorspark.streaming.versions import EPOCH


def filled(first: int, obs_pos: np.ndarray, obs_val: np.ndarray) -> np.ndarray:
    """W7/W8 from hour ``first`` to the last observed one (hours before the
    first observed take its value)."""
    pos = np.arange(first, obs_pos[-1] + 1)
    nxt = np.searchsorted(obs_pos, pos)
    prev = np.maximum(nxt - 1, 0)
    k = pos - obs_pos[prev]
    step = np.minimum(k, INTERP_LIMIT) / np.maximum(obs_pos[nxt] - obs_pos[prev], 1)
    line = obs_val[prev] + (obs_val[nxt] - obs_val[prev]) * step
    near = (obs_pos[nxt] > pos) & (k > 0) & (k <= INTERP_LIMIT + FFILL_LIMIT)
    return np.where(near, line, obs_val[nxt])


def frames(values: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, sample std (0 for one value) and count of each value and the
    ``length - 1`` before it; ``before`` are the values that precede them."""
    pad = np.full(max(0, length - 1 - len(before)), np.nan)
    x = np.concatenate([pad, before[len(before) - min(len(before), length - 1):], values])
    if not len(values):
        return np.empty(0), np.empty(0), np.empty(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(x, length)
    n = np.count_nonzero(~np.isnan(w), axis=1)
    mean = np.nansum(w, axis=1) / n
    sq = np.nansum((w - mean[:, None]) ** 2, axis=1)
    return mean, np.where(n > 1, np.sqrt(sq / np.maximum(n - 1, 1)), 0.0), n


def advance(state: dict, changes, lengths, delay_hours: int):
    """Apply ``changes`` (pos, parameter, value or None) of one series.  Returns
    (parameter, first pos, filled values, values before them, retracted hours)
    of every parameter; ``state`` moves on.  Hours are retracted where the
    newest observed one, stated before, has lost its value."""
    final = state.get("final")
    for pos, p, v in changes:
        if final is not None and pos <= final:
            continue                                     # later than the delay
        s = state.setdefault("of", {}).setdefault(p, {"pending": {}, "tail": [], "last": None, "done": None, "stated": None})
        if v is None:
            s["pending"].pop(str(pos), None)
        else:
            s["pending"][str(pos)] = v
    known = [int(i) for s in state.get("of", {}).values() for i in s["pending"]]
    if known:
        state["newest"] = max(max(known), state.get("newest", max(known)))
        if final is None:
            state["start"] = min(known)
    out = []
    if "start" not in state:
        return out
    bound = state["newest"] - delay_hours
    keep = max(lengths) - 1
    for p, s in sorted(state["of"].items()):
        obs = sorted((int(i), v) for i, v in s["pending"].items())
        first = state["start"] if s["done"] is None else s["done"] + 1
        upto = obs[-1][0] if obs else first - 1
        gone = list(range(upto + 1, (s["stated"] if s["stated"] is not None else upto) + 1))
        s["stated"] = upto
        tail = np.array(s["tail"], float)
        if not obs:
            if gone:
                out.append((p, first, np.empty(0), tail, gone))
            continue
        if s["last"]:
            obs.insert(0, tuple(s["last"]))
        pos, val = np.array([i for i, _ in obs], np.int64), np.array([v for _, v in obs], float)
        v = filled(first, pos, val)
        out.append((p, first, v, tail, gone))
        upto = max((i for i, _ in obs if i <= bound), default=first - 1)       # what fills the hours before it is final, too
        if upto >= first:
            s["tail"] = np.concatenate([tail, v[:upto + 1 - first]])[-keep:].tolist() if keep else []
            s["done"] = upto
            s["last"] = [upto, dict(obs)[upto]]
            s["pending"] = {i: x for i, x in s["pending"].items() if int(i) > upto}
    if bound >= state["start"]:
        state["final"] = max(bound, state.get("final") or bound)
    return out


def rolling_stream(changes: DataFrame, lengths=ROLLING_WINDOWS, delay_hours: int = 3, series_cols=()) -> DataFrame:
    """Rolling mean, std and n of every hour of every parameter whose look-ahead
    is known, from a stream of hourly rows (series, hour, parameter, value) and
    their ``epoch``; in update mode an hour is stated again when it changes."""
    series = list(series_cols)
    key = [F.col(c) for c in series] or [F.lit(0).alias("_one")]
    out = T.StructType([*[T.StructField(c, T.StringType()) for c in series], T.StructField("hour", T.TimestampType()), T.StructField("parameter", T.StringType()),
                        T.StructField("length", T.IntegerType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
                        T.StructField("n", T.LongType())])

    def fn(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(EPOCH)
        changes = [(int(i), p, None if pd.isna(v) else float(v)) for i, p, v in zip(rows["pos"], rows["parameter"], rows["value"])]
        for p, first, v, tail, gone in advance(now, changes, lengths, delay_hours):
            hour = pd.to_datetime(np.concatenate([np.arange(first, first + len(v)), np.array(gone, np.int64)]) * 3600, unit="s")
            for n in lengths:
                mean, std, count = (np.concatenate([x, np.full(len(gone), fill)]) for x, fill in zip(frames(v, tail, n), (np.nan, np.nan, 0)))
                yield pd.DataFrame({**{c: g for c, g in zip(series, group)}, "hour": hour, "parameter": p, "length": np.int32(n), "mean": mean, "std": std, "n": count.astype(np.int64)})
        state.update((json.dumps(now),))

    d = changes.select(*key, hour_pos(F.col("hour")).alias("pos"), "parameter", "value", EPOCH)
    return d.groupBy(*(series or ["_one"])).applyInPandasWithState(fn, out, "state string", "update", GroupStateTimeout.NoTimeout)
