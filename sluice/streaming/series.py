"""Run lengths and lagged correlation of a stream of readings: what the batch windows give, one reading at a time, from bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "factory_id string, parameter_id string, timestamp timestamp, value double, duplicate_run_length double, autocorrelation double"
#: last value and whether it is there, run length, last time, and the values that the lagged frame still needs
STATE = "run double, last double, at timestamp, values array<double>"


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Of complete pairs only; None unless all are complete and both vary."""
    if np.isnan(x).any() or np.isnan(y).any():
        return None
    x, y = x - x.mean(), y - y.mean()
    scale = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
    return float((x * y).sum() / scale) if scale > 0 else None


def _advance(state: tuple, times: list, values: list[float], lag: int) -> tuple[tuple, list[tuple]]:
    """The state after these readings (in order; those not after the last one are left out) and (time, value, run, autocorrelation) of each."""
    run, last, at, held = state
    out = []
    for t, v in zip(times, values):
        if at is not None and t <= at:
            continue
        run = run + 1 if last is not None and v == last else 1.0  # NaN, a missing value, equals nothing
        last, at = (None if np.isnan(v) else v), t
        held = [*held, v][-2 * lag :]
        frame = np.array(held)
        # a frame of `lag` readings and the `lag` readings before each of them
        r = _correlation(frame[lag:], frame[:lag]) if len(frame) == 2 * lag else None
        out.append((t, None if np.isnan(v) else v, run, r))
    return (run, last, at, held), out


def run_and_lag(readings: DataFrame, lag: int = 96, idle: str | None = None) -> DataFrame:
    """`OUT` of each reading of a stream (factory_id, parameter_id, timestamp, value), in append mode.

    duplicate_run_length and autocorrelation are those of ``windows.run_length`` and ``windows.autocorrelation`` with ``lag`` rows.  State is one row for
    each series: 2 x ``lag`` values, the last time and the run.  Readings of one trigger are put in order of time first; one that comes
    with, or after, a later reading of its series is left out, as its place is gone.  Nulls and NaN are missing values.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        run, last, at, held = state.get if state.exists else (0.0, None, None, [])
        at = None if at is None else pd.Timestamp(at)
        known, out = _advance((run, last, at, [np.nan if v is None else v for v in held]), list(pdf["timestamp"]), pdf["value"].astype(float).tolist(), lag)
        run, last, at, held = known
        state.update((run, last, None if at is None else at.to_pydatetime(), [None if np.isnan(v) else float(v) for v in held]))
        yield pd.DataFrame([(*key, *o) for o in out], columns=["factory_id", "parameter_id", "timestamp", "value", "duplicate_run_length", "autocorrelation"]).astype({"value": "Float64", "autocorrelation": "Float64"})

    return readings.select("factory_id", "parameter_id", "timestamp", "value").groupBy("factory_id", "parameter_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
