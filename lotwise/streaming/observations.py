"""Observations as a stream: repeated deliveries, windows, per-key state (SS02 .. SS07)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def without_repeats(stream: DataFrame, at: str, keys: list[str], late: str = "30 days") -> DataFrame:
    """Each observation once, however often it is delivered; state is kept as long as ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, at: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Observations per window and key; a window is final when the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def value_changes(stream: DataFrame, key: str, at: str, value: str, least: float = 1.0, late: str = "30 days", keep: str = "365 days") -> DataFrame:
    """(key, at, old_value, new_value) whenever a known value differs from the last known one of its key, in order of arrival and, within a batch, of time. State per key: one number, forgotten when the watermark is ``keep`` past the key's last row."""
    kept_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    schema = f"{key} long, {at} timestamp, old_value double, new_value double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).dropna(subset=[value]).sort_values(at, kind="stable")
        if not rows.empty:
            before = rows[value].shift(fill_value=float("nan") if last is None else last)
            moved = (rows[value] - before).abs() >= least
            state.update((float(rows[value].iloc[-1]),))
            state.setTimeoutTimestamp(max(int(rows[at].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + kept_ms)
            out = pd.DataFrame({key: k[0], at: rows[at], "old_value": before, "new_value": rows[value]})
            yield out[moved]

    return stream.withWatermark(at, late).select(key, at, value).groupBy(key).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)
