"""Keyed state over streams of observations and scans (SS02 .. SS06).

Each function groups by key and keeps a few numbers a key; within a batch rows are
put in order of time by one sort, then folded. State ends where it can: listings
that have expired, sources and queries that were silent for ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3_600_000


def _rows(batches: Iterator[pd.DataFrame], at: str) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(at, kind="stable") if parts else pd.DataFrame()


def listing_states(stream: DataFrame, late: str = "2 days", hours: int = 20, limit: int = 3) -> DataFrame:
    """SS02, SS03: (internal_id, at, status, misses, price): a row whenever a listing of ``stream`` (internal_id, seen_at, price_eur) changes its status or price.

    Seen, it is ACTIVE without misses; each ``hours`` of event time without an
    observation are a miss: MAYBE_ACTIVE after the first, EXPIRED after ``limit``,
    with which its state ends. Late rows within the watermark don't bring back time.
    """
    schema = "internal_id string, at timestamp, status string, misses int, price double"
    stamp = lambda ms: pd.Timestamp(ms, unit="ms")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, price, missed = state.get if state.exists else (0, float("nan"), -1)
        out: list[tuple] = []
        if state.hasTimedOut:
            # the watermark may have passed several misses at once
            while missed < limit and last + (missed + 1) * hours * HOUR <= state.getCurrentWatermarkMs():
                missed += 1
                if missed == 1 or missed >= limit:
                    out.append((key[0], stamp(last + missed * hours * HOUR), "MAYBE_ACTIVE" if missed < limit else "EXPIRED", missed, price))
            if missed >= limit:
                state.remove()
                yield pd.DataFrame(out, columns=["internal_id", "at", "status", "misses", "price"])
                return
        else:
            rows = _rows(batches, "seen_at")
            for t, p in zip(rows["seen_at"], rows["price_eur"], strict=True):
                changed = p == p and (price != price or abs(p - price) >= 1)
                price = p if p == p else price
                if missed != 0 or changed:
                    out.append((key[0], t, "ACTIVE", 0, price))
                missed = 0
                last = max(last, int(t.timestamp() * 1000))
        state.update((last, price, missed))
        state.setTimeoutTimestamp(max(last + (missed + 1) * hours * HOUR, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["internal_id", "at", "status", "misses", "price"])

    rows = stream.withWatermark("seen_at", late).select("internal_id", "seen_at", "price_eur")
    return rows.groupBy("internal_id").applyInPandasWithState(step, schema, "last long, price double, missed int", "append", GroupStateTimeout.EventTimeTimeout)


def _folds(stream: DataFrame, key: str, at: str, columns: list[str], start: tuple, fold, out: str, state: str, keep: str, late: str) -> DataFrame:
    """One row a key and batch with the folded state after it; a key's state ends after ``keep`` without rows."""
    kept_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        if s.hasTimedOut:
            s.remove()
            return
        now = s.get if s.exists else start
        rows = _rows(batches, at)
        for row in rows[columns].itertuples(index=False, name=None):
            now = fold(now, row)
        s.update(now)
        newest = int(rows[at].max().timestamp() * 1000)
        s.setTimeoutTimestamp(max(newest, s.getCurrentWatermarkMs()) + kept_ms)
        yield pd.DataFrame([(k[0], rows[at].max(), *now)], columns=[c.split()[0] for c in out.split(", ")])

    return stream.withWatermark(at, late).select(key, at, *columns).groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def source_states(stream: DataFrame, keep: str = "90 days", late: str = "2 days") -> DataFrame:
    """SS04: (source, at, typical, failures, health) after each batch of scans (source, scanned_at, n_found, failed): typical result count 0.7 and 0.3, whole numbers each step; failures in a row; healthy, failed, or unknown while nothing was found."""

    def fold(s: tuple, row: tuple) -> tuple:
        typical, failures, health = s
        n, failed = row
        if failed:
            return typical, failures + 1, "failed"
        return int(np.rint(round(0.7 * typical + 0.3 * n, 6))), 0, "healthy" if n > 0 else ("unknown" if health == "failed" else health)

    return _folds(stream, "source", "scanned_at", ["n_found", "failed"], (0, 0, "unknown"), fold, "source string, at timestamp, typical int, failures int, health string", "typical int, failures int, health string", keep, late)


def query_states(stream: DataFrame, keep: str = "365 days", late: str = "2 days") -> DataFrame:
    """SS05: (query, at, runs, found, effectiveness) after each batch of runs (query, run_at, new_domains): runs, new domains in all, effectiveness 0.7 and 0.3 with three decimals each step."""

    def fold(s: tuple, row: tuple) -> tuple:
        runs, found, e = s
        n = int(row[0])
        return runs + 1, found + n, float(np.round(round(0.7 * e + 0.3 * n, 6), 3))

    return _folds(stream, "query", "run_at", ["new_domains"], (0, 0, 0.0), fold, "query string, at timestamp, runs int, found int, effectiveness double", "runs int, found int, effectiveness double", keep, late)


def monthly_usage(stream: DataFrame) -> DataFrame:
    """SS06: (month, provider, used): successful requests a calendar month, updated as they come (output mode update or complete). Windows have a fixed length, months don't, hence the group by truncated month; what has passed its month is one row that no longer changes."""
    return stream.where("ok").groupBy(F.date_trunc("month", "created_at").alias("month"), "provider").agg(F.count(F.lit(1)).alias("used"))


def run_available(out: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """SS01: one recurring run: everything that has arrived since the last one, then stop; a scheduler calls it as often as it likes."""
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
