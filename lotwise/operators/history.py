"""Observations over time: changes, carry-forward, runs, per-key folds."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _w(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def value_changes(obs: DataFrame, key: str, at: str, tie: str, value: str, least: float = 1.0) -> DataFrame:
    """WN01, T4: each known value that differs by at least ``least`` from the key's previous known value. Late rows are put in order of time; repeated deliveries don't change anything."""
    known = obs.where(F.col(value).isNotNull())
    rows = known.withColumn("old_value", F.lag(value).over(_w(key, at, tie)))
    delta = F.col(value) - F.col("old_value")
    return rows.where(F.abs(delta) >= least).select(key, tie, F.col("old_value"), F.col(value).alias("new_value"), F.round(delta, 2).alias("delta"))


def carry_forward(obs: DataFrame, key: str, at: str, tie: str, values: list[str]) -> DataFrame:
    """WN02: the last known value of each column up to and including each row."""
    w = _w(key, at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return obs.select(key, tie, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def transitions(obs: DataFrame, key: str, at: str, tie: str, state: str) -> DataFrame:
    """WN04, T5: rows at which a known state differs from the key's previous known one; the first one has no old state."""
    rows = obs.where(F.col(state).isNotNull()).withColumn("old_state", F.lag(state).over(_w(key, at, tie)))
    return rows.where(~F.col("old_state").eqNullSafe(F.col(state))).select(key, tie, "old_state", F.col(state).alias("new_state"))


def run_lengths(log: DataFrame, key: str, at: str, tie: str, failed: Column) -> DataFrame:
    """WN03, WN06: consecutive failures up to each row, reset by a success (gaps and islands)."""
    w = _w(key, at, tie)
    rows = log.withColumn("__f", F.coalesce(failed.cast("int"), F.lit(0))).withColumn("__island", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "__island").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, tie, F.sum("__f").over(inside).alias("failures"))


def seen_span(obs: DataFrame, key: str, at: str) -> DataFrame:
    """WN07: first and last time and the number of observations of each key."""
    return obs.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def latest(obs: DataFrame, key: str, at: str, tie: str, values: list[str]) -> DataFrame:
    """Current state: the newest row of each key, by one maximum of a struct instead of a sort."""
    best = F.max(F.struct(at, tie, *values)).alias("b")
    return obs.groupBy(key).agg(best).select(key, F.col(f"b.{at}").alias(at), *[F.col(f"b.{v}").alias(v) for v in values])


def smoothed(log: DataFrame, key: str, at: str, tie: str, value: str, keep: float = 0.7, digits: int = 3, start: float = 0.0) -> DataFrame:
    """WN05, SC09: exponential average per key, rounded half to even at each step (0 digits: the typical result count), and the number of values; keys without a known value give no row.

    Rounding at each step makes the fold sequential: no window or tree of partial
    sums gives the same. Spark sorts the rows of each partition (on disk where they
    are many), and they pass in Arrow batches with one number of state, so that no
    key's rows are ever gathered. A key is folded in one task; it is the only work
    that a hot key makes.
    """
    rows = log.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(tie).alias("i"), F.col(value).cast("double").alias("v"))
    placed = rows.repartition("k").sortWithinPartitions("k", "t", "i").select("k", "v")
    scale = Decimal(1).scaleb(-digits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, average, n = None, start, 0
        for batch in batches:
            done: list[tuple] = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and k != now:
                    done.append((now, average, n))
                    average, n = start, 0
                now, n = k, n + 1
                # six decimals first, as the arithmetic of binary fractions isn't exact
                average = float(Decimal(f"{average * keep + v * (1 - keep):.6f}").quantize(scale, ROUND_HALF_EVEN))
            yield _packed(done, batch.schema.field(0).type)
        yield _packed([(now, average, n)] if n else [], batch.schema.field(0).type if n else None)

    def _packed(done: list[tuple], kind: pa.DataType | None) -> pa.RecordBatch:
        ks, vs, ns = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(ks, kind or arrow_kind), pa.array(vs, pa.float64()), pa.array(ns, pa.int64())], names=[key, "average", "n"])

    arrow_kind = to_arrow_type(rows.schema["k"].dataType)
    return placed.mapInArrow(run, T.StructType([T.StructField(key, rows.schema["k"].dataType), T.StructField("average", T.DoubleType()), T.StructField("n", T.LongType())]))


def monthly_counts(log: DataFrame, at: str, key: str, good: Column) -> DataFrame:
    """AG12, SS06: counted rows per month and key."""
    return log.where(good).groupBy(F.date_trunc("month", at).cast("timestamp_ntz").alias("month"), key).agg(F.count(F.lit(1)).alias("n"))
