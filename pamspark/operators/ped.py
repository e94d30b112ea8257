"""Piecewise-exponential data: one row per subject and interval at risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import require_columns

CAUSES = {"ped_status_1": "delta_1", "ped_status_2": "delta_2"}
FOLLOW_UP = 60


def interval_label(tstart, tend) -> Column:
    """``(4,5]``"""
    return F.concat(F.lit("("), tstart.cast("string"), F.lit(","), tend.cast("string"), F.lit("]"))


def as_ped(df: DataFrame, time: str = "event_time", status: Mapping[str, str] = CAUSES,
           cuts: Sequence[int] = range(FOLLOW_UP + 1), from_day: int | None = None,
           keep: Sequence[str] = ("CombinedID",)) -> DataFrame:
    """Explode subjects into intervals ``(tstart, tend]`` with ``tstart < time``.

    Every status column is set on the interval that holds the event; both causes share one explode.
    Delayed entry (``from_day``) and the last cut bound the generated sequence itself, because a
    filter on a generated column cannot be pushed below the generator.
    """
    require_columns(df, [time, *status.values(), *keep], "cohort")
    cuts = [int(c) for c in cuts]
    t = F.col(time)
    unit = cuts == list(range(cuts[0], cuts[0] + len(cuts)))
    first = 1
    if from_day is not None:
        first = next((i for i, c in enumerate(cuts) if i > 0 and c >= from_day), len(cuts))
    if unit:
        last = F.least(F.ceil(t).cast("int") - cuts[0], F.lit(len(cuts) - 1))
        start, end = F.col("_i") - 1 + cuts[0], F.col("_i") + cuts[0]
    else:
        table = F.array(*[F.lit(c) for c in cuts])
        last = F.least(F.size(F.filter(table, lambda c: c < t)), F.lit(len(cuts) - 1))
        start, end = F.element_at(table, F.col("_i")), F.element_at(table, F.col("_i") + 1)
    rows = df.where(t > (cuts[first - 1] if first < len(cuts) else cuts[-1])).select(
        *keep, t.alias("_time"), *[F.col(c).alias(f"_{s}") for s, c in status.items()],
        F.explode(F.sequence(F.lit(first), last)).alias("_i"))
    rows = rows.withColumns({"tstart": start.cast("int"), "tend": end.cast("int")})
    in_interval = F.col("_time") <= F.col("tend")
    return rows.select(
        *keep, "tstart", "tend", interval_label(F.col("tstart"), F.col("tend")).alias("interval_label"),
        *[F.when(in_interval, F.col(f"_{s}")).otherwise(0).cast("int").alias(s) for s in status],
        F.log(F.least(F.col("_time"), F.col("tend")) - F.col("tstart")).alias("offset"),
        (0.5 * (F.col("tstart") + F.col("tend"))).alias("int_mid"))


def last_intervals(df: DataFrame, time: str = "event_time", status: Mapping[str, str] = CAUSES,
                   horizon: int = FOLLOW_UP, from_day: int = 5,
                   keep: Sequence[str] = ("CombinedID",)) -> DataFrame:
    """The last row of every subject, read off the event time without generating the others."""
    t = F.col(time)
    return df.where(t > from_day - 1).select(
        *keep, F.least(F.ceil(t).cast("int"), F.lit(horizon)).alias("tend"),
        *[F.when(t <= horizon, F.col(c)).otherwise(0).cast("int").alias(s) for s, c in status.items()])


def person_time(ped: DataFrame) -> DataFrame:
    """Rows, subjects' person-time and events of each cause."""
    events = [c for c in ped.columns if c.startswith("ped_status")]
    return ped.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.exp("offset")).alias("person_time"),
                   *[F.sum(c).alias(c) for c in events])


def compress(ped: DataFrame, design: Sequence[str]) -> DataFrame:
    """Sum events and person-time over identical design rows; exact for a Poisson model with log offset."""
    events = [c for c in ped.columns if c.startswith("ped_status")]
    return ped.groupBy(*design).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.exp("offset")).alias("exposure"),
        *[F.sum(c).alias(c) for c in events])
