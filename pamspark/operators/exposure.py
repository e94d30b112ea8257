"""Time-lagged exposure: lag-lead table, diary windows, cumulative exposure, protocols."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import add_all, literal_vector, recycle
from ..sources.io import cut_lineage, literal_table
from .cohort import KEY
from .ped import FOLLOW_UP, as_ped

WIDTH = 11
LagLead = Callable[[Column, Column], Column]

# The five diets (days 1-4 and 5-11 of both intake categories) and the six comparisons.
SCHEMES = [
    ("low", "exclusively low", [0] * 11, [0] * 11),
    ("low_to_med", "late standard", [0] * 4 + [1] * 7, [0] * 11),
    ("med", "early standard", [1] * 11, [0] * 11),
    ("med_to_high", "late high", [1] * 4 + [0] * 7, [0] * 4 + [1] * 7),
    ("high", "early high", [0] * 11, [1] * 11),
]
COMPARISONS = [
    ("A", "low", "low_to_med"),
    ("B", "low_to_med", "med"),
    ("C", "low", "med"),
    ("D", "med", "med_to_high"),
    ("E", "med_to_high", "high"),
    ("F", "med", "high"),
]
# Intake level names and the bar heights that stand for them.
INTAKE_CODING = [("< 0.8 g/kg", 0.49), ("0.8 - 1.2 g/kg", 0.99), ("> 1.2 g/kg", 1.41)]


def protein_lag_lead(t: Column, tz: Column) -> Column:
    """Intake on day tz can act on day t from four days later until day 3 tz + 10."""
    return (t >= tz + 4) & (t <= tz * 3 + 10)


def lag_lead(spark: SparkSession, ts: Sequence[int] = range(FOLLOW_UP + 1),
             tzs: Sequence[int] = range(1, WIDTH + 1), pred: LagLead = protein_lag_lead) -> DataFrame:
    """The 0/1 table ``t, tz, LL`` of a lag-lead predicate."""
    t = spark.range(min(ts), max(ts) + 1).select(F.col("id").cast("int").alias("t"))
    tz = spark.range(min(tzs), max(tzs) + 1).select(F.col("id").cast("int").alias("tz"))
    return t.crossJoin(F.broadcast(tz)).withColumn("LL", pred(F.col("t"), F.col("tz")).cast("int"))


def diary_window(daily: DataFrame, values: Sequence[str] = ("proteinCat2", "proteinCat3"),
                 key: str = KEY, day: str = "Study_Day", width: int = WIDTH) -> DataFrame:
    """One row per subject: ``n_days`` and, per value column, an array of ``width`` days padded with 0.

    The place in the diary is the rank of the day, cut at ``width``. The cut lets Spark keep at most
    ``width`` rows per subject before the shuffle, and the arrays come from ``width`` conditional
    maxima, so not even an overlong diary is collected as a list.
    """
    ranked = daily.select(key, day, *values).withColumn(
        "_pos", F.row_number().over(Window.partitionBy(key).orderBy(day))).where(F.col("_pos") <= width)
    slots = [F.max(F.when(F.col("_pos") == d, F.col(v).cast("double"))).alias(f"_{v}_{d}")
             for v in values for d in range(1, width + 1)]
    wide = ranked.groupBy(key).agg(F.max("_pos").alias("n_days"), *slots)
    return wide.select(key, "n_days", *[
        F.array(*[F.coalesce(F.col(f"_{v}_{d}"), F.lit(0.0)) for d in range(1, width + 1)]).alias(v)
        for v in values])


def overlong_diaries(daily: DataFrame, key: str = KEY, width: int = WIDTH) -> DataFrame:
    """Subjects whose diary is longer than the window, and the rows that are cut off."""
    per = daily.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > width)
    return per.agg(F.count(F.lit(1)).alias("n_subjects"),
                   F.coalesce(F.sum(F.col("n") - width), F.lit(0)).alias("n_rows_cut"))


def numbered_days(daily: DataFrame, key: str = KEY, day: str = "Study_Day", segments: int | None = None) -> DataFrame:
    """``daily`` with ``_pos``, the place of a row among its subject's days, ties in the order of the row's hash.

    Rows are ranged by subject, day and hash into ``segments`` (default: the shuffle partitions), so that a long diary spans
    many of them. Numbers inside a segment start after the rows that the subject has in earlier segments; a subject has one
    count per segment, so no task needs more than a segment's rows or a subject's counts.
    """
    spark = daily.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(c) for c in daily.columns])
    # written, so that both uses below see the same segments even if executors are lost
    ranged = cut_lineage(daily.withColumn("_tie", tie).repartitionByRange(segments, key, day, "_tie")
                         .withColumn("_segment", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_segment").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_segment")
    offsets = counts.select(F.col(key).alias("_key"), F.col("_segment").alias("_at"),
                            (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_segment", key).orderBy(day, "_tie"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_at"))
    return ranged.withColumn("_inside", inside).join(offsets, same).withColumn(
        "_pos", F.col("_before") + F.col("_inside")).drop("_tie", "_segment", "_inside", "_key", "_at", "_before")


def nested_diary(daily: DataFrame, values: Sequence[str], key: str = KEY, day: str = "Study_Day",
                 piece_days: int = 1000, segments: int | None = None) -> DataFrame:
    """The diary as ordered lists of day records: all days of a subject, in numbered pieces of ``piece_days``."""
    needed = [F.col(c) for c in dict.fromkeys([key, day, *values])]
    ranked = numbered_days(daily.select(*needed), key, day, segments)
    return ranked.groupBy(key, F.floor((F.col("_pos") - 1) / piece_days).cast("int").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_pos").cast("int").alias("day"), *values))).alias("diary"))


def with_window(subjects: DataFrame, window: DataFrame, key: str = KEY) -> DataFrame:
    """Subjects joined to their diary window; both sides are restricted to each other.

    Both sides have one row per subject, and the join comes before the explode into days.
    """
    return subjects.join(window, key)


def add_cumulative_exposure(ped: DataFrame, values: Sequence[str] = ("proteinCat2", "proteinCat3"),
                            pred: LagLead = protein_lag_lead, width: int = WIDTH) -> DataFrame:
    """Add the arrays ``t``, ``tz`` and ``LL`` to rows that carry diary windows and ``n_days``.

    The row with end day k uses the lag-lead entries of t = k. ``t`` is the middle of the interval and
    ``tz`` the day plus one; both are 0 on padded days, while LL is not padded.
    """
    have = [F.lit(d) <= F.col("n_days") for d in range(1, width + 1)]
    mid = F.col("tend") - F.lit(0.5)
    return ped.withColumns({
        "t": F.array(*[F.when(h, mid).otherwise(0.0) for h in have]),
        "tz": F.array(*[F.when(h, F.lit(d + 1.0)).otherwise(0.0) for d, h in enumerate(have, 1)]),
        "LL": lag_lead_array(F.col("tend"), pred, width)})


def lag_lead_array(t: Column, pred: LagLead = protein_lag_lead, width: int = WIDTH) -> Column:
    return F.array(*[pred(t, F.lit(d)).cast("double") for d in range(1, width + 1)])


def effective_exposure(t: Column, value: str, pred: LagLead = protein_lag_lead,
                       width: int = WIDTH) -> Column:
    """Sum over the diary days of lag-lead times intake category."""
    return add_all([F.when(pred(t, F.lit(d)), F.col(value)[d - 1]).otherwise(0.0)
                    for d in range(1, width + 1)])


def window_sums_at_risk(subjects: DataFrame, values: Sequence[str] = ("proteinCat2", "proteinCat3"),
                        from_day: int = 5, horizon: int = FOLLOW_UP, width: int = WIDTH) -> DataFrame:
    """Diary windows summed over the subjects at risk, per end day.

    Subjects are summed by their last day first; only these sums are carried to the days before.
    """
    t = F.col("event_time")
    slots = [(v, d, f"_{v}_{d}") for v in values for d in range(width)]
    per_last = subjects.where(t > from_day - 1).groupBy(
        F.least(F.ceil(t).cast("int"), F.lit(horizon)).alias("last")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(v)[d]).alias(a) for v, d, a in slots])
    days = per_last.select("*", F.explode(F.sequence(F.lit(from_day), F.col("last"))).alias("tend"))
    sums = days.groupBy("tend").agg(F.sum("_n").alias("n_rows"), *[F.sum(a).alias(a) for _, _, a in slots])
    return sums.select("tend", "n_rows", *[
        F.array(*[F.col(a) for u, _, a in slots if u == v]).alias(v) for v in values])


def schemes(spark: SparkSession) -> DataFrame:
    """The five hypothetical diets as ``protocol, label, C2, C3``."""
    return literal_table(
        spark, [(p, lab, recycle(c2, WIDTH), recycle(c3, WIDTH)) for p, lab, c2, c3 in SCHEMES],
        "protocol string, label string, C2 array<double>, C3 array<double>")


def comparisons(spark: SparkSession) -> DataFrame:
    """The six diet comparisons as ``comparison, p1, p2, name``."""
    label = {p: lab for p, lab, _, _ in SCHEMES}
    return literal_table(
        spark, [(c, a, b, f"{label[a]} vs. {label[b]}") for c, a, b in COMPARISONS],
        "comparison string, p1 string, p2 string, name string")


def protocol_frames(template: DataFrame, scheme: DataFrame, horizon: int = FOLLOW_UP,
                    from_day: int = 5, dummy: str = "icuByDummy",
                    values: Sequence[str] = ("proteinCat2", "proteinCat3")) -> DataFrame:
    """Prediction rows: every template subject under every diet on every day at risk.

    The template keeps its covariates; the group effect is switched off and the diary is the diet's.
    """
    drop = [c for c in (*values, "n_days", "event_time", "delta_1", "delta_2") if c in template.columns]
    base = template.drop(*drop).crossJoin(F.broadcast(scheme)).withColumns({
        dummy: F.lit(0), "n_days": F.lit(WIDTH), "event_time": F.lit(horizon),
        "delta_1": F.lit(1), "delta_2": F.lit(1),
        values[0]: F.col("C2"), values[1]: F.col("C3")}).drop("C2", "C3")
    return as_ped(base, cuts=range(horizon + 1), from_day=from_day,
                  keep=[c for c in base.columns if c not in ("event_time", "delta_1", "delta_2")])


def template_subjects(subjects: DataFrame, by: Sequence[str] = (), key: str = KEY) -> DataFrame:
    """The subject with the smallest key, over all rows or per stratum."""
    keys = subjects.groupBy(*by).agg(F.min(key).alias(key))
    return subjects.join(F.broadcast(keys.select(key)), key, "left_semi")


def scheme_table(spark: SparkSession) -> DataFrame:
    """Diet level and bar height per comparison, side and day, in long form."""
    coding = literal_table(spark, INTAKE_CODING, "value string, code double")
    day = F.posexplode(F.arrays_zip("C2", "C3")).alias("pos", "c")
    levels = schemes(spark).select("protocol", "label", day).select(
        "protocol", "label", (F.col("pos") + 1).alias("te"),
        F.when(F.col("c.C3") == 1, INTAKE_CODING[2][0]).when(F.col("c.C2") == 1, INTAKE_CODING[1][0])
         .otherwise(INTAKE_CODING[0][0]).alias("value"))
    sides = comparisons(spark).unpivot(["comparison"], ["p1", "p2"], "variable", "protocol")
    return sides.join(levels, "protocol").join(F.broadcast(coding), "value", "left")
