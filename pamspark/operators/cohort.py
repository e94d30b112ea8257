"""Cohort rules: status, event time, subgroups, early deaths after weaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_in
from ..sources.schemas import require_columns
from .relational import drop_known, keep_known

KEY = "CombinedID"


def ventilated(patient: DataFrame, mv: str = "DaysMechVent") -> DataFrame:
    """Subjects with ventilation days; a null count is dropped as well."""
    return patient.where(F.col(mv) != 0)


def competing_status(df: DataFrame, mv: str = "DaysMechVent", disc: str = "Disc0To60",
                     surv: str = "Surv0To60", horizon: int = 60) -> DataFrame:
    """Add mv_status (0 censored, 1 extubated, 2 dead under ventilation), event_time, delta_1, delta_2.

    Ordered branches over three-valued logic: death needs a null discharge day, which therefore must
    not be filled before. Censored subjects stay at risk past the horizon. Every column is one flat
    CASE over the inputs, since a predicate on a derived column is expanded down to the scan.
    """
    require_columns(df, [mv, disc, surv], "patient")
    m, d, s = F.col(mv), F.col(disc), F.col(surv)

    def by_status(censored, extubated, dead):
        return (F.when((m >= horizon) | (m > d), censored)
                .when((m <= d) | (m < s), extubated).when(m >= s, dead))

    past = F.lit(horizon + 1).cast(df.schema[mv].dataType)
    return df.withColumns({
        "mv_status": by_status(0, 1, 2), "event_time": by_status(past, m, s),
        "delta_1": by_status(0, 0, 1), "delta_2": by_status(0, 1, 0)})


def status_known(mv: str = "DaysMechVent", disc: str = "Disc0To60", surv: str = "Surv0To60",
                 horizon: int = 60) -> Column:
    """Whether some branch of the status rule can be decided: the same as a non-null mv_status."""
    return F.col(mv).isNotNull() & (
        F.col(disc).isNotNull() | F.col(surv).isNotNull() | (F.col(mv) >= horizon))


def build_cohort(patient: DataFrame) -> DataFrame:
    """Ventilated subjects with a known status."""
    return competing_status(ventilated(patient).where(status_known()))


def unknown_status_count(patient: DataFrame) -> DataFrame:
    """How many ventilated subjects have no status and are left out."""
    return ventilated(patient).agg(F.count_if(~status_known()).alias("n_unknown"))


def fitted_subjects(cohort: DataFrame, window: DataFrame, from_day: int = 5) -> DataFrame:
    """Cohort subjects that contribute at least one row at risk from ``from_day`` on and own a diary.

    A subject has such a row exactly when the event time lies past the day before, so the rows need
    not be generated to find the subjects.
    """
    return keep_known(cohort.where(F.col("event_time") > from_day - 1), window, KEY)


def died_soon_after_weaning(more_than: float | None = None, at_most: float = 2) -> Column:
    """Weaned subjects whose death followed within the given days."""
    gap = F.col("Surv0To60") - F.col("DaysMechVent")
    hit = (F.col("PatientDied") == 1) & (F.col("delta_2") == 1) & (gap <= at_most)
    return hit if more_than is None else hit & (gap > more_than)


def early_death(window: float = 2) -> Column:
    """The same as a condition that is never null."""
    return F.coalesce(died_soon_after_weaning(at_most=window), F.lit(False))


def reclassify_early_death(cohort: DataFrame, window: float = 2) -> DataFrame:
    """Count weaned subjects who died within ``window`` days as deaths; the event time stays."""
    hit = early_death(window)
    return cohort.withColumns({
        "delta_1": F.when(hit, 1).otherwise(F.col("delta_1")),
        "delta_2": F.when(hit, 0).otherwise(F.col("delta_2"))})


def reclassify_early_death_by_union(cohort: DataFrame, window: float = 2) -> DataFrame:
    """The same by anti join and union; kept for checking the one-pass form."""
    moved = cohort.where(died_soon_after_weaning(at_most=window)).withColumns(
        {"delta_1": F.lit(1), "delta_2": F.lit(0)})
    return drop_known(cohort, moved, KEY).unionByName(moved)


def bmi_class(col: str = "BMI") -> Column:
    """Three classes; 18.5, 30 and a missing value fall into the middle."""
    c = F.col(col)
    return F.when(c < 18.5, "bmi<18.5").when(c > 30, "bmi>30").otherwise("bmi18.5-30")


def pn_class(col: str = "PN2_4") -> Column:
    """Days with parenteral nutrition: 0 or 1 against the rest; a missing value is in the rest."""
    return F.when(is_in(col, [0, 1]), "pn01").otherwise("pn23")


def with_strata(df: DataFrame) -> DataFrame:
    """Add ``bmi_cat`` and ``pn_bin`` in one projection."""
    return df.withColumns({"bmi_cat": bmi_class(), "pn_bin": pn_class()})


def subgroup(df: DataFrame, rule: Column, daily: DataFrame | None = None):
    """One stratum of the cohort and, if given, the diary restricted to it."""
    chosen = df.where(rule)
    return chosen if daily is None else (chosen, keep_known(daily, chosen, KEY))
