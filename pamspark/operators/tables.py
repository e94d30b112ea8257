"""Life tables and stratified descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, six_number_summary
from ..functions.scalars import interval_text, labelled_counts, round_half_even
from .cohort import KEY, died_soon_after_weaning
from .ped import FOLLOW_UP, as_ped
from .relational import cut_labels, stratum_rates

STRATA = ["Year", "Gender", "mv_hours", "OralIntake2_4", "inMV2_4", "Propofol2_4", "PN2_4", "EN2_4",
          "AdmCatID", "DiagID2"]
LAST_ROW_STRATA = [s for s in STRATA if s != "mv_hours"]


def life_table(ped: DataFrame) -> DataFrame:
    """At risk and events of both causes per interval, from the rows at risk."""
    return ped.groupBy("tend", "interval_label").agg(
        F.count(F.lit(1)).alias("at_risk"), F.sum("ped_status_1").alias("dying"),
        F.sum("ped_status_2").alias("extubation"))


def life_table_from_cohort(cohort: DataFrame, from_day: int = 5, horizon: int = FOLLOW_UP,
                           time: str = "event_time") -> DataFrame:
    """The same table without generating a row per subject and day.

    Subjects are first counted by the day their time falls on (at most ``horizon`` + 1 values per
    cause), and only these counts are exploded into days.
    """
    day = F.least(F.ceil(F.col(time)).cast("int"), F.lit(horizon + 1))
    counts = cohort.groupBy(day.alias("event_time"), "delta_1", "delta_2").agg(
        F.count(F.lit(1)).alias("n"))
    ped = as_ped(counts, cuts=range(horizon + 1), from_day=from_day, keep=["n"])
    n = F.col("n")
    return ped.groupBy("tend", "interval_label").agg(
        F.sum(n).alias("at_risk"), F.sum(n * F.col("ped_status_1")).alias("dying"),
        F.sum(n * F.col("ped_status_2")).alias("extubation"))


def mv_hour_bin(days: str = "DaysMechVent") -> Column:
    """Ventilation hours up to 24, up to 48, or more; the top edge is the data's maximum."""
    return cut_labels(F.col(days) * 24, [0, 24, 48, None], ["[0,24]", "(24,48]", "(48,max]"])


def baseline_table(patient: DataFrame, strata: Sequence[str] = STRATA,
                   outcome: str = "PatientDied") -> DataFrame:
    """Count, percent and mortality for every level of every stratum."""
    return stratum_rates(patient.withColumn("mv_hours", mv_hour_bin()), strata, outcome)


def last_interval_rates(last: DataFrame, strata: Sequence[str] = LAST_ROW_STRATA) -> DataFrame:
    """Percent dying under ventilation per level, from the subjects' last rows."""
    return stratum_rates(last, strata, "ped_status_1")


def study_flow(patient: DataFrame, subjects: DataFrame, horizon: int = FOLLOW_UP) -> DataFrame:
    """Subjects, events, censored, shares and deaths soon after weaning, as one row."""
    seen = F.col("event_time") <= horizon
    flow = subjects.agg(
        F.count(F.lit(1)).alias("n_model"),
        F.count_if(seen & (F.col("delta_2") == 1)).alias("n_extubated"),
        F.count_if(seen & (F.col("delta_1") == 1)).alias("n_died"),
        F.count_if(died_soon_after_weaning(at_most=2)).alias("n_died_48h"),
        F.count_if(died_soon_after_weaning(more_than=2, at_most=3)).alias("n_died_48_72h"))
    everyone = patient.agg(F.count(F.lit(1)).alias("n_database"))
    n = F.col("n_model")
    return everyone.crossJoin(flow).withColumn(
        "n_censored", n - F.col("n_extubated") - F.col("n_died")).withColumns({
            "extubated_share": F.col("n_extubated") / n, "died_share": F.col("n_died") / n,
            "censored_share": F.col("n_censored") / n})


def diet_days(daily: DataFrame, subjects: DataFrame) -> DataFrame:
    """Complete days, their number per subject, and days with parenteral intake.

    The share of parenteral days divides a count over all days by the complete days only.
    """
    days = daily.agg(
        F.count_if(~F.col("incomplete_day")).alias("diet_days"),
        F.count_if(F.col("PN") == 1).alias("pn_days"),
        F.count_if(F.col("PN") == 0).alias("no_pn_days"),
        F.count_if(~F.col("incomplete_day") & (F.col("proteinAdjustedPercentage") != 0))
         .alias("protein_days"))
    n = subjects.agg(F.count(F.lit(1)).alias("n_subjects"))
    return days.crossJoin(n).withColumns({
        "diet_days_per_subject": F.col("diet_days") / F.col("n_subjects"),
        "pn_share": F.col("pn_days") / F.col("diet_days")})


def en_share(daily: DataFrame) -> DataFrame:
    """Enteral share of enteral plus parenteral."""
    return daily.agg(F.sum("EN").alias("en"), F.sum("PN").alias("pn")).withColumn(
        "en_share", F.col("en") / (F.col("en") + F.col("pn")))


def low_intake_subjects(daily: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects with at least one complete day in neither intake category, exactly counted."""
    low = daily.where(~F.col("incomplete_day") & (F.col("proteinCat2") == 0) & (F.col("proteinCat3") == 0))
    return low.agg(F.count_distinct(KEY).alias("n_low")).crossJoin(
        subjects.agg(F.count(F.lit(1)).alias("n_subjects"))).withColumn(
        "low_share", F.col("n_low") / F.col("n_subjects"))


def intake_band(col: str = "proteinGproKG") -> Column:
    """Band I below 0.8 without zero, II from 0.8 to 1.2, III above."""
    g = F.col(col)
    return (F.when((g < 0.8) & (g != 0), "I").when(g.between(0.8, 1.2), "II").when(g > 1.2, "III"))


def intake_bands(daily: DataFrame) -> DataFrame:
    """Share of protein days and six-number summaries of protein and calories per intake band."""
    complete = daily.where(~F.col("incomplete_day"))
    days = complete.withColumn("band", intake_band()).where(F.col("band").isNotNull())
    protein = complete.where(F.col("proteinAdjustedPercentage") != 0).agg(
        F.count(F.lit(1)).alias("protein_days"))
    return (six_number_summary(days, ["band"], ["proteinGproKG", "calproKg"])
            .crossJoin(F.broadcast(protein))
            .withColumn("day_share", F.col("n") / F.col("protein_days")))


def stratified_table(last: DataFrame, stratum: str) -> DataFrame:
    """Age, severity, BMI, sex and admission statistics per stratum, as text where several values share a cell."""
    def is_(col, value):
        return F.col(col) == value

    def share(col, value):
        return round_half_even(F.avg(is_(col, value).cast("int")), 2)

    sexes = [("male", "Male"), ("female", "Female")]
    kinds = [("medical", "Medical"), ("elective", "Surgical/Elective"), ("emergency", "Surgical/Emeregency")]
    q = exact_quantiles(last, [stratum], ["Age", "ApacheIIScore", "BMI"], [0.25, 0.75])
    wide = q.groupBy(stratum).agg(*[
        F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{v}_{c}")
        for v in ("Age", "ApacheIIScore", "BMI") for c in ("q0", "q1")])
    stats = last.groupBy(stratum).agg(
        F.avg("Age").alias("m_age"), F.avg("ApacheIIScore").alias("m_apache"),
        round_half_even(F.avg("BMI"), 1).alias("m_bmi"),
        labelled_counts([(k, F.count_if(is_("Gender", v))) for k, v in sexes]).alias("sex_n"),
        labelled_counts([(k, share("Gender", v)) for k, v in sexes]).alias("sex_percentage"),
        labelled_counts([(k, F.count_if(is_("AdmCatID", v))) for k, v in kinds]).alias("admcat_n"),
        labelled_counts([(k, share("AdmCatID", v)) for k, v in kinds]).alias("admcat_percentage"))
    return stats.join(wide, stratum).select(
        stratum, "m_age", interval_text("Age_q0", "Age_q1").alias("IQR_age"),
        "m_apache", interval_text("ApacheIIScore_q0", "ApacheIIScore_q1").alias("IQR_apache"),
        "m_bmi", interval_text(round_half_even("BMI_q0", 1), round_half_even("BMI_q1", 1)).alias("IQR_bmi"),
        "sex_n", "sex_percentage", "admcat_n", "admcat_percentage")


def subgroup_cases(last: DataFrame, stratum: str) -> DataFrame:
    """Subjects and deaths per stratum."""
    return last.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.sum("ped_status_1").alias("cases"))


def time_to_event_summary(last: DataFrame, status: str = "ped_status_1") -> DataFrame:
    """Six-number summary of the event day among subjects with the event."""
    return six_number_summary(last.where(F.col(status) == 1), [], ["tend"])


def extubated_durations(subjects: DataFrame,
                        cols: Sequence[str] = ("DaysMechVent", "event")) -> DataFrame:
    """Six-number summaries of durations among the weaned."""
    return six_number_summary(subjects.where(F.col("delta_2") == 1), [], list(cols))
