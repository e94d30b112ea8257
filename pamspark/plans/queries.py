"""The registered queries: every one reads the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import bspline_columns
from ..functions.quantiles import six_number_summary
from ..operators import cif as ci
from ..operators import cohort as co
from ..operators import design as de
from ..operators import effects as ef
from ..operators import exposure as ex
from ..operators import fit as fi
from ..operators import model as mo
from ..operators import ped as pe
from ..operators import relational as re_
from ..operators import tables as tb
from ..sources import testviews
from ..sources.io import bucketed_copy, checkpoint_folder, cut_lineage, ship_package, write_csv, write_csv_per_group
from . import analysis as an

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """The tables a query starts from, as lazy DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def patient(self) -> DataFrame:
        return testviews.patient(self.spark, self.sf_dir)

    @cached_property
    def daily(self) -> DataFrame:
        return testviews.daily(self.spark, self.sf_dir)

    @cached_property
    def cohort(self) -> DataFrame:
        return co.build_cohort(self.patient)

    @cached_property
    def window(self) -> DataFrame:
        return ex.diary_window(self.daily)

    @cached_property
    def diary_ids(self) -> DataFrame:
        """Subjects with a diary; the line items need not be ranked for that."""
        return testviews.line_items(self.spark, self.sf_dir).select(
            F.col("l_orderkey").alias(co.KEY)).distinct()

    @cached_property
    def fitted(self) -> DataFrame:
        return co.with_strata(co.fitted_subjects(self.cohort, self.diary_ids))

    @cached_property
    def exposed(self) -> DataFrame:
        """Fitted subjects with their diary windows, one row each."""
        at_risk = self.cohort.where(F.col("event_time") > 4)
        return ex.with_window(co.with_strata(at_risk), self.window)

    @cached_property
    def last(self) -> DataFrame:
        f = self.fitted
        return pe.last_intervals(f, keep=[c for c in f.columns if c not in ("event_time", "delta_1", "delta_2")])

    @cached_property
    def kept_daily(self) -> DataFrame:
        return re_.keep_known(self.daily, co.fitted_subjects(self.cohort, self.diary_ids), co.KEY)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that the order of additions cannot show."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields
                           if f.dataType.simpleString() == "double"})


def ped(x: Inputs, keep=("CombinedID",)) -> DataFrame:
    return pe.as_ped(x.fitted, from_day=5, keep=list(keep))


def _ped_rows(x: Inputs) -> DataFrame:
    return ped(x, ["AdmCatID"]).groupBy("AdmCatID", "tend").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("ped_status_1").alias("died"),
        F.sum("ped_status_2").alias("weaned"), F.sum("int_mid").alias("sum_int_mid"),
        F.min("tstart").alias("min_tstart"))


def _weekly(x: Inputs) -> DataFrame:
    rows = pe.as_ped(x.fitted, cuts=[7 * i for i in range(9)], keep=[])
    return rows.groupBy("tstart", "tend").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.exp("offset")).alias("person_time"),
        F.sum("ped_status_1").alias("died"), F.sum("ped_status_2").alias("weaned"))


def _reclass_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("delta_1", "delta_2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_time").alias("total_time"))


def _early(x: Inputs, more_than, at_most) -> DataFrame:
    return x.fitted.where(co.died_soon_after_weaning(more_than, at_most)).select(
        co.KEY, (F.col("Surv0To60") - F.col("DaysMechVent")).alias("gap"))


def _kept_tables(x: Inputs) -> DataFrame:
    def one(name, df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(co.KEY).alias("key_sum")).select(
            F.lit(name).alias("name"), "n", "key_sum")
    return one("patient", x.fitted).unionByName(one("daily", x.kept_daily))


def _subgroup_diaries(x: Inputs) -> DataFrame:
    """Diary days and subjects per subgroup: count days per subject first, then one pass over strata."""
    per = x.daily.groupBy(co.KEY).agg(F.count(F.lit(1)).alias("days"))
    rows = x.fitted.join(per, co.KEY)
    return re_.stack_strata(rows, ["AdmCatID", "bmi_cat", "pn_bin"], ["days"]).groupBy(
        "variable", "level").agg(F.sum("days").alias("n_days"), F.count(F.lit(1)).alias("n_subjects"))


def _saved_ped(x: Inputs) -> DataFrame:
    """Rows at risk written as a table, read back and counted."""
    saved = cut_lineage(ped(x, [co.KEY, "AdmCatID"]))
    return saved.groupBy("AdmCatID", "interval_label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(co.KEY).alias("n_subjects"),
        F.sum("ped_status_2").alias("weaned"))


def _last_rows_en(x: Inputs) -> DataFrame:
    """Deaths by enteral days: the column is joined back onto the last rows by their shared names."""
    last = pe.last_intervals(x.fitted)
    joined = re_.natural_left_join(last, x.patient.select("EN2_4", co.KEY))
    return joined.groupBy("EN2_4").agg((100 * F.avg("ped_status_1")).alias("mdeath"))


def _named_life_tables(x: Inputs) -> DataFrame:
    frames = {"main": tb.life_table_from_cohort(x.fitted), "sensitivity": _reclassified_life_table(x)}
    return re_.bind_named(frames, "cohort").select("cohort", "tend", "at_risk", "dying", "extubation")


def _diary_sums(x: Inputs) -> DataFrame:
    long = re_.unpivot(x.kept_daily.select(co.KEY, F.col("EN").cast("int").alias("EN"), "PN"), [co.KEY],
                       ["EN", "PN"], "kind", "days")
    return long.groupBy("kind").agg(F.sum("days").alias("days"), F.count(F.lit(1)).alias("n"))


def _relabelled(x: Inputs) -> DataFrame:
    labels = [("Medical", "medical"), ("Surgical/Elective", "elective"), ("Surgical/Emeregency", "emergency")]
    return re_.relabel(x.fitted, "AdmCatID", labels).groupBy("AdmCatID_ord", "AdmCatID").agg(
        F.count(F.lit(1)).alias("n"))


def _reclassified_life_table(x: Inputs) -> DataFrame:
    return tb.life_table_from_cohort(co.reclassify_early_death(x.fitted))


def _bucketed_subjects(x: Inputs, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Subjects and their diary windows as tables with the same buckets."""
    subjects = x.fitted.select(co.KEY, "AdmCatID", "event_time", "delta_1", "delta_2")
    return (bucketed_copy(subjects, co.KEY, buckets), bucketed_copy(x.window.select(co.KEY, "n_days"), co.KEY, buckets))


def _co_partitioned(x: Inputs) -> DataFrame:
    """Rows at risk and diary days per subject from two bucketed tables: joined and grouped by subject without a shuffle."""
    subjects, windows = _bucketed_subjects(x)
    rows = pe.as_ped(subjects.join(windows, co.KEY), from_day=5, keep=[co.KEY, "AdmCatID", "n_days"])
    per_subject = rows.groupBy(co.KEY).agg(F.first("AdmCatID").alias("AdmCatID"), F.first("n_days").alias("n_days"),
                                           F.count(F.lit(1)).alias("n_rows"), F.sum("ped_status_2").alias("weaned"))
    return per_subject.groupBy("AdmCatID").agg(
        F.count(F.lit(1)).alias("n_subjects"), F.sum("n_days").alias("n_days"), F.sum("n_rows").alias("n_rows"),
        F.sum("weaned").alias("weaned"))


def _extubated_icu_days(x: Inputs) -> DataFrame:
    """Durations of the weaned, their days in intensive care among them."""
    stays = x.fitted.join(testviews.unit_days(x.spark, x.sf_dir), co.KEY)
    return tb.extubated_durations(stays.withColumn("DaysInICU", F.least("unit_days", "event")), ["DaysMechVent", "DaysInICU", "event"])


def _baseline_csv(x: Inputs) -> DataFrame:
    """The baseline table written as one CSV file and read again with its types."""
    table = tb.baseline_table(x.fitted)
    folder = f"{checkpoint_folder(x.spark)}/csv-{uuid.uuid4().hex}"
    write_csv(table, folder, single_file=True)
    return x.spark.read.schema(table.schema).option("header", True).csv(folder)


def relational_queries() -> dict[str, Callable[[Inputs], DataFrame]]:
    return {
        "life_table": lambda x: tb.life_table_from_cohort(x.fitted),
        "life_table_from_rows": lambda x: tb.life_table(ped(x, [])),
        "life_table_reclassified": _reclassified_life_table,
        "cohort_status": lambda x: x.cohort.select(co.KEY, "mv_status", "delta_1", "delta_2", "event_time"),
        "cohort_status_counts": lambda x: x.cohort.groupBy("mv_status").agg(
            F.count(F.lit(1)).alias("n"), F.sum("event_time").alias("total_time")),
        "table_summary": lambda x: six_number_summary(
            x.patient, [], ["Age", "ApacheIIScore", "BMI", "Disc0To60", "Surv0To60", "DaysMechVent"]),
        "diary_summary": lambda x: six_number_summary(x.daily, [], ["Study_Day", "proteinGproKG", "calproKg"]),
        "ped_rows": _ped_rows,
        "ped_person_time": lambda x: pe.person_time(
            pe.as_ped(re_.keep_known(x.cohort, x.diary_ids, co.KEY), keep=[])),
        "ped_weekly_cuts": _weekly,
        "delayed_entry_ids": lambda x: x.fitted.select(co.KEY),
        "last_rows": lambda x: re_.last_per_group(ped(x), co.KEY, "tend").select(
            co.KEY, "tend", "ped_status_1", "ped_status_2"),
        "saved_ped": _saved_ped,
        "last_rows_en": _last_rows_en,
        "named_life_tables": _named_life_tables,
        "diary_sums": _diary_sums,
        "relabelled_admissions": _relabelled,
        "pn_day_frequency": lambda x: re_.frequency(x.fitted, "PN2_4", range(5)),
        "unknown_status": lambda x: co.unknown_status_count(x.patient),
        "first_subjects": lambda x: re_.first_rows(
            x.fitted.select(co.KEY, "AdmCatID", "event_time"), [co.KEY], 25),
        "kept_tables": _kept_tables,
        "early_death_reclass": lambda x: _reclass_counts(co.reclassify_early_death(x.fitted)),
        "early_death_by_union": lambda x: _reclass_counts(co.reclassify_early_death_by_union(x.fitted)),
        "early_death_48h": lambda x: _early(x, None, 2),
        "early_death_48_72h": lambda x: _early(x, 2, 3),
        "subgroup_cases_adm": lambda x: tb.subgroup_cases(x.last, "AdmCatID"),
        "subgroup_cases_bmi": lambda x: tb.subgroup_cases(x.last, "bmi_cat"),
        "subgroup_cases_pn": lambda x: tb.subgroup_cases(x.last, "pn_bin"),
        "subgroup_diaries": _subgroup_diaries,
        "baseline_table": lambda x: tb.baseline_table(x.fitted),
        "mv_hour_bins": lambda x: re_.frequency(x.fitted.select(tb.mv_hour_bin().alias("mv_hours")), "mv_hours"),
        "mv_hour_bins_cohort": lambda x: re_.frequency(x.cohort.select(tb.mv_hour_bin().alias("mv_hours")), "mv_hours"),
        "co_partitioned": _co_partitioned,
        "baseline_csv": _baseline_csv,
        "year_levels": lambda x: re_.levels(x.fitted, "Year"),
        "last_interval_rate": lambda x: tb.last_interval_rates(x.last),
        "continuous_summary": lambda x: six_number_summary(x.fitted, [], ["Age", "ApacheIIScore", "BMI"]),
        "stratified_table_pn": lambda x: tb.stratified_table(x.last, "pn_bin"),
        "stratified_table_bmi": lambda x: tb.stratified_table(x.last, "bmi_cat"),
        "study_flow": lambda x: tb.study_flow(x.patient, x.fitted),
        "diet_days": lambda x: tb.diet_days(x.kept_daily, x.fitted),
        "en_share": lambda x: tb.en_share(x.kept_daily),
        "low_intake_subjects": lambda x: tb.low_intake_subjects(x.kept_daily, x.fitted),
        "intake_bands": lambda x: tb.intake_bands(x.kept_daily),
        "time_to_death_summary": lambda x: tb.time_to_event_summary(x.last),
        "extubated_durations": lambda x: tb.extubated_durations(x.fitted, ["DaysMechVent", "event"]),
        "extubated_icu_days": _extubated_icu_days,
    }


# ---- exposure, design and inference -------------------------------------------------------------

GIVEN_RANGES = {"t": (0.0, 59.5), "tz": (0.0, 12.0), "int_mid": (4.5, 59.5)}
GIVEN_SPEC = de.PamSpec(exposures=("proteinCat3", "proteinCat2"))
SECOND_CAUSE = 13


def _given_info(x: Inputs) -> de.BasisInfo:
    return de.BasisInfo(GIVEN_RANGES, {}, de.lag_lead_weights(x.spark, ex.protein_lag_lead, 60))


def _given_draws(x: Inputs, shift: int = 0) -> DataFrame:
    """Given coefficient draws out of the vectors: the first place is the intercept, less 3."""
    p = 1 + 2 * GIVEN_SPEC.exposure_k ** 2
    vec = F.slice("beta", shift + 1, p)
    return testviews.draws(x.spark, x.sf_dir).select(
        "sim_id", F.concat(F.array(vec[0] - 3), F.slice(vec, 2, p - 1)).alias("beta"))


def _given_model(x: Inputs, shift: int = 0) -> mo.PamModel:
    """Mean and covariance of the given draws as a model."""
    mean, cov = ci.draw_moments(_given_draws(x, shift))
    return mo.PamModel("given", GIVEN_SPEC, _given_info(x), mean, cov)


def _template_frames(x: Inputs, by=()) -> DataFrame:
    chosen = ex.template_subjects(x.fitted, by)
    return ex.protocol_frames(chosen, ex.schemes(x.spark))


def _exposed_rows(x: Inputs, keep=()) -> DataFrame:
    e = x.exposed
    return pe.as_ped(e, from_day=5, keep=["n_days", "proteinCat2", "proteinCat3", *keep])


def _lag_lead_at_risk(x: Inputs) -> DataFrame:
    risk = tb.life_table_from_cohort(x.fitted).select(F.col("tend").alias("t"), "at_risk")
    return ex.lag_lead(x.spark).join(F.broadcast(risk), "t").withColumn("acting", F.col("at_risk") * F.col("LL"))


def _diary_text(x: Inputs) -> DataFrame:
    def text(c):
        return F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), "")
    return x.window.select(co.KEY, "n_days", text("proteinCat2").alias("c2"), text("proteinCat3").alias("c3"))


def _nested_text(x: Inputs) -> DataFrame:
    day = F.transform("diary", lambda d: F.concat(d["day"].cast("string"), F.lit(":"), d["EN"].cast("string")))
    return ex.nested_diary(x.daily, ["EN"]).select(
        co.KEY, "piece", F.size("diary").cast("bigint").alias("n_days"),
        F.element_at("diary", -1)["day"].alias("last_day"), F.array_join(day, ",").alias("diary"))


def _cumulative_exposure(x: Inputs) -> DataFrame:
    """Sums of the five exposure arrays per end day and diary day: arrays are summed by place."""
    rows = ex.add_cumulative_exposure(_exposed_rows(x))
    names = [("t", "sum_t"), ("tz", "sum_tz"), ("LL", "sum_ll"), ("proteinCat2", "sum_c2"), ("proteinCat3", "sum_c3")]
    sums = rows.groupBy("tend").agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.sum(F.col(c)[d]).alias(f"{a}_{d}") for c, a in names for d in range(ex.WIDTH)])
    per_day = F.array(*[F.struct(F.lit(d + 1).alias("day"), *[F.col(f"{a}_{d}").alias(a) for _, a in names])
                        for d in range(ex.WIDTH)])
    return sums.select("tend", "n_rows", F.inline(per_day))


def _effective_exposure(x: Inputs) -> DataFrame:
    rows = _exposed_rows(x).select("tend", ex.effective_exposure(F.col("tend"), "proteinCat2").alias("e2"),
                                   ex.effective_exposure(F.col("tend"), "proteinCat3").alias("e3"))
    return rows.groupBy("tend", "e2", "e3").agg(F.count(F.lit(1)).alias("n_rows"))


def _protocol_frames(x: Inputs) -> DataFrame:
    """First subject of every admission category under all diets."""
    return _template_frames(x, ["AdmCatID"]).select(
        "AdmCatID", co.KEY, "protocol", "label", "tend", "icuByDummy",
        ex.effective_exposure(F.col("tend"), "proteinCat2").alias("e2"),
        ex.effective_exposure(F.col("tend"), "proteinCat3").alias("e3"))


def _bspline_basis(x: Inputs) -> DataFrame:
    values = x.fitted.groupBy("BMI").agg(F.count(F.lit(1)).alias("n"))
    span = x.fitted.agg(F.min("BMI").alias("lo"), F.max("BMI").alias("hi"))
    basis = F.posexplode(F.array(*bspline_columns(F.col("BMI"), F.col("lo"), F.col("hi"), 10))).alias("i", "value")
    return values.crossJoin(F.broadcast(span)).select("BMI", "n", basis)


def _tensor_exposure(x: Inputs) -> DataFrame:
    """Column sums of both exposure tensors per end day."""
    sums = ex.window_sums_at_risk(x.exposed)
    outer = sums.select("tend", *[
        de.tensor_exposure(F.col("tend"), F.col(v), GIVEN_RANGES).alias(c)
        for c, v in (("cat3", "proteinCat3"), ("cat2", "proteinCat2"))])
    return outer.select("tend", F.posexplode(F.arrays_zip("cat3", "cat2")).alias("k", "v")).select(
        "tend", "k", F.col("v")["cat3"].alias("cat3"), F.col("v")["cat2"].alias("cat2"))


def _design_sums(x: Inputs) -> DataFrame:
    """Column sums of a design over all rows at risk."""
    spec = de.PamSpec(factors=(("AdmCatID", ("Medical", "Surgical/Elective", "Surgical/Emeregency")),),
                      linear=("ApacheIIScore",), time_linear=("ApacheIIScore",),
                      exposures=GIVEN_SPEC.exposures)
    design = de.Design(spec, _given_info(x))
    totals = de.column_sums(_exposed_rows(x, ["AdmCatID", "ApacheIIScore"]), design)
    return totals


def _linear_predictor(x: Inputs) -> DataFrame:
    return _predictor_summary(x, _given_model(x))


def _predictor_summary(x: Inputs, model: mo.PamModel) -> DataFrame:
    rows = mo.predict_terms(_exposed_rows(x), model, ["tend"], effect="proteinCat")
    return rows.groupBy("tend").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("eta").alias("mean_eta"),
        F.avg("eta_effect").alias("mean_effect"), F.max("eta_effect").alias("max_effect"),
        F.min("eta_effect").alias("min_effect"))


def _effects_given(x: Inputs) -> DataFrame:
    return ef.six_comparisons(_given_model(x), _template_frames(x))


def _hazards_given(x: Inputs) -> DataFrame:
    model = mo.PamModel("given", GIVEN_SPEC, _given_info(x), *ci.zero_moments(GIVEN_SPEC))
    return ci.cause_hazards([_given_draws(x), _given_draws(x, SECOND_CAUSE)], [model, model], _template_frames(x))


def _curves_given(x: Inputs) -> DataFrame:
    model = mo.PamModel("given", GIVEN_SPEC, _given_info(x), *ci.zero_moments(GIVEN_SPEC))
    return ci.cif_curves([_given_draws(x), _given_draws(x, SECOND_CAUSE)], [model, model], _template_frames(x))


def _cif_band_given(x: Inputs) -> DataFrame:
    return ci.paired_bands(ci.cif_band(_curves_given(x)), ex.comparisons(x.spark), ex.schemes(x.spark))


ADMISSIONS = ("Medical", "Surgical/Elective", "Surgical/Emeregency")


def _admission_rates(x: Inputs, m: mo.PamModel) -> DataFrame:
    """Rate and standard error of its logarithm per admission category, of a model with that factor alone."""
    rows = []
    for i, lv in enumerate(ADMISSIONS):
        pick = np.zeros(len(m.beta))
        pick[[0, i] if i else [0]] = 1
        rows.append((lv, float(np.exp(pick @ m.beta)), float(np.sqrt(pick @ m.cov @ pick))))
    return x.spark.createDataFrame(rows, "AdmCatID string, rate double, log_rate_se double")


def _closed_form_rates(x: Inputs) -> DataFrame:
    """Rates per admission category from an unpenalised fit."""
    m = fi.fit_pam(fi.subject_blocks(x.fitted), de.PamSpec(factors=(("AdmCatID", ADMISSIONS),)), "delta_1",
                   smooth=False, tol=1e-12)
    counts = pe.last_intervals(x.fitted, keep=["AdmCatID"]).groupBy("AdmCatID").agg(
        F.sum("ped_status_1").alias("died"), F.sum(F.col("tend") - 4).alias("n_rows"))
    return counts.join(_admission_rates(x, m), "AdmCatID")


def _compressed_fit(x: Inputs) -> DataFrame:
    """Rows at risk grouped by the fixed part of their design, diary windows included, and rates from a fit of the groups."""
    keys = ["AdmCatID", "n_days", "proteinCat2", "proteinCat3", "tend"]
    small = cut_lineage(pe.compress(_exposed_rows(x, ["AdmCatID"]), keys))
    m = fi.fit_pam(fi.row_blocks(small, {"weaned": "ped_status_2"}), de.PamSpec(factors=(("AdmCatID", ADMISSIONS),)),
                   "weaned", smooth=False, tol=1e-12)
    sizes = small.groupBy("AdmCatID").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    return sizes.join(_admission_rates(x, m), "AdmCatID")


def _closed_form_coefficients(x: Inputs) -> DataFrame:
    m = fi.fit_pam(fi.subject_blocks(x.fitted), de.PamSpec(factors=(("Gender", ("Female", "Male")),)), "delta_2",
                   name="weaning", smooth=False, tol=1e-12)
    return ef.coef_table([m], x.spark, exclude=["PN2_4"]).drop("idx")


def _coefficients_without(x: Inputs) -> DataFrame:
    """Coefficients of every diagnosis but one that occurs and one that does not."""
    levels = de.observed_levels(x.fitted, ["DiagID2"])["DiagID2"]
    m = fi.fit_pam(fi.subject_blocks(x.fitted), de.PamSpec(factors=(("DiagID2", levels),)), "delta_2",
                   name="weaning", smooth=False, tol=1e-12)
    return ef.coef_table([m], x.spark, labelled=False, exclude=["2-HIGH", "PN2_4", "Intercept"]).select("model", "term", "estimate", "se")


def _spread(subjects: DataFrame) -> DataFrame:
    """Subjects dealt over the tasks before their rows at risk are generated and scored: a written table is small
    beside the rows it stands for, and would be read by few tasks."""
    return subjects.repartition(co.KEY)


def _fit_calibration(x: Inputs) -> DataFrame:
    """Events that the four main models expect per level of every factor, at given smoothing parameters.

    Whatever the penalties, a fit expects in every level of an unpenalised factor as many events as it saw.
    The expected ones are added up row by row from the finished model, its unit effects included.
    """
    subjects = an.study_subjects(x.patient, x.daily)
    spec = an.study_spec(subjects)
    models = an.fit_main(subjects, spec, smooth=False, tol=1e-9)
    effects = mo.unit_effects(list(models.values()))
    met = subjects.join(effects, F.col(spec.group).cast("string") == F.col("grp"), "left")
    units = {f"unit_{name}": F.col(spec.group_switch) * F.coalesce(F.col("effects")[i], F.lit(0.0)) for i, name in enumerate(models)}
    parts = mo.RowParts(list(models.values())).added(met.withColumns(units))
    rows = pe.as_ped(_spread(parts), from_day=5, keep=[mo.RowParts.COLUMN, *de.FACTORS, *units])
    scored = mo.predict_terms(rows, models, [*de.FACTORS, *units, "offset"])
    expected = {n: F.sum(F.exp(F.col(f"eta_{n}") + F.col(f"unit_{n}") + F.col("offset"))) for n in models}
    sums = scored.groupBy(*de.FACTORS).agg(*[mu.alias(n) for n, mu in expected.items()])
    long = re_.stack_strata(sums, list(de.FACTORS), list(models)).groupBy("variable", "level").agg(
        *[F.round(F.sum(n), 2).alias(n) for n in models])
    return long.unpivot(["variable", "level"], list(models), "model", "expected").select("variable", "level", "expected", "model")


def _unit_quantiles(x: Inputs) -> DataFrame:
    """Given unit effects, the mean severity of a unit's subjects, by rank against normal quantiles."""
    units = x.fitted.groupBy(F.col("CombinedicuID").cast("string").alias("grp")).agg(
        F.avg("ApacheIIScore").alias("effect"))
    return ef.effect_quantiles(units)


SMOOTH_SPEC = de.PamSpec(baseline_k=10, time_smooths=("Age", "BMI"))


def _smooth_given(x: Inputs) -> DataFrame:
    """Smooths of given raw spline coefficients (places 2 to 31 of the vectors) under the cohort's centring."""
    info = de.basis_info(fi.subject_blocks(x.fitted), SMOOTH_SPEC)
    mean, cov = ci.draw_moments(testviews.draws(x.spark, x.sf_dir).select(F.slice("beta", 2, 30).alias("beta")))
    design = de.Design(SMOOTH_SPEC, info)
    to_beta = np.zeros((design.p, 30))
    for i, (v, (a, b)) in enumerate(zip(("int_mid", "Age", "BMI"), design.spans.values())):
        to_beta[a:b, 10 * i:10 * i + 10] = de.centring(np.array(info.means[v])).T
    model = mo.PamModel("given", SMOOTH_SPEC, info, to_beta @ mean, to_beta @ cov @ to_beta.T)
    tables = [ef.smooth_table(model, x.spark, v) for v in ("int_mid", "Age", "BMI")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _reread_predictor(x: Inputs) -> DataFrame:
    """The linear predictor of a model that was saved and loaded again."""
    path = f"{checkpoint_folder(x.spark)}/model-{uuid.uuid4().hex}"
    mo.save_model(_given_model(x), x.spark, path)
    return _predictor_summary(x, mo.load_model(x.spark, path))


def _reread_life_table(x: Inputs) -> DataFrame:
    """The life table per admission category, written as one CSV per category with a byte order mark and read again."""
    folder = f"{checkpoint_folder(x.spark)}/csv-{uuid.uuid4().hex}"
    tables = pe.as_ped(x.fitted, from_day=5, keep=["AdmCatID"]).groupBy("AdmCatID", "tend").agg(
        F.count(F.lit(1)).alias("at_risk"), F.sum("ped_status_1").alias("dying"))
    write_csv_per_group(tables, folder, "AdmCatID", excel=True)
    back = x.spark.read.option("header", True).csv(folder)
    marked = back.toDF(*[c.lstrip("\ufeff") for c in back.columns])
    return marked.select("AdmCatID", F.col("tend").cast("int").alias("tend"),
                         F.col("at_risk").cast("bigint").alias("at_risk"), F.col("dying").cast("bigint").alias("dying"))


def exposure_queries() -> dict[str, Callable[[Inputs], DataFrame]]:
    return {
        "lag_lead_at_risk": _lag_lead_at_risk,
        "diary_window": _diary_text,
        "nested_diary": _nested_text,
        "overlong_diaries": lambda x: ex.overlong_diaries(
            testviews.line_items(x.spark, x.sf_dir), key="l_orderkey"),
        "cumulative_exposure": _cumulative_exposure,
        "effective_exposure": _effective_exposure,
        "protocol_frames": _protocol_frames,
        "bspline_basis": _bspline_basis,
        "tensor_exposure": _tensor_exposure,
        "design_sums": _design_sums,
        "compressed_design": lambda x: pe.compress(ped(x, ["AdmCatID", "Gender"]), ["AdmCatID", "Gender", "tend"]),
        "linear_predictor_given": _linear_predictor,
        "linear_predictor_reread": _reread_predictor,
        "life_table_reread": _reread_life_table,
        "smooth_given": _smooth_given,
        "unit_quantiles_given": _unit_quantiles,
        "six_comparisons_given": _effects_given,
        "hr_table_given": lambda x: ef.hr_table(_effects_given(x)).select("comparison", "tend", "fit", "CI"),
        "hr_extremes_given": lambda x: ef.hr_extremes(_effects_given(x)).select(
            "comparison", "extreme", "tend", "fit", "se"),
        "cause_hazards_given": lambda x: _hazards_given(x).drop("intlen"),
        "all_cause_hazard_given": lambda x: _hazards_given(x).groupBy("protocol", "tend").agg(
            F.count(F.lit(1)).alias("n_draws"), F.avg(F.col("death") + F.col("extubation")).alias("hazard")),
        "cif_given": _curves_given,
        "cif_band_given": _cif_band_given,
        "poisson_rates_closed_form": _closed_form_rates,
        "coef_table_closed_form": _closed_form_coefficients,
        "coefficients_without": _coefficients_without,
        "compressed_fit": _compressed_fit,
        "fit_calibration": _fit_calibration,
    }


# ---- fitted models: no closed form; what every fit must meet, and rows only ----------------------

_FITS: dict[tuple[str, str, str], tuple] = {}


def _fitted_once(x: Inputs, kind: str, fit) -> tuple:
    """Subjects and models of a table folder, fitted once per application whichever queries ask for them."""
    key = (x.spark.sparkContext.applicationId, x.sf_dir, kind)
    if key not in _FITS:
        known = [found[0] for k, found in _FITS.items() if k[:2] == key[:2]]
        subjects = known[0] if known else an.study_subjects(x.patient, x.daily)
        _FITS[key] = subjects, fit(subjects, an.study_spec(subjects))
    return _FITS[key]


def _main_models(x: Inputs):
    return _fitted_once(x, "main", an.fit_main)


def _subgroup_models(x: Inputs):
    """Every stratum on its own knots."""
    return _fitted_once(x, "subgroups", an.fit_subgroups)


def _scores(subjects: DataFrame, models: dict[str, mo.PamModel], events, strata: Mapping[str, Column], of) -> DataFrame:
    """Score equations of all models from the rows at risk, which are generated once; ``of`` names a model's stratum."""
    checks = [ef.Check(m, f"ped_{events(n)}", of(n) and f"in_{of(n)}") for n, m in models.items()]
    marked = subjects.withColumns({f"in_{s}": rule.cast("int") for s, rule in strata.items()})
    parts = ef.scoring_parts(marked, checks)  # dealt after the units are met, so that no unit stays in one task
    rows = pe.as_ped(_spread(parts), status={f"ped_{e}": e for e in dict.fromkeys(map(events, models))}, from_day=5,
                     keep=["_parts", "_unit"])
    found = ef.score_equations_of(checks, rows)
    return found.select("model", "term", "n", F.round(F.abs("score"), 2).alias("score"))


def _score_equations(x: Inputs) -> DataFrame:
    """Estimated fits of the four main models, checked row by row."""
    subjects, models = _main_models(x)
    causes = dict(an.CAUSES)
    return _scores(subjects, models, lambda n: n.replace(n.split("_")[-1], causes[n.split("_")[-1]]), {}, lambda n: None)


def _score_equations_subgroups(x: Inputs) -> DataFrame:
    subjects, models = _subgroup_models(x)
    causes, rules = dict(an.CAUSES), {g.name: g.rule for g in an.subgroups()}
    return _scores(subjects, models, lambda n: causes[n.split("_")[1]], rules, lambda n: n.split("_")[0])


def _cif_invariants(x: Inputs) -> DataFrame:
    """Points of the simulated incidence curves, and those that no incidence can have."""
    subjects, models = _main_models(x)
    pair = [models["death"], models["extubation"]]
    draws = [ci.posterior_draws(m, x.spark, 500, 1 + i) for i, m in enumerate(pair)]
    return ci.broken_curves(ci.cif_curves(draws, pair, an.diet_frames(subjects)))


DRAW_SEED = 7


def _posterior_draws_given(x: Inputs) -> DataFrame:
    """Draws of a model whose covariance has a given root: the spread of the given vectors, neighbours correlated."""
    given = _given_model(x)
    spread = np.sqrt(np.diag(given.cov))
    root = np.diag(spread) + np.diag(0.5 * spread[1:], -1)
    model = mo.PamModel("given", given.spec, given.info, given.beta, root @ root.T)
    draws = ci.posterior_draws(model, x.spark, 500, DRAW_SEED)
    return draws.select("sim_id", F.posexplode("beta").alias("place", "beta"))


def _fit_summary(x: Inputs, models) -> DataFrame:
    rows = [(n, float(m.stats["events"]), float(m.stats["edf"]), int(m.stats["passes"]), bool(m.stats["converged"]))
            for n, m in models.items()]
    return x.spark.createDataFrame(
        rows, "model string, events double, edf double, passes int, converged boolean")


def _fit_main(x: Inputs) -> DataFrame:
    _, models = _main_models(x)
    return ef.coef_table(list(models.values()), x.spark, labelled=False)


def _fit_subgroups(x: Inputs) -> DataFrame:
    return _fit_summary(x, _subgroup_models(x)[1])


def _fit_edf(x: Inputs) -> DataFrame:
    return ef.edf_table([*_main_models(x)[1].values(), *_subgroup_models(x)[1].values()], x.spark)


def _six_comparisons_fit(x: Inputs) -> DataFrame:
    subjects, models = _main_models(x)
    return an.compare_diets(models, an.diet_frames(subjects))


def _smooth_table(x: Inputs) -> DataFrame:
    _, models = _main_models(x)
    return re_.bind_named({f"{n}:{v}": ef.smooth_table(models[n], x.spark, v)
                           for n in ("death", "extubation") for v in ("int_mid", "Age", "BMI")}, "model")


def _group_effect_qq(x: Inputs) -> DataFrame:
    _, models = _main_models(x)
    return re_.bind_named({n: ef.group_effect_qq(models[n]) for n in ("death", "extubation")}, "model")


def _cif_simulated(x: Inputs) -> DataFrame:
    subjects, models = _main_models(x)
    return an.incidence(models["death"], models["extubation"], an.diet_frames(subjects))


def fitted_queries() -> dict[str, Callable[[Inputs], DataFrame]]:
    return {
        "fit_main": _fit_main,
        "fit_subgroups": _fit_subgroups,
        "six_comparisons_fit": _six_comparisons_fit,
        "smooth_table": _smooth_table,
        "group_effect_qq": _group_effect_qq,
        "cif_simulated": _cif_simulated,
        "fit_edf": _fit_edf,
        "score_equations": _score_equations,
        "score_equations_subgroups": _score_equations_subgroups,
        "cif_invariants": _cif_invariants,
        "posterior_draws_given": _posterior_draws_given,
    }


def registered() -> dict[str, Query]:
    def bind(fn):
        return lambda spark, sf_dir: rounded(fn(Inputs(spark, sf_dir)))
    every = {**relational_queries(), **exposure_queries(), **fitted_queries()}
    return {name: bind(fn) for name, fn in every.items()}
