"""The whole study: cohort to fitted models, diet comparisons, incidence curves and report files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cif as ci
from ..operators import cohort as co
from ..operators import effects as ef
from ..operators import exposure as ex
from ..operators import ped as pe
from ..operators import tables as tb
from ..operators.design import FACTORS, BasisInfo, PamSpec, main_spec, observed_levels
from ..operators.fit import Task, fit_many, subject_blocks
from ..operators.model import PamModel, save_model
from ..sources.io import cut_lineage, write_csv, write_csv_per_group, write_table

CAUSES = (("death", "delta_1"), ("extubation", "delta_2"))
EVENT_LIST = [c for _, c in CAUSES]


@dataclass(frozen=True)
class Subgroup:
    """A stratum that gets models of its own, and the covariates its models leave out."""

    name: str
    rule: Column
    without: tuple[str, ...]


def subgroups() -> list[Subgroup]:
    """The eight strata: admission category, BMI class, parenteral nutrition."""
    adm, bmi, pn = F.col("AdmCatID"), F.col("bmi_cat"), F.col("pn_bin")
    return [
        Subgroup("medical", adm == "Medical", ("AdmCatID",)),
        Subgroup("elective", adm == "Surgical/Elective", ("AdmCatID",)),
        Subgroup("emergency", adm == "Surgical/Emeregency", ("AdmCatID",)),
        Subgroup("bmi1", bmi == "bmi<18.5", ("BMI", "AdmCatID")),
        Subgroup("bmi2", bmi == "bmi18.5-30", ("BMI", "AdmCatID")),
        Subgroup("bmi3", bmi == "bmi>30", ("BMI", "AdmCatID")),
        Subgroup("pn01", pn == "pn01", ("PN2_4", "AdmCatID")),
        Subgroup("pn23", pn == "pn23", ("PN2_4", "AdmCatID")),
    ]


def study_subjects(patient: DataFrame, daily: DataFrame) -> DataFrame:
    """Every fitted subject once, with window, strata and both event definitions, written out for reuse.

    All 20 models read this one table.
    """
    at_risk = co.build_cohort(patient).where(F.col("event_time") > 4)
    subjects = co.with_strata(ex.with_window(at_risk, ex.diary_window(daily)))
    early = co.early_death()
    return cut_lineage(subjects.withColumns({
        "sens_delta_1": F.when(early, 1).otherwise(F.col("delta_1")),
        "sens_delta_2": F.when(early, 0).otherwise(F.col("delta_2"))}))


def study_spec(subjects: DataFrame) -> PamSpec:
    return main_spec(observed_levels(subjects, FACTORS))


def fit_main(subjects: DataFrame, spec: PamSpec, **options) -> dict[str, PamModel]:
    """Both causes, and both again with early deaths after weaning counted as deaths: one set of passes."""
    tasks = [Task(name, col, spec) for name, col in CAUSES]
    tasks += [Task(f"sens_{name}", f"sens_{col}", spec) for name, col in CAUSES]
    return fit_many(subject_blocks(subjects), tasks, **options)


def fit_subgroups(subjects: DataFrame, spec: PamSpec, groups: Sequence[Subgroup] | None = None,
                  shared_basis: BasisInfo | None = None, **options) -> dict[str, PamModel]:
    """Both causes in every stratum, all fitted in one set of passes.

    By default each stratum takes its spline ranges and centring from its own subjects; with ``shared_basis`` all
    strata use the given one.
    """
    tasks = [Task(f"{g.name}_{name}", col, spec.without(*g.without), g.rule, own_basis=shared_basis is None)
             for g in (subgroups() if groups is None else groups) for name, col in CAUSES]
    return fit_many(subject_blocks(subjects), tasks, info=shared_basis, spec=spec, **options)


def diet_frames(subjects: DataFrame) -> DataFrame:
    """The first subject under the five diets; its number of rows is fixed."""
    keep = [c for c in subjects.columns if not c.startswith("sens_")]
    return ex.protocol_frames(ex.template_subjects(subjects.select(*keep)), ex.schemes(subjects.sparkSession))


def compare_diets(models: Mapping[str, PamModel], frames: DataFrame) -> DataFrame:
    """Hazard ratios of the six comparisons for several models, with the model's name as a column."""
    out = None
    for name, m in models.items():
        one = ef.six_comparisons(m, frames).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def incidence(death: PamModel, extubation: PamModel, frames: DataFrame, n_sim: int = 500,
              seed: int = 1) -> DataFrame:
    """Cumulative incidence of both causes per diet with quantile bands, arranged by comparison."""
    spark = frames.sparkSession
    draws = [ci.posterior_draws(m, spark, n_sim, seed + i) for i, m in enumerate((death, extubation))]
    curves = ci.cif_curves(draws, [death, extubation], frames)
    return ci.paired_bands(ci.cif_band(curves, few_draws=True), ex.comparisons(spark), ex.schemes(spark))


def ordered_bands(bands: DataFrame, lettered: bool = False) -> DataFrame:
    """Incidence bands with the order of comparisons and diets as numbers from 1, for sorting and plotting.

    ``lettered`` puts the comparison's letter before its text, ``A: exclusively low vs. late standard``.
    """
    letters, labels = [c for c, _, _ in ex.COMPARISONS], [lab for _, lab, _, _ in ex.SCHEMES]

    def place(col, values):
        return F.array_position(F.array(*map(F.lit, values)), F.col(col)).cast("int")

    out = bands.withColumns({"comparison_ord": place("comparison", letters), "label_ord": place("label", labels)})
    text = F.concat(F.col("comparison"), F.lit(": "), F.col("comparison_text"))
    return out.withColumn("comparison_text", text) if lettered else out


def model_reports(models: Mapping[str, PamModel], effects: DataFrame) -> dict[str, DataFrame]:
    """Coefficient tables, smooths and hazard-ratio extremes of all models, by file name."""
    spark = effects.sparkSession
    every = list(models.values())
    smooths = None
    for name, m in models.items():
        for v in ("int_mid", *m.spec.time_smooths):
            one = ef.smooth_table(m, spark, v).withColumn("model", F.lit(name))
            smooths = one if smooths is None else smooths.unionByName(one)
    ends = None
    for name in models:
        one = ef.hr_extremes(effects.where(F.col("model") == name))
        ends = one if ends is None else ends.unionByName(one)
    return {"coefficients-categorical": ef.coef_table(every, spark, exclude=ef.METRIC_TERMS),
            "coefficients-metric": ef.coef_table(every, spark, exclude=ef.CATEGORICAL_TERMS),
            "smooths": smooths, "hazard-ratio-extremes": ends}


def cohort_reports(patient: DataFrame, daily: DataFrame, subjects: DataFrame) -> dict[str, DataFrame]:
    """Descriptive tables of the fitted subjects and their diaries, by file name.

    Durations of the weaned cover the days in intensive care where the patient table has them.
    """
    last = pe.last_intervals(subjects, keep=[c for c in subjects.columns if c not in ("event_time", *EVENT_LIST)])
    spans = [c for c in ("DaysMechVent", "DaysInICU", "event") if c in subjects.columns]
    return {"study-flow": tb.study_flow(patient, subjects),
            "durations-extubated": tb.extubated_durations(subjects, spans),
            "time-to-death": tb.time_to_event_summary(last),
            "baseline": tb.baseline_table(subjects),
            "last-interval-mortality": tb.last_interval_rates(last),
            "strata-pn": tb.stratified_table(last, "pn_bin"),
            "strata-bmi": tb.stratified_table(last, "bmi_cat"),
            **{f"cases-{v}": tb.subgroup_cases(last, v) for v in ("AdmCatID", "bmi_cat", "pn_bin")},
            "diet-days": tb.diet_days(daily, subjects), "en-share": tb.en_share(daily),
            "low-intake": tb.low_intake_subjects(daily, subjects), "intake-bands": tb.intake_bands(daily),
            "days-beyond-window": ex.overlong_diaries(daily)}


def write_study(patient: DataFrame, daily: DataFrame, folder: str, merged: DataFrame | None = None,
                with_subgroups: bool = True, n_sim: int = 500, **options) -> dict[str, PamModel]:
    """Run the study and write its tables, models and reports below ``folder``."""
    subjects = study_subjects(patient, daily)
    spec = study_spec(subjects)
    ids = subjects.select(co.KEY)
    for name, df in (("patient", patient), ("daily", daily), ("mergedData", merged)):
        if df is not None:
            write_table(df.join(ids, co.KEY, "left_semi"), f"{folder}/data/{name}")
    write_table(pe.as_ped(subjects, from_day=5, keep=[co.KEY, *spec.covariates, "CombinedicuID"]),
                f"{folder}/data/ped")

    models = fit_main(subjects, spec, **options)
    if with_subgroups:
        models.update(fit_subgroups(subjects, spec, **options))
    spark = patient.sparkSession
    for name, m in models.items():
        save_model(m, spark, f"{folder}/models/{name}")

    frames = cut_lineage(diet_frames(subjects))
    effects = cut_lineage(compare_diets(models, frames))
    for name in models:
        mine = ef.hr_table(effects.where(F.col("model") == name)).drop("model", "comparison")
        write_csv_per_group(mine, f"{folder}/results/hazard-ratios-{name}", "name", excel=True)
    for label, prefix in (("", ""), ("sens-", "sens_")):
        bands = incidence(models[f"{prefix}death"], models[f"{prefix}extubation"], frames, n_sim)
        write_table(ordered_bands(bands, lettered=bool(prefix)), f"{folder}/results/{label}incidence")
        events = subjects.withColumns({c: F.col(f"{prefix}{c}") for c in EVENT_LIST})
        write_csv(tb.life_table_from_cohort(events).orderBy("tend"),
                  f"{folder}/results/{label}events-per-interval", single_file=True, excel=True)
    kept = daily.join(ids, co.KEY, "left_semi")
    for name, report in {**model_reports(models, effects), **cohort_reports(patient, kept, subjects)}.items():
        write_csv(report, f"{folder}/results/{name}", single_file=True)
    for name, m in models.items():
        if m.groups is not None:
            write_table(ef.group_effect_qq(m), f"{folder}/results/unit-quantiles/{name}")
    return models
