import pytest
from pyspark.sql import functions as F

from pamspark.operators import cohort as co
from pamspark.sources.schemas import DAILY, PATIENT, require_columns, require_schema

# mv, disc, surv -> status, time (None: no status)
CASES = [
    (10, 20, 61, 1, 10), (60, 60, 61, 0, 61), (20, 15, 61, 0, 61), (12, None, 12, 2, 12),
    (15, None, 12, 2, 12), (8, None, 12, 1, 8), (12, 12, 12, 1, 12), (5, None, None, None, None),
    (60, None, None, 0, 61),
]


def table(spark, rows):
    return spark.createDataFrame(
        [(i, *r[:3]) for i, r in enumerate(rows)],
        "CombinedID bigint, DaysMechVent bigint, Disc0To60 bigint, Surv0To60 bigint")


def test_status_micro_cases(spark):
    got = {r.CombinedID: r for r in co.competing_status(table(spark, CASES)).collect()}
    for i, (_, _, _, status, time) in enumerate(CASES):
        assert (got[i].mv_status, got[i].event_time) == (status, time)
        assert got[i].delta_1 == (None if status is None else int(status == 2))
        assert got[i].delta_2 == (None if status is None else int(status == 1))


def test_unknown_status_is_dropped_and_counted(spark):
    df = table(spark, CASES)
    known = [c for c in CASES if c[3] is not None]
    assert co.build_cohort(df).count() == len(known)
    assert co.unknown_status_count(df).first().n_unknown == 1
    same = co.competing_status(df).withColumn("k", co.status_known())
    assert same.where(F.col("k") != F.col("mv_status").isNotNull()).count() == 0


def test_zero_or_missing_ventilation_is_filtered(spark):
    assert co.ventilated(table(spark, [(0, 1, 1), (None, 1, 1), (2, 1, 1)])).count() == 1


def test_reclassification(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, 12, 0, 1, 10), (2, 1, 10, 13, 0, 1, 10), (3, 0, 10, 11, 0, 1, 10), (4, None, 10, 11, 0, 1, 10)],
        "CombinedID bigint, PatientDied int, DaysMechVent bigint, Surv0To60 bigint, delta_1 int, delta_2 int, event_time bigint")
    one = co.reclassify_early_death(df).orderBy("CombinedID").collect()
    assert [(r.delta_1, r.delta_2, r.event_time) for r in one] == [(1, 0, 10), (0, 1, 10), (0, 1, 10), (0, 1, 10)]
    two = co.reclassify_early_death_by_union(df).select(df.columns).orderBy("CombinedID").collect()
    assert one == two


def test_classes_put_edges_and_missing_where_they_belong(spark):
    df = spark.createDataFrame([(18.4, 0), (18.5, 1), (30.0, 2), (30.1, 3), (None, None)], "BMI double, PN2_4 bigint")
    got = co.with_strata(df).collect()
    assert [r.bmi_cat for r in got] == ["bmi<18.5", "bmi18.5-30", "bmi18.5-30", "bmi>30", "bmi18.5-30"]
    assert [r.pn_bin for r in got] == ["pn01", "pn01", "pn23", "pn23", "pn23"]


def test_subgroup_restricts_the_diary(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "CombinedID bigint, g string")
    days = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "CombinedID bigint, Study_Day int")
    chosen, kept = co.subgroup(df, F.col("g") == "a", days)
    assert chosen.count() == 1 and kept.count() == 2


def test_schema_checks(inputs):
    require_schema(inputs.patient, PATIENT, "patient")
    require_schema(inputs.daily, DAILY, "daily")
    with pytest.raises(ValueError, match="nope"):
        require_columns(inputs.daily, ["nope"], "daily")
    with pytest.raises(ValueError, match="wrong type"):
        require_schema(inputs.daily.withColumn("EN", F.col("EN").cast("string")), DAILY)


def test_fitted_subjects_equal_the_subjects_of_the_rows(inputs):
    from pamspark.operators import ped as pe
    rows = pe.as_ped(co.keep_known(inputs.cohort, inputs.diary_ids, co.KEY), keep=[co.KEY]).where(F.col("tend") >= 5)
    a = {r[0] for r in rows.select(co.KEY).distinct().collect()}
    b = {r[0] for r in inputs.fitted.select(co.KEY).collect()}
    assert a == b and a
