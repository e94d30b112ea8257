import math

import pytest
from pyspark.sql import functions as F

from pamspark.operators import ped as pe
from pamspark.operators import relational as re_
from pamspark.operators import tables as tb


def cohort(spark, rows):
    return spark.createDataFrame([(i, float(t), d, 0) for i, (t, d) in enumerate(rows)],
                                 "CombinedID bigint, event_time double, delta_1 int, delta_2 int")


@pytest.mark.parametrize("time,delta,want", [
    (4, 1, []), (5, 1, [(5, 1, 0.0)]), (6, 1, [(5, 0, 0.0), (6, 1, 0.0)]),
    (5.5, 1, [(5, 0, 0.0), (6, 1, math.log(0.5))]), (61, 0, [(d, 0, 0.0) for d in range(5, 61)]),
    (60, 1, [(d, int(d == 60), 0.0) for d in range(5, 61)]),
])
def test_delayed_entry_rows(spark, time, delta, want):
    rows = pe.as_ped(cohort(spark, [(time, delta)]), from_day=5).orderBy("tend").collect()
    assert [(r.tend, r.ped_status_1) for r in rows] == [(d, s) for d, s, _ in want]
    assert [r.offset for r in rows] == pytest.approx([o for _, _, o in want])
    assert all(r.tstart == r.tend - 1 and r.int_mid == r.tend - 0.5 for r in rows)
    assert all(r.interval_label == f"({r.tstart},{r.tend}]" for r in rows)


def test_uneven_cuts(spark):
    rows = pe.as_ped(cohort(spark, [(9, 1)]), cuts=[0, 2, 7, 30]).orderBy("tend").collect()
    assert [(r.tstart, r.tend, r.ped_status_1) for r in rows] == [(0, 2, 0), (2, 7, 0), (7, 30, 1)]
    assert [math.exp(r.offset) for r in rows] == pytest.approx([2, 5, 2])
    late = pe.as_ped(cohort(spark, [(9, 1)]), cuts=[0, 2, 7, 30], from_day=7).orderBy("tend").collect()
    assert [r.tend for r in late] == [7, 30]


def test_sums_match_events_and_person_time(inputs):
    c = inputs.cohort
    ped = pe.as_ped(c)
    got = pe.person_time(ped).first()
    want = c.agg(F.sum(F.least("event_time", F.lit(60))).alias("t"),
                 F.sum(F.when(F.col("event_time") <= 60, F.col("delta_1"))).alias("d")).first()
    assert got.person_time == pytest.approx(want.t) and got.ped_status_1 == want.d


def test_last_intervals_equal_the_last_generated_rows(inputs):
    rows = pe.as_ped(inputs.fitted, from_day=5)
    cols = ["CombinedID", "tend", "ped_status_1", "ped_status_2"]
    a = re_.last_per_group(rows, "CombinedID", "tend").select(cols)
    b = pe.last_intervals(inputs.fitted).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_life_table_without_rows_equals_the_one_from_rows(spark):
    c = cohort(spark, [(5.5, 1), (7, 1), (7, 0), (61, 0), (4, 1), (12.25, 1), (60, 1)])
    a = tb.life_table(pe.as_ped(c, from_day=5)).orderBy("tend").collect()
    b = tb.life_table_from_cohort(c).orderBy("tend").collect()
    assert a == b


def test_compress_keeps_the_totals(inputs):
    rows = pe.as_ped(inputs.fitted, from_day=5, keep=["Gender"])
    a = pe.compress(rows, ["Gender", "tend"]).agg(F.sum("exposure").alias("t"), F.sum("ped_status_2").alias("e")).first()
    b = pe.person_time(rows).first()
    assert (a.t, a.e) == (b.person_time, b.ped_status_2)


def test_bounds_are_inside_the_generator(inputs):
    plan = pe.as_ped(inputs.fitted, from_day=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(5" in plan
    top = plan[:plan.index("Generate")]
    assert "Filter" not in top
