import numpy as np
from pyspark.sql import functions as F

from pamspark.operators import exposure as ex
from pamspark.operators import ped as pe


def diary(spark, days):
    return spark.createDataFrame([(i, d, c2, c3) for i, rows in days.items() for d, c2, c3 in rows],
                                 "CombinedID bigint, Study_Day int, proteinCat2 int, proteinCat3 int")


def test_lag_lead_micro_cases(spark):
    ll = {}
    for r in ex.lag_lead(spark).collect():
        ll.setdefault(r.t, set())
        if r.LL:
            ll[r.t].add(r.tz)
    assert ll[5] == {1} and ll[13] == set(range(1, 10)) and ll[14] == set(range(2, 11)) and ll[43] == {11}
    assert not any(ll[t] for t in range(44, 61)) and sum(map(len, ll.values())) == 209
    assert len(ll) == 61


def test_lag_lead_takes_any_predicate(spark):
    ll = ex.lag_lead(spark, range(3), range(1, 3), lambda t, tz: t >= tz)
    assert ll.agg(F.sum("LL")).first()[0] == 3


def test_short_overlong_and_unordered_diaries(spark):
    d = diary(spark, {1: [(3, 1, 0), (1, 0, 1), (2, 1, 0)], 2: [(i, 1, 0) for i in range(13, 0, -1)]})
    got = {r.CombinedID: r for r in ex.diary_window(d.repartition(5)).collect()}
    assert got[1].n_days == 3 and got[1].proteinCat2 == [0, 1, 1] + [0] * 8 and got[1].proteinCat3 == [1] + [0] * 10
    assert got[2].n_days == 11 and got[2].proteinCat2 == [1.0] * 11
    cut = ex.overlong_diaries(d).first()
    assert (cut.n_subjects, cut.n_rows_cut) == (1, 2)


def test_window_limits_rows_before_the_shuffle(inputs):
    from pamspark.sources.io import cut_lineage
    stored = cut_lineage(inputs.daily)  # the view numbers days by a window of its own, a diary has them stored
    plan = ex.diary_window(stored)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_subject_with_most_of_the_diary(spark):
    rows = spark.range(30000).select(F.lit(7).cast("bigint").alias("CombinedID"), (F.col("id") + 1).cast("int").alias("Study_Day"),
                                     (F.col("id") % 2).cast("int").alias("proteinCat2"), F.lit(0).alias("proteinCat3"))
    r = ex.diary_window(rows).first()
    assert r.n_days == 11 and r.proteinCat2 == [float(i % 2) for i in range(11)]


def test_cumulative_exposure_arrays(spark):
    c = spark.createDataFrame([(1, 20, 0, 0), (2, 20, 0, 0), (3, 20, 0, 0)],
                              "CombinedID bigint, event_time bigint, delta_1 int, delta_2 int")
    w = ex.diary_window(diary(spark, {1: [(1, 1, 0), (2, 0, 1)], 2: [(i, 1, 0) for i in range(1, 12)]}))
    rows = ex.add_cumulative_exposure(pe.as_ped(
        ex.with_window(c, w), from_day=5, keep=["CombinedID", "n_days", "proteinCat2", "proteinCat3"]))
    r = rows.where("CombinedID = 1 and tend = 14").first()
    assert r.t == [13.5, 13.5] + [0.0] * 9 and r.tz == [2.0, 3.0] + [0.0] * 9
    assert r.LL == [0.0] + [1.0] * 9 + [0.0]
    assert rows.where("CombinedID = 3").count() == 0
    e = rows.select("CombinedID", "tend", ex.effective_exposure(F.col("tend"), "proteinCat2").alias("e"))
    got = {(x.CombinedID, x.tend): x.e for x in e.collect()}
    for tend in range(5, 21):
        assert got[(2, tend)] == sum(tend >= d + 4 and tend <= 3 * d + 10 for d in range(1, 12))


def test_summed_windows_equal_the_rows(inputs):
    e = inputs.exposed
    a = ex.window_sums_at_risk(e).orderBy("tend").collect()
    rows = pe.as_ped(e, from_day=5, keep=["proteinCat2", "proteinCat3"])
    b = rows.groupBy("tend").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(v)[d]).alias(f"{v}{d}") for v in ("proteinCat2", "proteinCat3") for d in range(11)]).orderBy("tend").collect()
    assert [r.n_rows for r in a] == [r.n for r in b]
    for x, y in zip(a, b):
        assert np.allclose(x.proteinCat2 + x.proteinCat3, list(y)[2:])


def test_protocol_frames(inputs, spark):
    frames = ex.protocol_frames(ex.template_subjects(inputs.fitted), ex.schemes(spark))
    assert frames.count() == 5 * 56
    r = frames.agg(F.min("tend"), F.max("tend"), F.max("icuByDummy"), F.countDistinct("CombinedID")).first()
    assert list(r) == [5, 60, 0, 1]
    first = inputs.fitted.agg(F.min("CombinedID")).first()[0]
    assert frames.first().CombinedID == first


def test_scheme_table(spark):
    rows = {(r.comparison, r.variable, r.te): (r.value, r.code, r.label) for r in ex.scheme_table(spark).collect()}
    assert len(rows) == 6 * 2 * 11
    assert rows[("A", "p2", 4)] == ("< 0.8 g/kg", 0.49, "late standard")
    assert rows[("A", "p2", 5)] == ("0.8 - 1.2 g/kg", 0.99, "late standard")
    assert rows[("D", "p2", 11)] == ("> 1.2 g/kg", 1.41, "late high")
    assert [r.name for r in ex.comparisons(spark).orderBy("comparison").collect()][0] == "exclusively low vs. late standard"


def test_nested_diary_is_sorted(spark):
    d = diary(spark, {1: [(3, 1, 0), (1, 0, 1), (2, 1, 0)]})
    r = ex.nested_diary(d, ["proteinCat3"]).first()
    assert [(x.day, x.proteinCat3) for x in r.diary] == [(1, 1), (2, 0), (3, 0)]


def test_long_nested_diaries_come_in_pieces(spark):
    d = diary(spark, {1: [(i, i % 2, 0) for i in range(1, 24)]})
    rows = ex.nested_diary(d, ["proteinCat2"], piece_days=10).orderBy("piece").collect()
    assert [len(r.diary) for r in rows] == [10, 10, 3] and [x.day for r in rows for x in r.diary] == list(range(1, 24))


def test_a_hot_subject_is_numbered_in_many_tasks(spark):
    """A subject with a third of all rows, some days twice, null days and a null subject: places are as a plain sort gives them."""
    rows = [(1, i if i % 7 else None, i % 3) for i in range(6_000)] + [(1, 5, 1)] * 5
    rows += [(2 + i // 4, i % 4, i) for i in range(12_000)] + [(None, i, i) for i in range(3)]
    daily = spark.createDataFrame(rows, "CombinedID long, Study_Day int, v int")
    segments = 16
    found = ex.numbered_days(daily, segments=segments)
    by = {}
    for r in found.collect():
        by.setdefault(r.CombinedID, []).append((r._pos, r.Study_Day))
    assert sum(map(len, by.values())) == len(rows) and len(by) == len({r[0] for r in rows})
    for days in by.values():
        days.sort(key=lambda d: d[0])
        assert [p for p, _ in days] == list(range(1, len(days) + 1))
        assert [d for _, d in days] == sorted((d for _, d in days), key=lambda d: (d is not None, d or 0))
    spread = daily.withColumn("_tie", F.xxhash64(*daily.columns)).repartitionByRange(segments, "CombinedID", "Study_Day", "_tie")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * len(rows) / segments
    pieces = ex.nested_diary(daily, ["v"], piece_days=1000, segments=segments).where("CombinedID = 1").orderBy("piece").collect()
    assert [len(r.diary) for r in pieces] == [1000] * 6 + [5]
    assert [d.day for r in pieces for d in r.diary] == list(range(1, 6_006))
