import numpy as np
import pytest
from pyspark.sql import functions as F

from pamspark.functions import quantiles as qu
from pamspark.functions import scalars as sc
from pamspark.operators import relational as re_
from pamspark.operators import tables as tb
from pamspark.sources.io import cut_lineage


def test_exact_quantiles_on_skewed_strata(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": np.exp(3 * rng.standard_normal(20000)), "ties": np.repeat([1.0, 2.0], [999, 2]),
              "one": np.array([5.0]), None: rng.integers(0, 5, 100).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {r.g: r for r in qu.exact_quantiles(df, ["g"], ["v"], probs).collect()}
    for g, vs in groups.items():
        assert [got[g][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12)
    few = {r.g: r for r in qu.exact_quantiles(df, ["g"], ["v"], [0.5], bins=4).collect()}
    assert few["hot"].q0 == pytest.approx(np.median(groups["hot"]))
    six = {r.g: r for r in qu.six_number_summary(df, ["g"], ["v"]).collect()}
    assert six["hot"].n_missing == 1 and six["hot"].mean_value == pytest.approx(groups["hot"].mean())
    assert six["empty"].n == 0 and six["empty"].median_value is None


def test_quantiles_select_until_bins_are_small(spark):
    """A million distinct values, one of them in a third of all rows: what is ordered at last are a few small bins."""
    n, probs = 1_000_000, [0.0, 0.1, 0.5, 0.9999, 1.0]
    values = F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.exp(F.col("id") / n * 20) * F.when(F.col("id") % 2 == 0, -1).otherwise(1))
    df = spark.range(n * 3 // 2).select(F.lit("all").alias("g"), values.alias("v"))
    hist = cut_lineage(qu.value_counts(df, ["g"], ["v"]))
    rows, group = qu.wanted_bins(hist, ["g", "variable"], probs)
    sizes = [r["count"] for r in rows.groupBy(*group).count().collect()]
    assert group[-1] == "bin1" and len(sizes) <= 2 * len(probs) and max(sizes) <= qu.IN_ONE_BIN
    want = np.quantile(df.select("v").toPandas()["v"].to_numpy(), probs)
    one = qu.exact_quantiles(df, ["g"], ["v"], probs).first()
    assert [one[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want), rel=1e-12)
    deep = qu.exact_quantiles(df.limit(2_000), ["g"], ["v"], [0.3], bins=2, in_one_bin=5).first()
    assert deep.q0 == pytest.approx(np.quantile(df.limit(2_000).toPandas()["v"], 0.3), rel=1e-12)
    none = qu.exact_quantiles(df.limit(0), ["g"], ["v"], probs)
    assert none.count() == 0


def test_global_rank(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(5000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    got = {r.v: r["rank"] for r in qu.global_rank(df, "v").collect()}
    assert [got[x] for x in np.sort(v)] == list(range(1, 5001))


def test_cut_and_frequency(spark):
    df = spark.createDataFrame([(0,), (24,), (25,), (48,), (49,), (None,)], "h int")
    lab = re_.cut_labels(F.col("h"), [0, 24, 48, None], ["[0,24]", "(24,48]", "(48,max]"])
    got = [r[0] for r in df.select(lab).collect()]
    assert got == ["[0,24]", "[0,24]", "(24,48]", "(24,48]", "(48,max]", None]
    f = {r.h: r.n for r in re_.frequency(df, "h", [0, 7]).collect()}
    assert f == {0: 1, 7: 0}


def test_stratum_rates_keep_missing_levels_in_the_denominator(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), (None, 1)], "s string, o int")
    got = {r.level: (r.n, r.percent, r.outcome_percent) for r in re_.stratum_rates(df, ["s"], "o").collect()}
    assert got == {"a": (2, 50.0, 50.0), "b": (1, 25.0, 0.0)}


def test_joins_and_exclusions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10)], "k int, w int")
    assert {r.v for r in re_.drop_known(a, b, "k").collect()} == {"y", "z"}
    assert {r.v for r in re_.keep_known(a, b, "k").collect()} == {"x"}
    assert re_.natural_left_join(a, b).count() == 3
    terms = spark.createDataFrame([("ApacheIIScore",), ("ApacheIIScore:int_mid",), ("GenderMale",)], "term string")
    assert re_.exclude_names(terms, "term", ["PN2_4"]).count() == 3
    assert [r.term for r in re_.exclude_names(terms, "term", ["ApacheIIScore", "PN2_4"]).collect()] == ["GenderMale"]


def test_extremes_keep_ties(spark):
    df = spark.createDataFrame([("A", 5, 1.0), ("A", 6, 0.5), ("A", 7, 0.5), ("B", 5, 2.0)],
                               "comparison string, tend int, fit double")
    got = {(r.comparison, r.extreme, r.tend) for r in re_.extreme_rows(df, "comparison", "fit").collect()}
    assert got == {("A", "max", 5), ("A", "min", 6), ("A", "min", 7), ("B", "min", 5), ("B", "max", 5)}


def test_number_text_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 0.9), (2.5, 12.25)], "a double, b double")
    got = df.select(sc.interval_text("a", "b"), sc.round_half_even("a", 0), sc.labelled_counts([("n", F.col("a"))])).collect()
    assert [tuple(r) for r in got] == [("[1, 0.9]", 1.0, "n = 1"), ("[2.5, 12.25]", 2.0, "n = 2.5")]


def test_scalars(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    got = df.select(sc.is_in("x", [1]).alias("a"), (~sc.is_in("x", [1])).alias("b"),
                    sc.indicator(F.col("x") == 1).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, False, 1), (False, True, None)]
    assert sc.recycle([0], 3) == [0.0] * 3 and sc.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    v = spark.range(1).select(sc.dot(sc.literal_vector([1, 2]), sc.literal_vector([3, 4]))).first()[0]
    assert v == 11


def test_relabel_and_bind(spark):
    df = spark.createDataFrame([("b",), ("a",), ("q",)], "c string")
    got = [tuple(r) for r in re_.relabel(df, "c", [("a", "first"), ("b", "second")]).collect()]
    assert got == [("second", 2), ("first", 1), (None, None)]
    both = re_.bind_named({"u": df, "v": df}, "src")
    assert both.groupBy("src").count().count() == 2


def test_last_rows_do_not_depend_on_the_order(spark):
    df = spark.createDataFrame([(k, t) for k in range(20) for t in range(1, 30)], "k int, t int")
    for n in (1, 4, 16):
        got = re_.last_per_group(df.orderBy(F.rand(n)).repartition(n), "k", "t")
        assert {r.t for r in got.collect()} == {29} and got.count() == 20


def test_study_flow_counts(inputs):
    r = tb.study_flow(inputs.patient, inputs.fitted).first()
    assert r.n_database == 1500 and r.n_model == r.n_extubated + r.n_died + r.n_censored
    assert (r.n_died, r.n_extubated) == (168, 605)


def test_ties_are_ranked_in_many_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0.0).when(F.col("id") < 4010, None).otherwise(
        F.col("id").cast("double")).alias("v"), F.col("id").alias("k"))
    got = qu.global_rank(df.repartition(5), "v").toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(1, 5001)) and list(got.columns) == ["v", "k", "rank"]
    assert got["v"].iloc[:10].isna().all() and got["v"].iloc[10:].is_monotonic_increasing


def test_normal_quantiles_as_columns(spark):
    p = [1e-6, 0.001, 0.0242, 0.0243, 0.3, 0.5, 0.75, 0.975, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    got = {r.p: r.q for r in df.select("p", sc.normal_quantile_column(F.col("p")).alias("q")).collect()}
    assert all(got[v] == pytest.approx(sc.normal_quantile(v), rel=2e-9, abs=1e-12) for v in p)


def test_extremes_of_a_flat_group_come_twice(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), ("b", 3.0, 3)], "g string, v double, k int")
    got = sorted((r.g, r.extreme, r.k) for r in re_.extreme_rows(df, "g", "v").collect())
    assert got == [("a", "max", 1), ("a", "min", 1), ("b", "max", 3), ("b", "min", 2)]
