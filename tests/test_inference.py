import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pamspark.operators import cif as ci
from pamspark.operators import design as de
from pamspark.operators import effects as ef
from pamspark.operators import exposure as ex
from pamspark.operators import fit as fi
from pamspark.operators import model as mo
from pamspark.plans import analysis as an

SPEC = de.PamSpec(exposures=("proteinCat3", "proteinCat2"))


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(7)
    info = de.BasisInfo({"t": (0.0, 59.5), "tz": (0.0, 12.0), "int_mid": (4.5, 59.5)}, {},
                        de.lag_lead_weights(spark, ex.protein_lag_lead, 60))
    beta = np.concatenate([[-3.0], 0.2 * rng.standard_normal(50)])
    a = 0.05 * rng.standard_normal((51, 51))
    return mo.PamModel("given", SPEC, info, beta, a @ a.T)


@pytest.fixture(scope="module")
def frames(inputs, spark):
    from pamspark.sources.io import cut_lineage
    return cut_lineage(ex.protocol_frames(ex.template_subjects(inputs.fitted), ex.schemes(spark)))


def test_hazard_ratio_is_one_outside_the_reach(given, frames):
    """Days 1-4 act on 5..22, days 5-11 on 9..43, all days on 5..43; elsewhere the ratio is exactly 1."""
    got = ef.six_comparisons(given, frames).toPandas()
    assert len(got) == 6 * 56
    reach = {"A": (9, 43), "B": (5, 22), "C": (5, 43), "D": (9, 43), "E": (5, 22), "F": (5, 43)}
    for r in got.itertuples():
        lo, hi = reach[r.comparison]
        inside = lo <= r.tend <= hi
        assert inside or (r.fit == 1 and r.se == 0 and r.lo == 1 and r.hi == 1)
        if inside:
            assert r.se > 0 and r.hi == pytest.approx(r.fit * math.exp(2 * r.se))
    assert got["name"].nunique() == 6


def test_reversed_pair_inverts_the_ratio(given, frames, spark):
    pairs = spark.createDataFrame([("x", "low", "high", "n"), ("y", "high", "low", "n")],
                                  "comparison string, p1 string, p2 string, name string")
    got = ef.effect_diff(given, frames, pairs).toPandas().pivot(index="tend", columns="comparison", values="fit")
    assert np.allclose(got["x"] * got["y"], 1)


def test_unknown_effect_name_is_an_error(given, frames):
    with pytest.raises(ValueError, match="calCat"):
        ef.six_comparisons(given, frames, effect="calCat")


def test_hr_table_and_extremes(given, frames):
    effects = ef.six_comparisons(given, frames)
    r = ef.hr_table(effects).where("comparison = 'A' and tend = 60").first()
    assert (r.fit, r.CI) == (1.0, "[1, 1]")
    ends = ef.hr_extremes(effects).toPandas()
    assert set(ends["extreme"]) == {"min", "max"} and ends["comparison"].nunique() == 6


def test_coefficient_table(spark):
    spec = de.PamSpec(factors=(("Gender", ("Female", "Male")),), linear=("ApacheIIScore", "PN2_4"),
                      time_linear=("ApacheIIScore",))
    m = mo.PamModel("m", spec, de.BasisInfo({}, {}), np.array([-3, 0.4, 0.1, 0.2, 0.01]), np.diag([1, 0.04, 1, 1, 1.0]))
    other = mo.PamModel("k", spec, de.BasisInfo({}, {}), np.zeros(5), np.eye(5))
    got = ef.coef_table([m, other], spark, exclude=ef.METRIC_TERMS).orderBy("model").collect()
    assert [(r.model, r.term, r.label) for r in got] == [("k", "GenderMale", "Gender: male"), ("m", "GenderMale", "Gender: male")]
    assert got[1].z == pytest.approx(2) and got[1].upper == pytest.approx(0.4 + 1.959964 * 0.2, abs=1e-6)
    rest = ef.coef_table([m], spark, exclude=ef.CATEGORICAL_TERMS, intercept=True)
    assert {r.term for r in rest.collect()} == {"(Intercept)", "ApacheIIScore", "PN2_4", "ApacheIIScore:int_mid"}


def test_cumulative_incidence_by_hand(spark):
    h = spark.createDataFrame([(0, "p", 5, 1.0, 0.1, 0.2), (0, "p", 6, 1.0, 0.1, 0.2)],
                              "sim_id bigint, protocol string, tend int, intlen double, death double, extubation double")
    got = ci.cif(h).orderBy("tend").collect()
    assert [r.cif_death for r in got] == pytest.approx([0.074082, 0.128963], abs=1e-6)
    assert [r.survival for r in got] == pytest.approx([math.exp(-0.3), math.exp(-0.6)])


def test_incidence_properties_and_bands(given, frames, spark):
    draws = ci.posterior_draws(given, spark, 40, seed=3)
    curves = ci.cif(ci.cause_hazards([draws, ci.posterior_draws(given, spark, 40, seed=4)], [given, given], frames))
    pdf = curves.toPandas().sort_values(["sim_id", "protocol", "tend"])
    assert len(pdf) == 40 * 5 * 56
    assert (pdf.groupby(["sim_id", "protocol"])["cif_death"].diff().dropna() >= -1e-9).all()  # survival less 1e-10 may dip below 0
    assert (pdf["cif_death"] + pdf["cif_extubation"] + pdf["survival"] <= 1 + 1e-9).all()
    a = ci.cif_band(curves).orderBy("protocol", "tend", "cause").toPandas()
    b = ci.cif_band(curves, few_draws=True).orderBy("protocol", "tend", "cause").toPandas()
    for c in ("cif", "cif_lower", "cif_upper"):
        assert np.allclose(a[c], b[c], rtol=1e-12)
    one = pdf[(pdf["protocol"] == "low") & (pdf["tend"] == 30)]["cif_death"]
    row = a[(a["protocol"] == "low") & (a["tend"] == 30) & (a["cause"] == "death")].iloc[0]
    assert row["cif_lower"] == pytest.approx(np.quantile(one, 0.025))
    arranged = ci.paired_bands(ci.cif_band(curves), ex.comparisons(spark), ex.schemes(spark))
    assert arranged.count() == 6 * 2 * 56 * 2


def test_curves_inside_the_draws_equal_the_windowed_ones(given, frames, spark):
    draws = [ci.posterior_draws(given, spark, 30, seed=i) for i in (3, 4)]
    keys = ["sim_id", "protocol", "tend"]
    curves = ci.cif_curves(draws, [given, given], frames)
    assert "Window" not in curves._jdf.queryExecution().executedPlan().toString()
    a = curves.toPandas().sort_values(keys)
    b = ci.cif(ci.cause_hazards(draws, [given, given], frames)).toPandas().sort_values(keys)
    assert list(a.columns) == list(b.columns) and len(a) == 30 * 5 * 56
    for c in ("survival", "cif_death", "cif_extubation"):
        assert np.allclose(a[c], b[c], rtol=1e-12)


def test_two_templates_are_refused(given, inputs, spark):
    two = ex.protocol_frames(ex.template_subjects(inputs.fitted, ["AdmCatID"]), ex.schemes(spark))
    with pytest.raises(ValueError, match="template"):
        ci.prediction_matrix(given, two)
    with pytest.raises(ValueError, match="more than 100"):
        ci.prediction_matrix(given, two, most=100)


def test_predictions_equal_the_design(subjects, spark):
    """Folded weights give what the dense design gives, for every kind of term."""
    levels = ("Medical", "Surgical/Elective", "Surgical/Emeregency")
    spec = de.PamSpec(factors=(("AdmCatID", levels),), linear=("ApacheIIScore", "PN2_4"), time_linear=("ApacheIIScore",),
                      baseline_k=10, time_smooths=("Age", "BMI"), exposures=("proteinCat3", "proteinCat2"))
    from pamspark.operators import fit as fi
    from pamspark.operators import ped as pe
    info = de.basis_info(fi.subject_blocks(subjects), spec)
    p = de.Design(spec, info).p
    rng = np.random.default_rng(5)
    m = mo.PamModel("m", spec, info, rng.standard_normal(p) / 10, np.eye(p))
    rows = pe.as_ped(subjects.where("CombinedID % 50 = 0"), from_day=5, keep=["CombinedID", *spec.covariates, *spec.exposures])
    keys = ["CombinedID", "tend"]
    a = mo.predict_terms(rows, m, keys, effect="proteinCat3").toPandas().sort_values(keys)
    b = de.design_rows(rows, m.design, keys).toPandas().sort_values(keys)
    x = np.array(b["x"].tolist())
    at = m.columns("proteinCat3")
    assert len(a) == len(b) > 500
    assert np.allclose(a["eta"], x @ m.beta) and np.allclose(a["eta_effect"], x[:, at] @ m.beta[at])
    bare = mo.predict_terms(rows.withColumn("PN2_4", F.lit(None).cast("int")), m, keys).toPandas()
    assert bare["eta"].isna().all()


def test_draws_do_not_depend_on_partitions(given, spark):
    got = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
        got.append({r.sim_id: r.beta for r in ci.posterior_draws(given, spark, 30, seed=9).collect()})
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert got[0] == got[1] == got[2]
    big = np.array([r.beta for r in ci.posterior_draws(given, spark, 4000, seed=1).collect()])
    assert np.allclose(big.mean(axis=0), given.beta, atol=0.05)
    assert np.allclose(np.cov(big.T), given.cov, atol=0.03)


def test_draw_moments(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "sim_id bigint, beta array<double>")
    mean, cov = ci.draw_moments(df.repartition(7))
    assert np.allclose(mean, v.mean(axis=0)) and np.allclose(cov, np.cov(v.T))


def test_predictions_without_offset(given, frames):
    got = mo.predict_terms(frames, given, ["protocol", "tend"], effect="proteinCat3").toPandas()
    low = got[got["protocol"] == "low"]
    assert np.allclose(low["eta"], -3) and np.allclose(low["eta_effect"], 0)


def test_smooth_and_group_tables(subjects, spark):
    from pamspark.operators import fit as fi
    spec = de.PamSpec(baseline_k=10, time_smooths=("Age",), group="CombinedicuID")
    m = fi.fit_pam(fi.subject_blocks(subjects), spec, "delta_2")
    s = ef.smooth_table(m, spark, "int_mid", points=50).toPandas()
    assert len(s) == 50 and (s["ci_lower"] <= s["fit"]).all() and s["x"].iloc[-1] == pytest.approx(59.5)
    assert len(ef.smooth_table(m, spark, "Age").toPandas()) == 100
    q = ef.group_effect_qq(m).orderBy("i").toPandas()
    n = len(q)
    assert n == subjects.select("CombinedicuID").distinct().count()
    assert (q["effect"].diff().dropna() >= 0).all()
    assert q["theoretical"].iloc[0] == pytest.approx(-q["theoretical"].iloc[-1])


def test_study_is_written(inputs, spark, tmp_path):
    models = an.write_study(inputs.patient, inputs.daily, str(tmp_path), merged=inputs.patient.select("CombinedID"),
                            with_subgroups=False, n_sim=30)
    assert set(models) == {"death", "extubation", "sens_death", "sens_extubation"}
    back = mo.load_model(spark, f"{tmp_path}/models/death")
    assert np.array_equal(back.beta, models["death"].beta) and np.array_equal(back.cov, models["death"].cov)
    assert back.spec == models["death"].spec and back.names == models["death"].names
    assert back.groups.count() == models["death"].groups.count()
    life = spark.read.option("header", True).csv(f"{tmp_path}/results/events-per-interval")
    assert life.count() == 56 and "interval_label" in life.columns
    hr = spark.read.option("header", True).csv(f"{tmp_path}/results/hazard-ratios-death")
    assert hr.select("name").distinct().count() == 6 and hr.count() == 336
    assert spark.read.parquet(f"{tmp_path}/results/incidence").count() == 6 * 2 * 56 * 2
    bands = spark.read.parquet(f"{tmp_path}/results/sens-incidence")
    first = bands.where("comparison = 'A' and label = 'late standard'").first()
    assert (first.comparison_text, first.comparison_ord, first.label_ord) == ("A: exclusively low vs. late standard", 1, 2)
    assert bands.count() == 6 * 2 * 56 * 2

    def report(name):
        # some labels hold a line break
        return spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/results/{name}").toPandas()

    rows = {"study-flow": 1, "durations-extubated": 2, "time-to-death": 1, "strata-pn": 2, "strata-bmi": 3,
            "cases-AdmCatID": 3, "cases-bmi_cat": 3, "cases-pn_bin": 2, "diet-days": 1, "en-share": 1, "low-intake": 1,
            "days-beyond-window": 1, "smooths": 4 * 3 * 100, "coefficients-metric": 4 * 6}
    assert {n: len(report(n)) for n in rows} == rows
    assert set(report("coefficients-categorical")["model"]) == set(models)
    assert set(report("hazard-ratio-extremes")["extreme"]) == {"min", "max"}
    assert len(report("last-interval-mortality")) and len(report("baseline")) and len(report("intake-bands"))
    units = spark.read.parquet(f"{tmp_path}/results/unit-quantiles/death")
    assert units.count() == models["death"].groups.count()
    n = spark.read.parquet(f"{tmp_path}/data/patient").count()
    assert n == inputs.fitted.count() == spark.read.parquet(f"{tmp_path}/data/mergedData").count()


def test_draws_are_the_digest_normals(spark):
    """Draws told by hand from MD5 digests, and the root of a covariance with a coefficient that does not vary."""
    import hashlib
    from statistics import NormalDist
    rows = {r.i: r.z for r in spark.range(3).select(F.col("id").alias("i"), ci.standard_normals(F.col("id"), 4, 9).alias("z")).collect()}
    for i, z in rows.items():
        for j, v in enumerate(z):
            u = (int(hashlib.md5(f"9:{i}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            assert v == pytest.approx(NormalDist().inv_cdf(u), rel=1e-8)
    cov = np.array([[4.0, 0, 1], [0, 0, 0], [1, 0, 2]])
    root = ci.lower_root(cov)
    assert np.allclose(root @ root.T, cov) and np.allclose(root, np.tril(root))


def test_score_equations_see_a_wrong_coefficient(subjects, inputs):
    from dataclasses import replace
    from pamspark.operators import ped as pe
    spec = de.PamSpec(factors=(("Gender", ("Female", "Male")),), baseline_k=10, group="CombinedicuID")
    m = fi.fit_pam(fi.subject_blocks(subjects), spec, "delta_2")
    rows = pe.as_ped(subjects, from_day=5, keep=["Gender", "CombinedicuID", "icuByDummy"])
    good = {r.term: r for r in ef.score_equations(m, rows, "ped_status_2").collect()}
    assert {t: r.n for t, r in good.items()} == {"parametric": 2, "s(int_mid)": 9, "smoothing": 2, "units": m.groups.count()}
    assert all(r.score < 0.005 for r in good.values())
    bad = replace(m, beta=m.beta + 0.1 * np.eye(len(m.beta))[1])
    assert max(r.score for r in ef.score_equations(bad, rows, "ped_status_2").collect()) > 0.5


def test_broken_curves_are_counted(spark):
    rows = [(0, "a", 5, 0.9, 0.05, 0.04), (0, "a", 6, 0.8, 0.04, 0.1), (0, "a", 7, 0.9, 0.06, 0.2), (0, "b", 5, 1.0, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "sim_id long, protocol string, tend int, survival double, cif_death double, cif_extubation double")
    assert {r.protocol: (r.n_points, r.above_one, r.falling) for r in ci.broken_curves(table).collect()} == {"a": (3, 1, 1), "b": (1, 0, 0)}


def test_subgroup_models(subjects, spark):
    spec = de.PamSpec(factors=(("AdmCatID", ("Medical", "Surgical/Elective", "Surgical/Emeregency")),),
                      linear=("PN2_4",), baseline_k=10)
    groups = [g for g in an.subgroups() if g.name in ("medical", "pn01")]
    models = an.fit_subgroups(subjects, spec, groups)
    assert set(models) == {"medical_death", "medical_extubation", "pn01_death", "pn01_extubation"}
    assert "PN2_4" not in models["pn01_death"].names and "PN2_4" in models["medical_death"].names
    n = subjects.where((F.col("AdmCatID") == "Medical") & (F.col("delta_1") == 1) & (F.col("event_time") <= 60)).count()
    assert models["medical_death"].stats["events"] == n


def test_rows_are_scored_in_batches(subjects, spark):
    """Splines are not spelled out as expressions of every row; gaps are those of the row's own parts."""
    from pamspark.operators import ped as pe
    spec = de.PamSpec(linear=("PN2_4",), baseline_k=10, time_smooths=("Age", "BMI"), exposures=("proteinCat3",))
    info = de.basis_info(fi.subject_blocks(subjects), spec)
    p = de.Design(spec, info).p
    m = mo.PamModel("m", spec, info, np.linspace(-0.1, 0.1, p), np.eye(p))
    rows = pe.as_ped(subjects.where("CombinedID % 100 = 0"), from_day=5, keep=["CombinedID", *spec.covariates, *spec.exposures])
    scored = mo.predict_terms(rows, m, ["CombinedID", "tend"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "greatest" not in plan
    known = {(r.CombinedID, r.tend): r.eta for r in scored.collect()}
    for gap in ("PN2_4", "proteinCat3", "tend"):
        holes = rows.withColumn(gap, F.when(F.col("CombinedID") % 200 != 0, F.col(gap)))
        got = mo.predict_terms(holes, m, ["CombinedID", "tend"]).collect()
        assert len(got) == len(known) and {r.CombinedID % 200 == 0 for r in got} == {True, False}
        assert all(r.eta is None if r.CombinedID % 200 == 0 else r.eta == pytest.approx(known[r.CombinedID, r.tend]) for r in got)
    late = mo.predict_terms(rows.withColumn("tend", F.lit(61)), m, ["CombinedID"]).collect()
    assert late and all(r.eta is None for r in late)


def test_column_and_group_sums_in_one_pass(subjects, spark):
    spec = de.PamSpec(linear=("PN2_4",))
    design = de.Design(spec, de.BasisInfo({}, {}))
    rows = subjects.select("PN2_4", F.lit(7).alias("tend"), (F.col("CombinedID") % 5).cast("double").alias("w"),
                           F.when(F.col("CombinedID") % 3 > 0, F.col("CombinedID") % 3).alias("unit"))
    got = {(r.grp, r.term): r.total for r in de.column_sums(rows.repartition(5), design, "w", "unit", ["w"]).collect()}
    want = {(None, r.term): r.total for r in de.column_sums(rows, design, "w").collect()}
    want |= {(str(r.unit), "w"): r.w for r in rows.where("unit is not null").groupBy("unit").agg(F.sum("w").alias("w")).collect()}
    assert len(want) == 4 and got == pytest.approx(want)


def test_scored_subjects_are_dealt_over_tasks(subjects):
    from pamspark.plans import queries
    small = subjects.limit(500).coalesce(1)
    assert "RepartitionByExpression [CombinedID" in queries._spread(small)._jdf.queryExecution().optimizedPlan().toString()


def _own_subjects(spark, n=80):
    """Invented subjects with every column that the study's models and strata read."""
    rng = np.random.default_rng(11)

    def pick(values):
        return [values[i % len(values)] for i in rng.permutation(n)]

    adm, bmi = pick(["Medical", "Surgical/Elective", "Surgical/Emeregency"]), rng.uniform(15, 40, n)
    t = rng.integers(5, 62, n)
    died, weaned = (t <= 60) & (np.arange(n) % 3 == 0), (t <= 60) & (np.arange(n) % 3 == 1)
    diaries = rng.integers(0, 2, (2, n, 11)).astype(float)
    rows = [(i, int(t[i]), int(died[i]), int(weaned[i]), int(died[i] or i % 7 == 1), int(weaned[i] and i % 7 != 1),
             y, d, adm[i], g, int(rng.integers(0, 41)), *[int(v) for v in rng.integers(0, 4, 4)], int(rng.integers(18, 90)), float(bmi[i]),
             "bmi<18.5" if bmi[i] < 18.5 else "bmi>30" if bmi[i] > 30 else "bmi18.5-30", "pn01" if i % 2 else "pn23",
             i % 4, i % 9 and 1, 11, diaries[0, i].tolist(), diaries[1, i].tolist())
            for i, (y, d, g) in enumerate(zip(pick(["2008", "2009"]), pick(["a", "b", "c"]), pick(["Female", "Male"])))]
    return spark.createDataFrame(rows, "CombinedID long, event_time int, delta_1 int, delta_2 int, sens_delta_1 int, sens_delta_2 int, "
                                 "Year string, DiagID2 string, AdmCatID string, Gender string, ApacheIIScore int, inMV2_4 int, "
                                 "Propofol2_4 int, OralIntake2_4 int, PN2_4 int, Age int, BMI double, bmi_cat string, pn_bin string, "
                                 "CombinedicuID int, icuByDummy int, n_days int, proteinCat2 array<double>, proteinCat3 array<double>")


def _own_models(subjects, names_and_specs, skip_unit=None):
    """Models with invented coefficients and unit effects; the first does not know the unit ``skip_unit``."""
    rng, spark, out = np.random.default_rng(12), subjects.sparkSession, {}
    for i, (name, spec) in enumerate(names_and_specs):
        info = de.basis_info(fi.subject_blocks(subjects), spec)
        design = de.Design(spec, info)
        root = rng.standard_normal((design.p, design.p)) / 10
        beta = rng.standard_normal(design.p) / 100
        beta[:design.parametric] /= 100
        beta[0] = -3
        groups = spark.createDataFrame([(str(u), float(rng.standard_normal())) for u in range(4) if i or u != skip_unit],
                                       "grp string, effect double")
        out[name] = mo.PamModel(name, spec, info, beta, root @ root.T, {**{p.label: 0.3 + i for p in design.penalties()}, "group": 2.0},
                                {"gradient": 0.0}, groups)
    return out


def _dense_mu(m, rows):
    """Rows with the design ``x``, the unit's effect ``b`` and the expected events, without the scorer."""
    got = de.design_rows(rows, m.design, [c for c in rows.columns if not c.startswith("proteinCat")]).toPandas()
    effect = dict(m.groups.collect())
    got["b"] = [effect.get(str(u), np.nan) for u in got["CombinedicuID"]]
    got["mu"] = np.exp(np.array(got["x"].tolist()) @ m.beta + got["b"] * got["icuByDummy"] + got["offset"])
    return got


def test_scores_of_all_strata_from_one_generation_of_rows(spark, monkeypatch):
    """Rows at risk are generated and read once for all models; every score is that of the dense design."""
    from pamspark.operators import ped as pe
    from pamspark.plans import queries
    subjects = _own_subjects(spark)
    spec = an.study_spec(subjects)
    groups = an.subgroups()
    models = _own_models(subjects, [(f"{g.name}_{c}", spec.without(*g.without)) for g in groups[2:7:2] for c in ("death", "extubation")], 3)
    monkeypatch.setattr(queries, "_subgroup_models", lambda x: (subjects, models))
    made, real = [], pe.as_ped
    monkeypatch.setattr(queries.pe, "as_ped", lambda *a, **k: made.append(1) or real(*a, **k))
    got = {(r.model, r.term): r for r in queries._score_equations_subgroups(None).collect()}
    assert len(made) == 1
    keep = [c for c in subjects.columns if c not in ("event_time", "delta_1", "delta_2", "sens_delta_1", "sens_delta_2")]
    for name, m in models.items():
        rule = next(g.rule for g in groups if g.name == name.split("_")[0])
        rows = _dense_mu(m, real(subjects.where(rule), from_day=5, keep=keep).repartition(3))
        rows = rows[rows["b"].notna()]
        rest = rows["ped_status_1" if "death" in name else "ped_status_2"] - rows["mu"]
        slope = sum(m.smoothing[p.label] * p.matrix @ m.beta for p in m.design.penalties())
        gap = np.abs(np.array(rows["x"].tolist()).T @ rest.to_numpy() - slope) * np.sqrt(np.diag(m.cov))
        for term, (a, b) in {"parametric": (0, m.design.parametric), **m.design.spans}.items():
            assert got[name, term].n == b - a and got[name, term].score == pytest.approx(gap[a:b].max(), rel=1e-6, abs=0.006)
        on = rows["icuByDummy"]
        per = rows.assign(s=rest * on, w=rows["mu"] * on * on).groupby("CombinedicuID").agg({"s": "sum", "w": "sum", "b": "first"})
        far = (np.abs(per["s"] - 2 * per["b"]) / np.sqrt(per["w"] + 2)).max()
        assert got[name, "units"].n == len(per) and got[name, "units"].score == pytest.approx(far, rel=1e-6, abs=0.006)


def test_calibration_scores_all_models_in_one_pass(spark, monkeypatch):
    from pamspark.operators import ped as pe
    from pamspark.plans import queries
    subjects = _own_subjects(spark)
    models = _own_models(subjects, [(n, an.study_spec(subjects)) for n in ("death", "extubation")])
    monkeypatch.setattr(an, "study_subjects", lambda *a: subjects)
    monkeypatch.setattr(an, "fit_main", lambda *a, **k: models)
    monkeypatch.setattr(queries.Inputs, "__init__", lambda self: None)
    x = queries.Inputs()
    x.patient = x.daily = None
    got = queries._fit_calibration(x)
    assert got.columns == ["variable", "level", "expected", "model"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.model, r.variable, r.level): r.expected for r in got.collect()}
    keep = [c for c in subjects.columns if c not in ("event_time", "delta_1", "delta_2", "sens_delta_1", "sens_delta_2")]
    for name, m in models.items():
        rows = _dense_mu(m, pe.as_ped(subjects, from_day=5, keep=keep))
        for f in de.FACTORS:
            for level, mu in rows.groupby(f)["mu"].sum().items():
                assert got.pop((name, f, level)) == pytest.approx(mu, abs=0.006)
    assert not got


def test_equal_rows_share_their_parts(spark):
    """Runs of equal rows, rows in any order and several models give the same predictions."""
    from pamspark.operators import ped as pe
    subjects = _own_subjects(spark)
    spec = an.study_spec(subjects)
    models = _own_models(subjects, [("a", spec), ("b", spec.without("BMI", "AdmCatID"))])
    rows = pe.as_ped(subjects, from_day=5, keep=["CombinedID", *spec.covariates, *spec.exposures])
    both = {(r.CombinedID, r.tend): (r.eta_a, r.eta_b) for r in mo.predict_terms(rows, models, ["CombinedID", "tend"]).collect()}
    mixed = rows.orderBy(F.xxhash64("CombinedID", "tend")).repartition(3)
    for i, m in enumerate(models.values()):
        one = {(r.CombinedID, r.tend): r.eta for r in mo.predict_terms(mixed, m, ["CombinedID", "tend"]).collect()}
        assert one == pytest.approx({k: v[i] for k, v in both.items()})
