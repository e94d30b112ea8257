import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pamspark.operators import design as de
from pamspark.operators import fit as fi
from pamspark.operators import ped as pe
from pamspark.operators.model import predict_terms

ADM = ("Medical", "Surgical/Elective", "Surgical/Emeregency")


@pytest.fixture(scope="module")
def spec(subjects):
    return de.main_spec(de.observed_levels(subjects, de.FACTORS))


@pytest.fixture(scope="module")
def main_model(subjects, spec):
    return fi.fit_pam(fi.subject_blocks(subjects), spec, "delta_2", name="extubation")


def test_rates_in_closed_form(subjects):
    m = fi.fit_pam(fi.subject_blocks(subjects), de.PamSpec(factors=(("AdmCatID", ADM),)), "delta_1",
                   smooth=False, tol=1e-14)
    rows = pe.as_ped(subjects, from_day=5, keep=["AdmCatID"]).groupBy("AdmCatID").agg(
        F.sum("ped_status_1").alias("e"), F.count(F.lit(1)).alias("n")).collect()
    want = {r.AdmCatID: math.log(r.e / r.n) for r in rows}
    events = {r.AdmCatID: r.e for r in rows}
    assert m.beta[0] == pytest.approx(want["Medical"], abs=1e-8)
    assert m.beta[0] + m.beta[2] == pytest.approx(want[ADM[2]], abs=1e-8)
    assert math.sqrt(m.cov[0, 0]) == pytest.approx(1 / math.sqrt(events["Medical"]), rel=1e-5)


def test_compressed_rows_give_the_same_fit(subjects):
    rows = pe.as_ped(subjects, from_day=5, keep=["AdmCatID", "Gender"])
    spec = de.PamSpec(factors=(("AdmCatID", ADM), ("Gender", ("Female", "Male"))), baseline_k=10)
    small = pe.compress(rows, ["AdmCatID", "Gender", "tend"])
    fits = [fi.fit_pam(b, spec, e, smooth=False, smoothing={"s(int_mid)": 10.0}, tol=1e-12) for b, e in (
        (fi.subject_blocks(subjects), "delta_2"), (fi.row_blocks(rows, {"ev": "ped_status_2"}), "ev"),
        (fi.row_blocks(small, {"ev": "ped_status_2"}), "ev"))]
    for f in fits[1:]:
        assert np.allclose(f.beta, fits[0].beta, atol=1e-8) and np.allclose(f.cov, fits[0].cov, atol=1e-8)


def test_fractional_times(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(t), 1, 0) for i, t in enumerate(np.round(4 + rng.exponential(9, 400), 3))]
    df = spark.createDataFrame(rows, "CombinedID bigint, event_time double, delta_1 int, delta_2 int")
    m = fi.fit_pam(fi.subject_blocks(df), de.PamSpec(), "delta_1", smooth=False, tol=1e-14)
    ped = pe.person_time(pe.as_ped(df, from_day=5)).first()
    assert m.beta[0] == pytest.approx(math.log(ped.ped_status_1 / ped.person_time), abs=1e-9)


def dense(subjects, spec, info, event):
    """Reference: the whole design in memory, groups as dummy columns."""
    d = de.Design(spec, info)
    rows = pe.as_ped(subjects, from_day=5, keep=["CombinedID", *spec.covariates, *spec.exposures, "CombinedicuID"])
    got = de.design_rows(rows, d, ["CombinedicuID", f"ped_status_{event}", "offset"]).toPandas()
    g = np.sort(got["CombinedicuID"].unique())
    return d, np.stack(got["x"].to_numpy()), (got["CombinedicuID"].to_numpy()[:, None] == g).astype(float), \
        got[f"ped_status_{event}"].to_numpy(dtype=float), got["offset"].to_numpy()


def test_score_equation_and_group_elimination(subjects, spec, main_model):
    """At the optimum X'(y - mu) = S beta, and the covariance is the block of the full inverse."""
    m = main_model
    d, x, dummies, y, off = dense(subjects, spec, m.info, 2)
    effects = {r.grp: r.effect for r in m.groups.collect()}
    b = np.array([effects[str(int(k))] for k in np.sort(subjects.select("CombinedicuID").distinct().toPandas()["CombinedicuID"])])
    mu = np.exp(x @ m.beta + dummies @ b + off)
    s = sum(m.smoothing[p.label] * p.matrix for p in d.penalties())
    assert np.abs(x.T @ (y - mu) - s @ m.beta).max() < 0.05
    assert np.abs(dummies.T @ (y - mu) - m.smoothing["group"] * b).max() < 0.05
    full = np.hstack([x, dummies])
    h = full.T @ (full * mu[:, None])
    h[:d.p, :d.p] += s
    h[d.p:, d.p:] += m.smoothing["group"] * np.eye(len(b))
    v = np.linalg.pinv(h, rcond=1e-13)[:d.p, :d.p]
    grid = x[::97]
    assert np.allclose(np.einsum("ij,jk,ik->i", grid, m.cov, grid), np.einsum("ij,jk,ik->i", grid, v, grid), rtol=1e-2)
    assert m.stats["converged"] and m.stats["expected"] == pytest.approx(m.stats["events"], rel=1e-3)


def test_block_sums_equal_the_dense_products(subjects, spec, main_model):
    d, x, dummies, y, off = dense(subjects, spec, main_model.info, 1)
    beta = 0.1 * np.random.default_rng(5).standard_normal(d.p) / (1 + np.abs(x).max(axis=0))
    beta[0] = -4
    task = fi.Task("t", "delta_1", spec)
    table = fi._with_effects(fi._prepare(fi.subject_blocks(subjects), [task], [None], d, 3), None, 1, 1)
    sums = fi._pass(table, [d], {0: beta}, {0: np.arange(d.p)})
    st = fi._State(0, task, d, d.penalties(), np.arange(d.p))
    st.load(fi._added(sums.where("grp is null"))[0])
    mu = np.exp(x @ beta + off)
    assert np.allclose(st.gram, x.T @ (x * mu[:, None]), rtol=1e-8, atol=1e-8)
    assert np.allclose(st.score, x.T @ (y - mu), rtol=1e-8, atol=1e-7)
    units = fi._unit_sums(sums).toPandas()
    assert units["grp"].is_unique
    v = np.stack(units["v"].to_numpy())
    assert np.allclose(v[:, :d.p].sum(axis=0), x.T @ mu)
    assert v[:, d.p].sum() == pytest.approx(mu.sum()) == pytest.approx(st.parts[3])
    assert v[:, d.p + 1].sum() == pytest.approx((y - mu).sum(), abs=1e-7)


SMALL = de.PamSpec(factors=(("Gender", ("Female", "Male")),), group="CombinedicuID", baseline_k=10)


def effects_of(model):
    return {r.grp: r.effect for r in model.groups.collect()}


def test_unit_blocks_change_nothing(subjects):
    blocks = fi.subject_blocks(subjects)
    one, many = (fi.fit_pam(blocks, SMALL, "delta_2", block_units=n) for n in (1000, 4))
    assert one.stats["passes"] == many.stats["passes"]
    assert np.allclose(one.beta, many.beta, atol=1e-8) and np.allclose(one.cov, many.cov, atol=1e-8)
    a, b = effects_of(one), effects_of(many)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-8 for k in a)


def test_a_step_too_long_is_halved_with_its_effects(subjects, monkeypatch):
    blocks = fi.subject_blocks(subjects)
    straight = fi.fit_pam(blocks, SMALL, "delta_2", smooth=False, tol=1e-12)
    step, calls = fi._step, []

    def stretched(st, terms, smooth):
        delta, *rest = step(st, terms, smooth)
        calls.append(1)
        return (delta * 64 if len(calls) == 1 else delta, *rest)

    monkeypatch.setattr(fi, "_step", stretched)
    halved = fi.fit_pam(blocks, SMALL, "delta_2", smooth=False, tol=1e-12)
    assert halved.stats["passes"] > len(calls)
    assert np.allclose(halved.beta, straight.beta, atol=1e-6)
    a, b = effects_of(halved), effects_of(straight)
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_moved_effects(spark):
    units = spark.createDataFrame([(0, "a", 0.8, [1.0, 2.0, 3.0]), (1, "a", 0.1, [1.0, 2.0, 3.0])], fi.SUMS)
    on = fi._moved_effects(units, {0: (2.0, np.array([0.5]))}, {0: np.array([0])}, 3).collect()
    assert len(on) == 1 and on[0].b == pytest.approx(0.8 + (3 - 2 * 0.8 - 0.5) / 4) and on[0].old == pytest.approx(0.8)


def test_unit_terms_between_their_nodes(spark):
    rng = np.random.default_rng(2)
    c, sw, s, b = rng.random((50, 3)), rng.gamma(2, 10, 50), rng.standard_normal(50), 0.1 * rng.standard_normal(50)
    units = spark.createDataFrame(
        [(0, str(k), float(b[k]), [*map(float, c[k]), float(sw[k]), float(s[k])]) for k in range(50)], fi.SUMS).repartition(3)
    nodes = fi._nodes(20.0, 1.5, 1e-9, 1e9)
    values = fi._added(fi._unit_terms(units, {0: nodes}, {0: 20.0}, {0: np.arange(3)}, 5))[0]
    got = fi._between(nodes, values.reshape(len(nodes), -1), 20.0, 3)
    for lam in (6.0, 20.0, 55.0):
        d, r = sw + lam, s - lam * b
        cd, plain = c / d[:, None], b + r / d
        want = (c.T @ cd, cd.T @ cd, cd.T @ r, cd.T @ plain,
                [(r * r / d).sum(), (plain**2).sum(), (1 / d).sum(), 50, b @ b])
        assert all(np.allclose(g, w, rtol=1e-6, atol=1e-9) for g, w in zip(got(lam), want))


def test_each_folder_of_effects_is_read_once(spark):
    """200 blocks of units: every scan of the fit table and of the effects is cut to its folder."""
    blocks = 200
    table = fi.cut_lineage(spark.range(2_000).select(F.col("id").cast("string").alias("grp")).withColumn(
        "block", fi._unit_block(blocks)), by=["block"])
    effects = fi.cut_lineage(table.select(F.lit(0).alias("model"), "grp", F.col("grp").cast("double").alias("b"),
                                          F.lit(0.0).alias("old"), "block"), by=["block"])
    met = fi._with_effects(table, effects, 1, blocks)
    plan = met._jdf.queryExecution().simpleString()
    scans = plan.split("FileScan parquet")[1:]
    assert len(scans) == 2 * blocks and all("PartitionFilters: [isnotnull(block" in s for s in scans)
    assert met.where(F.col("b")[0] != F.col("grp").cast("double")).count() == 0 and met.count() == 2_000


def test_unit_sums_go_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(m, str(g), float(g), [float(i), 1.0]) for m in range(2) for g in range(5) for i in range(30)]
        units = fi._unit_sums(spark.createDataFrame(rows, fi.SUMS).repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.model, r.grp, r.b, *r.v) for r in units) == [(m, str(g), float(g), 435.0, 30.0) for m in range(2) for g in range(5)]


SMOOTH = de.PamSpec(factors=(("Gender", ("Female", "Male")),), baseline_k=10, time_smooths=("Age",), group="CombinedicuID",
                    exposures=("proteinCat3", "proteinCat2"))


def test_smoothing_parameters_maximise_the_restricted_likelihood(subjects):
    """The dense working model's restricted likelihood has no slope left, and no better place nearby."""
    m = fi.fit_pam(fi.subject_blocks(subjects), SMOOTH, "delta_2")
    d, x, dummies, y, off = dense(subjects, SMOOTH, m.info, 2)
    effects = effects_of(m)
    units = np.sort(subjects.select("CombinedicuID").distinct().toPandas()["CombinedicuID"])
    full = np.hstack([x, dummies])
    theta = np.concatenate([m.beta, [effects[str(int(k))] for k in units]])
    eta = full @ theta
    mu = np.exp(eta + off)
    gram, rhs = full.T @ (full * mu[:, None]), full.T @ (mu * eta + y - mu)
    penalties = [*d.penalties()]

    def restricted(rho):
        lam = np.exp(rho)
        s = np.zeros_like(gram)
        s[:d.p, :d.p] = sum(v * p.matrix for v, p in zip(lam, penalties))
        s[d.p:, d.p:] = lam[-1] * np.eye(len(units))
        h = gram + s
        size = np.sqrt(np.diag(h))
        scaled = h / np.outer(size, size) + 1e-12 * np.eye(len(h))
        best = np.linalg.solve(scaled, rhs / size) / size
        known = 2 * np.log(size).sum() + np.linalg.slogdet(scaled)[1]
        loss = len(units) * rho[-1]
        for term in {p.term for p in penalties}:
            e = sum(v * p.eigen for v, p in zip(lam, penalties) if p.term == term)
            loss += np.log(e[e > 0]).sum()
        return 0.5 * (best @ h @ best - 2 * best @ rhs + known - loss)

    rho = np.log([*[m.smoothing[p.label] for p in penalties], m.smoothing["group"]])
    assert m.stats["gradient"] < fi.GRADIENT
    here = restricted(rho)
    for k in range(len(rho)):
        step = np.eye(len(rho))[k]
        slope = (restricted(rho + 0.05 * step) - restricted(rho - 0.05 * step)) / 0.1
        assert abs(slope) < 0.02, (k, slope)
        assert min(restricted(rho + step), restricted(rho - step)) > here - 0.02
    v = np.linalg.pinv(gram + np.pad(sum(m.smoothing[p.label] * p.matrix for p in penalties), (0, len(units)))
                       + np.diag([0.0] * d.p + [m.smoothing["group"]] * len(units)), rcond=1e-13)
    edf = np.diag(v @ gram)
    for term, (a, b) in d.spans.items():
        assert m.stats[f"edf {term}"] == pytest.approx(edf[a:b].sum(), abs=0.02)
    assert m.stats["edf units"] == pytest.approx(edf[d.p:].sum(), abs=0.02)


def test_strata_on_their_own_knots_equal_single_fits(subjects):
    """Overlapping strata in one set of passes against fits of each stratum's rows alone."""
    spec = de.PamSpec(factors=(("Gender", ("Female", "Male")),), baseline_k=10, time_smooths=("Age", "BMI"))
    rules = {"medical": F.col("AdmCatID") == "Medical", "old": F.col("Age") > 60, "young": F.col("Age") <= 40}
    blocks = fi.subject_blocks(subjects)
    tasks = [fi.Task(f"{n}_{e}", e, spec, r, own_basis=True) for n, r in rules.items() for e in ("delta_1", "delta_2")]
    fits = fi.fit_many(blocks, tasks, smooth=False, tol=1e-12)
    for n, r in rules.items():
        info = de.basis_info(blocks.where(r), spec)
        for e in ("delta_1", "delta_2"):
            one = fi.fit_pam(blocks.where(r), spec, e, smooth=False, tol=1e-12)
            got = fits[f"{n}_{e}"]
            assert got.info.ranges == one.info.ranges == info.ranges and np.allclose(got.info.means["Age"], info.means["Age"])
            grid = np.linalg.qr(np.random.default_rng(1).standard_normal((one.design.p, 40)))[0]
            assert np.allclose(got.beta, one.beta, atol=1e-5) and np.allclose(grid.T @ got.cov @ grid, grid.T @ one.cov @ grid, rtol=1e-3, atol=1e-4)
    assert fits["old_delta_1"].info.ranges["Age"][0] > 60


def test_many_units_and_one_of_a_third(spark):
    """50,000 small units beside one that holds a third of all subjects."""
    people = spark.range(75_000).select(
        F.col("id").alias("CombinedID"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") + 1).alias("CombinedicuID"),
        F.when(F.col("id") % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        F.lit(1.0).alias("icuByDummy"), (F.lit(5) + F.pmod(F.xxhash64("id"), F.lit(30))).alias("event_time"),
        F.lit(1).alias("delta_2"))
    spec = de.PamSpec(factors=(("Gender", ("Female", "Male")),), group="CombinedicuID")
    m = fi.fit_pam(fi.subject_blocks(people), spec, "delta_2", smooth=False, smoothing={"group": 5.0}, tol=1e-10,
                   block_units=20_000)
    assert m.groups.count() == 50_001
    assert m.stats["expected"] == pytest.approx(75_000, rel=1e-4)
    big = m.groups.where("grp = '0'").first().effect
    days = people.where("CombinedicuID = 0").groupBy("Gender").agg(
        F.sum(F.col("event_time") - 4).alias("t"), F.count(F.lit(1)).alias("e")).collect()
    mu = sum(r.t * math.exp(m.beta[0] + (m.beta[1] if r.Gender == "Male" else 0.0) + big) for r in days)
    assert sum(r.e for r in days) - mu == pytest.approx(5.0 * big, abs=1e-2)


@pytest.mark.parametrize("factor", [1e-6, 1e6])
def test_the_scale_of_a_penalty_does_not_matter(subjects, monkeypatch, factor):
    blocks = fi.subject_blocks(subjects)
    plain = fi.fit_pam(blocks, SMALL, "delta_2")
    penalties = de.Design.penalties
    monkeypatch.setattr(de.Design, "penalties", lambda self: [
        de.Penalty(p.label, p.term, p.matrix * factor, p.eigen * factor) for p in penalties(self)])
    scaled = fi.fit_pam(blocks, SMALL, "delta_2")
    assert np.allclose(scaled.beta, plain.beta, atol=1e-6) and scaled.stats["edf"] == pytest.approx(plain.stats["edf"], abs=1e-5)


def test_partitioning_does_not_matter(subjects):
    spec = de.PamSpec(factors=(("Gender", ("Female", "Male")),), group="CombinedicuID", baseline_k=10)
    fits = [fi.fit_pam(fi.subject_blocks(subjects.repartition(n)), spec, "delta_2", parts=n, tol=1e-12) for n in (1, 5)]
    assert np.allclose(fits[0].beta, fits[1].beta, atol=1e-6)


def test_several_models_at_once_equal_single_fits(subjects):
    spec = de.PamSpec(factors=(("AdmCatID", ADM),), linear=("ApacheIIScore",), baseline_k=10)
    blocks = fi.subject_blocks(subjects)
    info = de.basis_info(blocks, spec)
    rule = F.col("AdmCatID") == "Medical"
    both = fi.fit_many(blocks, [fi.Task("a", "delta_2", spec), fi.Task("b", "delta_2", spec.without("AdmCatID"), rule)],
                       info=info, tol=1e-12)
    one = fi.fit_pam(fi.subject_blocks(subjects.where(rule)), spec.without("AdmCatID"), "delta_2", info=info, tol=1e-12)
    assert np.allclose(both["b"].beta, one.beta, atol=1e-5)
    assert len(both["b"].beta) == len(both["a"].beta) - 2


def test_agrees_with_the_library_regression(subjects, spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    spec = de.PamSpec(linear=("ApacheIIScore", "Age"), time_linear=("ApacheIIScore",))
    m = fi.fit_pam(fi.subject_blocks(subjects), spec, "delta_2", smooth=False, tol=1e-13)
    rows = pe.as_ped(subjects, from_day=5, keep=["ApacheIIScore", "Age"]).withColumn(
        "inter", F.col("ApacheIIScore") * F.col("int_mid"))
    data = VectorAssembler(inputCols=["ApacheIIScore", "Age", "inter"], outputCol="f").transform(rows)
    glr = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="f", labelCol="ped_status_2",
                                      offsetCol="offset", tol=1e-12).fit(data)
    assert m.beta[1:] == pytest.approx(list(glr.coefficients), abs=1e-7)
    assert m.beta[0] == pytest.approx(glr.intercept, abs=1e-6)
    assert np.sqrt(np.diag(m.cov))[1:] == pytest.approx(glr.summary.coefficientStandardErrors[:3], rel=1e-4)


def test_recovers_a_planted_hazard(spark):
    """Known baseline, sex and exposure effects; uniforms are hashed per subject and day."""
    n = 6000
    people = spark.range(n).select(
        F.col("id").alias("CombinedID"), F.when(F.col("id") % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        F.array_repeat(F.lit(0.0), 11).alias("proteinCat3"), F.lit(11).alias("n_days"),
        F.array_repeat(F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0), 11).alias("proteinCat2"))
    days = people.select("*", F.explode(F.sequence(F.lit(5), F.lit(60))).alias("day"))
    acting = F.when((F.col("day") <= 30) & (F.col("proteinCat2")[0] == 1), 0.7).otherwise(0.0)
    eta = F.lit(-3.5) + F.when(F.col("Gender") == "Male", 0.5).otherwise(0.0) + acting
    u = (F.pmod(F.xxhash64("CombinedID", "day"), F.lit(1000003)) + 0.5) / 1000003
    first = days.where(u < 1 - F.exp(-F.exp(eta))).groupBy("CombinedID").agg(F.min("day").alias("hit"))
    c = people.join(first, "CombinedID", "left").select(
        people["*"], F.coalesce("hit", F.lit(61)).alias("event_time"), F.when(F.col("hit").isNull(), 0).otherwise(1).alias("delta_1"),
        F.lit(0).alias("delta_2"))
    spec = de.PamSpec(factors=(("Gender", ("Female", "Male")),), baseline_k=10, exposures=("proteinCat3", "proteinCat2"))
    m = fi.fit_pam(fi.subject_blocks(c), spec, "delta_1")
    at = m.names.index("GenderMale")
    assert abs(m.beta[at] - 0.5) < 3 * math.sqrt(m.cov[at, at])
    rows = pe.as_ped(c.where("CombinedID % 3 = 0").limit(1).withColumn("event_time", F.lit(30)), from_day=5,
                     keep=["Gender", "proteinCat3", "proteinCat2"])
    eff = predict_terms(rows, m, ["tend"], effect="proteinCat2").toPandas().set_index("tend")["eta_effect"]
    assert 0.45 < eff.loc[8:28].mean() < 0.95


def test_no_events_is_an_error(subjects):
    with pytest.raises(ValueError, match="no events"):
        fi.fit_pam(fi.subject_blocks(subjects.withColumn("none", F.lit(0))), de.PamSpec(), "none")


def test_absent_level_gets_no_weight(subjects):
    spec = de.PamSpec(factors=(("AdmCatID", (*ADM, "Unheard of")),))
    m = fi.fit_pam(fi.subject_blocks(subjects), spec, "delta_2", smooth=False)
    assert m.beta[3] == 0 and m.cov[3, 3] == 0


def test_a_fit_stopped_by_its_passes_raises(subjects, spec):
    with pytest.raises(RuntimeError, match="no convergence"):
        fi.fit_pam(fi.subject_blocks(subjects), spec, "delta_2", max_passes=1)


def test_the_driver_gets_one_row_a_model(spark, monkeypatch):
    rows = spark.range(400, numPartitions=40).select(
        (F.col("id") % 2).cast("int").alias("model"), F.lit(None).cast("string").alias("grp"), F.lit(0.0).alias("b"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    sent = []
    whole = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: sent.append(whole(df)) or sent[-1])
    got = fi._added(rows)
    assert {m: v.tolist() for m, v in got.items()} == {0: [39800.0, 200.0], 1: [40000.0, 200.0]}
    assert [t.num_rows for t in sent] == [2]


def test_light_penalties_are_not_switched_off_by_heavy_ones():
    """A column without data under a light penalty keeps its place however heavy another penalty is."""
    from types import SimpleNamespace
    eye = np.eye(2)
    st = SimpleNamespace(p=2, beta=np.zeros(2), gram=np.diag([1e6, 0.0]), score=np.zeros(2), pen=[
        de.Penalty(t, t, np.outer(eye[i], eye[i]), np.ones(1)) for i, t in enumerate("ab")])
    st.pseudo_traces = lambda lam: fi._State.pseudo_traces(st, lam)
    for light in (9.0, 11.0):
        got = fi._Working(st, np.log([1e13, light]), None)
        assert abs(got.gradient[1]) < 1e-9 and got.v[1, 1] == pytest.approx(1 / light)


def test_sums_go_over_days_at_risk_only(spark):
    """Blocks by their last day, of some days or of all: the sums are those of the dense design."""
    rng = np.random.default_rng(21)
    n = 300
    last, first = rng.integers(7, 61, n), rng.integers(5, 8, n)
    rows = [(int(first[i]), int(last[i]), float(rng.integers(0, 41)), float(rng.integers(18, 90)), rng.integers(0, 2, 11).astype(float).tolist(),
             float(i % 3 == 0), float(i % 5 == 0) if i % 4 else None) for i in range(n)]
    spec = de.PamSpec(linear=("a",), time_linear=("a",), baseline_k=6, time_smooths=("age",), smooth_k=6, exposures=("w",))
    df = spark.createDataFrame(rows, "from_day int, to_day int, a double, age double, w array<double>, y0 double, y1 double").withColumns(
        {"n": F.lit(1.0), "last_exposure": F.lit(0.5), "n_days": F.lit(11)})
    design = de.Design(spec, de.basis_info(df, spec))
    table = df.select("from_day", "to_day", "n", "last_exposure", F.array("y0", "y1").alias("y"), F.lit(None).cast("string").alias("grp"),
                      F.lit(0.0).alias("switch"), design.z_column().alias("z"), design.c_column().alias("c"))
    beta = {m: rng.standard_normal(design.p) / 200 - (np.arange(design.p) == 0) * 3 for m in range(2)}
    every = {m: np.arange(design.p) for m in range(2)}
    short = table.where("to_day <= 20"), table.where("to_day > 20")
    got = [fi._added(fi._pass(t.orderBy("to_day").coalesce(1), [design] * 2, beta, every)) for t in (table, *short)]
    days = df.select("*", F.explode(F.sequence("from_day", "to_day")).alias("tend"))
    dense = de.design_rows(days, design, ["tend", "to_day", "y0", "y1"]).toPandas()
    for m in range(2):
        mine = dense[dense[f"y{m}"].notna()]
        x, end = np.array(mine["x"].tolist()), (mine["tend"] == mine["to_day"]).to_numpy()
        mu = np.exp(x @ beta[m]) * np.where(end, 0.5, 1.0)
        gram, score = (x * mu[:, None]).T @ x, x.T @ (np.where(end, mine[f"y{m}"], 0) - mu)
        want = np.concatenate([fi._triangle(gram), score])
        scale = np.abs(want).max()
        assert np.allclose(got[0][m][:len(want)] / scale, want / scale, atol=1e-12)
        assert np.allclose((got[1][m] + got[2][m])[:len(want)] / scale, want / scale, atol=1e-12)
