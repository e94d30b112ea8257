import numpy as np
import pytest
from pyspark.sql import functions as F

from pamspark.functions.basis import bspline_columns, bspline_values, centring, difference_penalty
from pamspark.operators import design as de
from pamspark.operators import exposure as ex
from pamspark.operators import ped as pe


def truncated(x, lo, hi, k):
    """Independent reference: truncated powers over evenly spaced knots."""
    span = hi - lo
    h = 1.002 * span / (k - 3)
    knots = lo - 0.001 * span + h * np.arange(-3, k + 1)
    c = (1, -4, 6, -4, 1)
    return np.stack([sum(c[r] * np.maximum((x - knots[i + r]) / h, 0) ** 3 for r in range(5)) / 6 for i in range(k)], 1)


@pytest.mark.parametrize("k", [5, 10])
def test_basis(spark, k):
    x = np.linspace(18, 90, 77)
    b = bspline_values(x, 18, 90, k)
    assert np.allclose(b.sum(axis=1), 1) and np.allclose(b, truncated(x, 18.0, 90.0, k), atol=1e-9)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([r[0] for r in df.select(F.array(*bspline_columns(F.col("x"), 18.0, 90.0, k))).collect()])
    assert np.allclose(got, b, atol=1e-12)


def test_penalty_and_centring():
    s = difference_penalty(10, 2)
    assert np.linalg.matrix_rank(s) == 8 and np.allclose(s @ np.arange(10), 0)
    mean = bspline_values(np.linspace(0, 1, 50), 0, 1, 10).mean(axis=0)
    z = centring(mean)
    assert z.shape == (10, 9) and np.allclose(mean @ z, 0) and np.allclose(z.T @ z, np.eye(9))


def spec_and_info(subjects, spark):
    from pamspark.operators.fit import subject_blocks
    spec = de.main_spec(de.observed_levels(subjects, de.FACTORS))
    return spec, de.basis_info(subject_blocks(subjects), spec)


def test_basis_info_matches_the_rows(subjects, spark):
    spec, info = spec_and_info(subjects, spark)
    rows = pe.as_ped(subjects, from_day=5, keep=["Age"]).select("Age", "int_mid").toPandas()
    for col, key in (("Age", "Age"), ("int_mid", "int_mid")):
        lo, hi = info.ranges[key]
        assert (lo, hi) == (rows[col].min(), rows[col].max())
        assert np.allclose(info.means[key], bspline_values(rows[col].to_numpy(), lo, hi, 10).mean(axis=0))
    assert info.ranges["t"] == (0.0, 59.5) and info.ranges["tz"] == (0.0, 12.0)


def test_design_rows_by_hand(subjects, spark):
    spec, info = spec_and_info(subjects, spark)
    d = de.Design(spec, info)
    rows = pe.as_ped(subjects.limit(20), from_day=5, keep=["CombinedID", *spec.covariates, *spec.exposures])
    got = de.design_rows(rows, d, ["CombinedID", "tend", "Age", "ApacheIIScore", "Gender", "proteinCat3", "int_mid"]).toPandas()
    x = np.stack(got["x"].to_numpy())
    at = {n: i for i, n in enumerate(d.names)}
    assert x.shape[1] == d.p == len(set(d.names))
    assert np.allclose(x[:, at["(Intercept)"]], 1)
    assert np.allclose(x[:, at["GenderMale"]], got["Gender"] == "Male")
    assert np.allclose(x[:, at["ApacheIIScore:int_mid"]], got["ApacheIIScore"] * got["int_mid"])
    a, b = d.spans["s(Age):int_mid"]
    age = bspline_values(got["Age"].to_numpy(), *info.ranges["Age"], 10) @ centring(np.array(info.means["Age"]))
    assert np.allclose(x[:, a:b], age * got["int_mid"].to_numpy()[:, None])
    a, b = d.spans["te(t,tz):I(LL * proteinCat3)"]
    bt = bspline_values(got["int_mid"].to_numpy(), *info.ranges["t"], 5)
    bz = bspline_values(np.arange(2, 13), *info.ranges["tz"], 5)
    for i, r in got.iterrows():
        ll = [float(r.tend >= q + 4 and r.tend <= 3 * q + 10) for q in range(1, 12)]
        w = (np.array(ll) * np.array(r.proteinCat3)) @ bz
        assert np.allclose(x[i, a:b], np.outer(bt[i], w).ravel())


def test_tensor_column_equals_the_design(subjects, spark):
    spec = de.PamSpec(exposures=("proteinCat3",))
    info = de.BasisInfo({"t": (0.0, 59.5), "tz": (0.0, 12.0), "int_mid": (4.5, 59.5)}, {},
                        de.lag_lead_weights(spark, ex.protein_lag_lead, 60))
    rows = pe.as_ped(subjects.limit(15), from_day=5, keep=["CombinedID", "proteinCat3"])
    rows = rows.withColumn("tensor", de.tensor_exposure(F.col("tend"), F.col("proteinCat3"), info.ranges))
    got = de.design_rows(rows, de.Design(spec, info), ["tensor"]).toPandas()
    assert np.allclose(np.stack(got["x"].to_numpy())[:, 1:], np.stack(got["tensor"].to_numpy()))


def test_observed_levels_refuses_identifiers(subjects):
    with pytest.raises(ValueError, match="levels"):
        de.observed_levels(subjects, ["CombinedID"], most=10)


def test_spec_without():
    spec = de.main_spec({f: ("a", "b") for f in de.FACTORS})
    small = spec.without("BMI", "AdmCatID")
    assert "BMI" not in small.time_smooths and "AdmCatID" not in dict(small.factors)
