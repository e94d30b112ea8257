"""Fitted or given models: coefficients, covariance, group effects; saving, loading, prediction."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import write_table
from ..sources.schemas import require_columns
from .design import BasisInfo, Design, PamSpec, array_values
from .exposure import WIDTH


@dataclass
class PamModel:
    """A model small enough for the driver; group effects stay a DataFrame."""

    name: str
    spec: PamSpec
    info: BasisInfo
    beta: np.ndarray
    cov: np.ndarray
    smoothing: dict[str, float] = field(default_factory=dict)
    stats: dict[str, float] = field(default_factory=dict)
    groups: DataFrame | None = None

    def __post_init__(self):
        self.design = Design(self.spec, self.info)
        if len(self.beta) != self.design.p:
            raise ValueError(f"{len(self.beta)} coefficients for {self.design.p} columns")

    @property
    def names(self) -> list[str]:
        return self.design.names

    def columns(self, pattern: str) -> np.ndarray:
        """Places of the coefficients whose name matches; at least one must."""
        hit = [i for i, n in enumerate(self.names) if re.search(pattern, n)]
        if not hit:
            raise ValueError(f"no coefficient matches {pattern!r}")
        return np.array(hit)


def save_model(model: PamModel, spark: SparkSession, path: str) -> None:
    """Coefficients, covariance and group effects as parquet, the specification as JSON."""
    rows = [(i, n, float(b)) for i, (n, b) in enumerate(zip(model.names, model.beta))]
    write_table(spark.createDataFrame(rows, "idx int, term string, estimate double"), f"{path}/coefficients")
    cov = [(i, [float(v) for v in row]) for i, row in enumerate(model.cov)]
    write_table(spark.createDataFrame(cov, "idx int, row array<double>"), f"{path}/covariance")
    if model.groups is not None:
        write_table(model.groups, f"{path}/groups")
    meta = {"name": model.name, "spec": asdict(model.spec), "info": asdict(model.info),
            "smoothing": model.smoothing, "stats": model.stats, "groups": model.groups is not None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> PamModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    spec = dict(meta["spec"])
    spec["factors"] = tuple((f, tuple(lv)) for f, lv in spec["factors"])
    for k in ("linear", "time_linear", "time_smooths", "exposures"):
        spec[k] = tuple(spec[k])
    info = BasisInfo({k: tuple(v) for k, v in meta["info"]["ranges"].items()}, meta["info"]["means"],
                     meta["info"]["lag_lead"])
    beta = [r.estimate for r in spark.read.parquet(f"{path}/coefficients").orderBy("idx").collect()]
    cov = [r.row for r in spark.read.parquet(f"{path}/covariance").orderBy("idx").collect()]
    groups = spark.read.parquet(f"{path}/groups") if meta["groups"] else None
    return PamModel(meta["name"], PamSpec(**spec), info, np.array(beta), np.array(cov),
                    meta["smoothing"], meta["stats"], groups)


class RowParts:
    """What the linear predictors of several models need of a row at risk, every number once, as one array column.

    Subjects may carry the column (``added``) before their rows are generated. Rows that follow one another with equal
    parts, as those of a subject do, share one expansion into splines and one product with the weights of the days.
    """

    COLUMN = "_parts"

    def __init__(self, models: Sequence[PamModel]):
        columns: dict[str, Column] = {}
        for m in models:
            columns |= m.design.z_parts()
        windows = list(dict.fromkeys(v for m in models for v in m.spec.exposures))
        self.sources = list(dict.fromkeys(v for m in models for v in [*m.spec.covariates, *m.spec.exposures]))
        self.column = F.concat(F.array(*columns.values()), *[
            F.coalesce(F.col(v), F.array_repeat(F.lit(None).cast("double"), WIDTH)) for v in windows])
        self.place = {n: i for i, n in enumerate(columns)}
        self.at = {v: len(columns) + i * WIDTH for i, v in enumerate(windows)}
        self.width = len(columns) + WIDTH * len(windows)

    def added(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.sources, "rows at risk")
        return df.withColumn(self.COLUMN, self.column)

    def fold(self, design: Design, betas: Sequence[np.ndarray]) -> "_Fold":
        raw = np.array([self.place[n] for n, _ in design.z_parts()])
        c = np.array([self.at[v] + d for v in design.spec.exposures for d in range(WIDTH)], dtype=int)
        return _Fold(design, betas, raw, c)


class _Fold:
    """Coefficients over one design, folded into one weight vector per day; ``raw`` and ``c`` are its places in the parts."""

    def __init__(self, design: Design, betas: Sequence[np.ndarray], raw: np.ndarray, c: np.ndarray):
        self.design, self.raw, self.c = design, raw, c
        self.first, self.n_days = design.spec.first_day, design.spec.last_day - design.spec.first_day + 1
        self.weights = [np.array([design.part_weights(b, self.first + d) for d in range(self.n_days)]) for b in betas]

    def parts(self, values: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expanded parts, and whether one is missing; a missing argument of a smooth adds nothing."""
        spec = self.design.spec
        plain = len(self.raw) - len(spec.time_smooths)
        out, gaps = self.design.expand(values[:, self.raw]), gone[:, self.raw]
        for i in range(len(spec.time_smooths)):
            at = plain + i * spec.smooth_k
            out[gaps[:, plain + i], at:at + spec.smooth_k] = 0.0
        unknown = gaps[:, :plain].any(axis=1) | gone[:, self.c].any(axis=1)
        return np.hstack([out, values[:, self.c]]) if len(self.c) else out, unknown

    def day(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' days, and whether a day is missing or not the model's."""
        day = batch.column("_day").fill_null(self.first - 1).to_numpy() - self.first
        return np.clip(day, 0, self.n_days - 1), (day < 0) | (day >= self.n_days)

    def eta(self, parts: np.ndarray, of: np.ndarray, day: np.ndarray) -> list[np.ndarray]:
        """Linear predictors of rows on ``day`` that have the parts ``of``, per coefficient vector."""
        if len(parts) * self.n_days <= 8 * len(of):  # the parts serve many rows
            every = parts @ np.vstack(self.weights).T
            return [every[of, day + i * self.n_days] for i in range(len(self.weights))]
        mine = parts[of]
        return [np.einsum("ij,ij->i", mine, w[day]) for w in self.weights]


def row_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that follow a row of equal values belong to its run: the first rows of the runs, and the run of every row."""
    new = np.append(True, (values[1:] != values[:-1]).any(axis=1))
    return np.flatnonzero(new), np.cumsum(new) - 1


def predict_terms(df: DataFrame, model: PamModel | Mapping[str, PamModel], keep: Sequence[str],
                  effect: str | None = None) -> DataFrame:
    """Linear predictor ``eta`` of every row, without offset and without the group effect.

    With ``effect`` also its part from the coefficients whose name matches, as ``eta_effect``. Of several models, by
    name, the columns are ``eta_<name>`` and ``eta_effect_<name>``, told in one pass. The
    coefficients are first folded into one weight vector per day, so a row costs one inner product of its
    parts, batch by batch, and no design row is built. A missing covariate, or a day past the model's, gives
    a null; a missing argument of a smooth adds nothing.
    """
    several = isinstance(model, Mapping)
    models = dict(model) if several else {"": model}
    parts = RowParts(list(models.values()))
    require_columns(df, ["tend", *keep], "rows at risk")
    folds, names = [], []
    for at in shared_designs(list(models.values())):
        betas, of = [], []
        for name, m in [list(models.items())[i] for i in at]:
            end = f"_{name}" if several else ""
            betas.append(m.beta)
            of.append(f"eta{end}")
            if effect is not None:
                hit = m.columns(effect)
                betas.append(np.zeros_like(m.beta))
                betas[-1][hit] = m.beta[hit]
                of.append(f"eta_effect{end}")
        folds.append((parts.fold(m.design, betas), of))
        names += of
    width = parts.width

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, gone = _values_and_gaps(batch, RowParts.COLUMN, width)
            first, run = row_runs(values)
            out = []
            for fold, of in folds:
                mine, unknown = fold.parts(values[first], gone[first])
                day, outside = fold.day(batch)
                mask = unknown[run] | outside
                out += [pa.array(v, mask=mask) for v in fold.eta(mine, run, day)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *out], names=[*keep, *names])

    rows = (df if RowParts.COLUMN in df.columns else parts.added(df)).select(
        *keep, F.col("tend").cast("int").alias("_day"), RowParts.COLUMN)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return rows.mapInArrow(score, ", ".join([*([types] if types else []), *[f"`{c}` double" for c in names]])).select(
        *keep, *sorted(names, key=lambda c: c.startswith("eta_effect")))


def shared_designs(models: Sequence[PamModel]) -> list[list[int]]:
    """Models by what they share: one specification over one basis."""
    out: list[list[int]] = []
    for i, m in enumerate(models):
        known = next((of for of in out if models[of[0]].info is m.info and models[of[0]].spec == m.spec), None)
        if known is None:
            out.append([i])
        else:
            known.append(i)
    return out


def unit_effects(models: Sequence[PamModel]) -> DataFrame:
    """Every unit's effects in several models, ``grp, effects``: null where a model does not know the unit."""
    every = [m.groups.select("grp", "effect", F.lit(i).alias("model")) for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, every).groupBy("grp").agg(F.array(*[
        F.max(F.when(F.col("model") == i, F.col("effect"))) for i in range(len(models))]).alias("effects"))


def _values_and_gaps(batch: pa.RecordBatch, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed-length array column as a matrix, and where it has nulls."""
    flat = batch.column(name).flatten()
    gaps = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else np.zeros(len(flat), dtype=bool)
    return array_values(batch, name, width), gaps.reshape(-1, width)


def coefficient_frame(model: PamModel, spark: SparkSession) -> DataFrame:
    """Parametric coefficients with standard error and z value."""
    se = np.sqrt(np.clip(np.diag(model.cov), 0, None))
    rows = [(i, model.names[i], float(model.beta[i]), float(se[i]),
             float(model.beta[i] / se[i]) if se[i] > 0 else None) for i in range(model.design.parametric)]
    return spark.createDataFrame(rows, "idx int, term string, estimate double, se double, z double").withColumn(
        "model", F.lit(model.name))
