"""Cumulative incidence of competing causes from coefficient draws."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import mean_and_quantiles
from ..functions.scalars import normal_quantile_column
from .design import array_values, design_rows
from .model import PamModel

SMALL = 1e-10
CAUSE_NAMES = ("death", "extubation")


def lower_root(cov: np.ndarray) -> np.ndarray:
    """L with L L' = cov: lower triangular on the coefficients that vary, as far as these are not collinear."""
    live = np.flatnonzero(np.diag(cov) > 0)
    scale = np.sqrt(np.diag(cov)[live])
    sub = cov[np.ix_(live, live)] / np.outer(scale, scale)
    try:
        part = np.linalg.cholesky(sub)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(sub)
        part = vectors * np.sqrt(np.clip(values, 0, None))
    root = np.zeros_like(cov)
    root[np.ix_(live, live)] = scale[:, None] * part
    return root


def standard_normals(draw: Column, n: int, seed: int) -> Column:
    """``n`` standard normals of a draw as an array, the same on every engine and partitioning.

    Number j is the normal quantile of the first 52 bits of the MD5 digest of ``seed:draw:j``.
    """
    def uniform(j: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), j.cast("string")))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), uniform), normal_quantile_column)


def posterior_draws(model: PamModel, spark: SparkSession, n_sim: int = 500, seed: int = 1) -> DataFrame:
    """Normal draws ``sim_id, beta`` with the model's mean and covariance."""
    mean, root = model.beta, lower_root(model.cov)

    def shifted(batches):
        for batch in batches:
            beta = mean + array_values(batch, "z", len(mean)) @ root.T
            yield pa.RecordBatch.from_arrays([batch.column("sim_id"), pa.array(list(beta), pa.list_(pa.float64()))],
                                             names=["sim_id", "beta"])

    ids = spark.range(n_sim).withColumnRenamed("id", "sim_id")
    return ids.select("sim_id", standard_normals(F.col("sim_id"), len(mean), seed).alias("z")).mapInArrow(
        shifted, "sim_id bigint, beta array<double>")


def draw_moments(draws: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of given draws; every task adds up its vectors' products."""
    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                b = array_values(batch, "beta", len(batch.column("beta")[0]))
                b = np.hstack([np.ones((len(b), 1)), b])
                total = b.T @ b if total is None else total + b.T @ b
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                names=["i", "j", "v"])

    got = (draws.select("beta").mapInArrow(sums, "i int, j int, v double")
           .groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas())
    m = np.zeros((got["i"].max() + 1,) * 2)
    m[got["i"], got["j"]] = got["v"]
    m[got["j"], got["i"]] = got["v"]
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return mean, (m[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)


def zero_moments(spec) -> tuple[np.ndarray, np.ndarray]:
    """Placeholder coefficients of a model that is only used for its design."""
    p = 1 + len(spec.exposures) * spec.exposure_k ** 2
    return np.zeros(p), np.zeros((p, p))


def prediction_matrix(model: PamModel, frames: DataFrame, most: int = 10_000):
    """Design of the prediction rows of one template: labels and matrix.

    The rows are protocols times days. A second template would mix its curves with the first one's and
    is refused, as are more than ``most`` rows.
    """
    rows = design_rows(frames, model.design, ["protocol", "tstart", "tend"]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} prediction rows")
    rows.sort(key=lambda r: (r.protocol, r.tend))
    labels = [(r.protocol, r.tend, float(r.tend - r.tstart)) for r in rows]
    if len({(p, t) for p, t, _ in labels}) < len(labels):
        raise ValueError("prediction rows of more than one template")
    return labels, np.array([r.x for r in rows])


def _scored(draws: Sequence[DataFrame], models: Sequence[PamModel], frames: DataFrame, finish, names: Sequence[str],
            with_length: bool) -> DataFrame:
    """Hazards of every draw on every prediction row, passed through ``finish`` where the draws are.

    The causes' draws are paired by ``sim_id``. ``finish`` gets one (draws, rows) matrix per cause, the
    interval lengths and the span of rows of each protocol, and returns one matrix per name.
    """
    known: dict[int, tuple] = {}
    for m in models:
        if id(m) not in known:
            known[id(m)] = prediction_matrix(m, frames)
    labels = known[id(models[0])][0]
    mats = [known[id(m)][1].T for m in models]
    joined = None
    for i, d in enumerate(draws):
        one = d.select("sim_id", F.col("beta").alias(f"b{i}"))
        joined = one if joined is None else joined.join(one, "sim_id")
    protocol = pa.array([p for p, _, _ in labels])
    tend = np.array([t for _, t, _ in labels], dtype=np.int32)
    length = np.array([n for _, _, n in labels])
    starts = [i for i, (p, _, _) in enumerate(labels) if not i or labels[i - 1][0] != p]
    spans = list(zip(starts, [*starts[1:], len(labels)]))
    chunk = max(1, 200_000 // max(1, len(labels)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                n = batch.num_rows
                hazards = [np.exp(array_values(batch, f"b{i}", m.shape[0]) @ m) for i, m in enumerate(mats)]
                head = [pa.array(np.repeat(batch.column("sim_id").to_numpy(), len(labels))),
                        pa.concat_arrays([protocol] * n), pa.array(np.tile(tend, n))]
                if with_length:
                    head.append(pa.array(np.tile(length, n)))
                yield pa.RecordBatch.from_arrays(
                    [*head, *[pa.array(v.ravel()) for v in finish(hazards, length, spans)]], names=columns)

    columns = ["sim_id", "protocol", "tend", *(["intlen"] if with_length else []), *names]
    kinds = ", ".join(f"`{c}` double" for c in columns[3:])
    return joined.mapInArrow(score, f"sim_id bigint, protocol string, tend int, {kinds}")


def cause_hazards(draws: Sequence[DataFrame], models: Sequence[PamModel], frames: DataFrame,
                  causes: Sequence[str] = CAUSE_NAMES) -> DataFrame:
    """Hazards ``sim_id, protocol, tend, intlen, <cause>...`` of every draw on every prediction row."""
    return _scored(draws, models, frames, lambda hazards, length, spans: hazards, causes, True)


def cif_curves(draws: Sequence[DataFrame], models: Sequence[PamModel], frames: DataFrame,
               causes: Sequence[str] = CAUSE_NAMES) -> DataFrame:
    """Survival and cumulative incidence as `cif` gives them, summed along the days inside the batch of draws.

    All days of a draw leave one task anyway, so nothing is shuffled or sorted to add them up.
    """
    def curves(hazards, length, spans):
        total = sum(hazards)
        alive = np.empty_like(total)
        parts = [np.empty_like(total) for _ in hazards]
        for a, b in spans:
            alive[:, a:b] = np.exp(-np.cumsum(total[:, a:b] * length[a:b], axis=1))
            for part, h in zip(parts, hazards):
                part[:, a:b] = np.cumsum(h[:, a:b] * (alive[:, a:b] - SMALL) * length[a:b], axis=1)
        return [alive, *parts]

    return _scored(draws, models, frames, curves, ["survival", *[f"cif_{c}" for c in causes]], False)


def cif(hazards: DataFrame, causes: Sequence[str] = CAUSE_NAMES) -> DataFrame:
    """Survival and cumulative incidence per draw, protocol and day, from a table of hazards.

    Survival is taken at the end of the interval, less 1e-10, and starts at the first prediction day.
    """
    path = Window.partitionBy("sim_id", "protocol").orderBy("tend").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    total = sum((F.col(c) for c in causes[1:]), F.col(causes[0]))
    alive = hazards.withColumn("survival", F.exp(-F.sum(total * F.col("intlen")).over(path)))
    return alive.select("sim_id", "protocol", "tend", "survival", *[
        F.sum(F.col(c) * (F.col("survival") - SMALL) * F.col("intlen")).over(path).alias(f"cif_{c}")
        for c in causes])


def cif_band(curves: DataFrame, causes: Sequence[str] = CAUSE_NAMES, alpha: float = 0.05,
             few_draws: bool = False) -> DataFrame:
    """Mean and quantile band over the draws per protocol, day and cause.

    ``few_draws`` states that the number of draws is a chosen setting (500 by default), so a group
    fits one aggregation buffer; otherwise the exact distributed quantiles are used.
    """
    cols = [f"cif_{c}" for c in causes]
    keys = ["protocol", "tend"]
    probs = [alpha / 2, 1 - alpha / 2]
    cause = F.regexp_replace("variable", "^cif_", "")
    if few_draws:
        pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in cols])
        long = curves.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
        return long.groupBy(*keys, "variable").agg(
            F.avg("value").alias("cif"), F.percentile("value", F.array(*map(F.lit, probs))).alias("q")
        ).select(*keys, cause.alias("cause"), "cif", F.col("q")[0].alias("cif_lower"),
                 F.col("q")[1].alias("cif_upper"))
    both = mean_and_quantiles(curves, keys, cols, probs, bins=8)
    return both.select(*keys, cause.alias("cause"), F.col("mean").alias("cif"), F.col("q0").alias("cif_lower"),
                       F.col("q1").alias("cif_upper"))


def broken_curves(curves: DataFrame, causes: Sequence[str] = CAUSE_NAMES, slack: float = 1e-9) -> DataFrame:
    """Per protocol how many points there are, where survival and incidences exceed one, and where an incidence falls."""
    names = [f"cif_{c}" for c in causes]
    path = Window.partitionBy("sim_id", "protocol").orderBy("tend")
    above = F.col("survival") + sum((F.col(c) for c in names[1:]), F.col(names[0])) > 1 + slack
    falls = reduce(lambda x, y: x | y, [F.coalesce(F.lag(c).over(path) > F.col(c) + slack, F.lit(False)) for c in names])
    return curves.select("protocol", above.cast("int").alias("above"), falls.cast("int").alias("falls")).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("above").alias("above_one"), F.sum("falls").alias("falling"))


def paired_bands(band: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bands arranged by comparison, each with its two protocols under their labels."""
    sides = pairs.unpivot(["comparison", "name"], ["p1", "p2"], "side", "protocol")
    return (band.join(F.broadcast(sides), "protocol")
            .join(F.broadcast(labels.select("protocol", "label")), "protocol")
            .select("comparison", F.col("name").alias("comparison_text"), "protocol", "label", "tend",
                    (F.col("tend") - F.lit(0.5)).alias("int_mid"), "cause", "cif", "cif_lower", "cif_upper"))
