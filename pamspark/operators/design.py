"""Model terms and the design they imply.

A design row depends on the subject and, in a fixed way, on the day: ``x = K(day)' z`` where ``z``
holds the subject's covariates, raw spline values and, for the exposures, the lag-lead weighted spline
sums of its diary. ``z`` is built from column expressions; ``K(day)`` is a small matrix of the
specification. Rows at risk thus need not be widened, or even generated, before they are summed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import bspline_columns, bspline_values, centring, difference_penalty
from ..functions.scalars import add_all
from ..sources.schemas import require_columns
from .exposure import WIDTH, LagLead, lag_lead, protein_lag_lead
from .ped import FOLLOW_UP

@dataclass(frozen=True)
class PamSpec:
    """Terms of a piecewise-exponential additive model, in place of a formula text."""

    factors: tuple[tuple[str, tuple[str, ...]], ...] = ()
    linear: tuple[str, ...] = ()
    time_linear: tuple[str, ...] = ()
    baseline_k: int = 0
    time_smooths: tuple[str, ...] = ()
    smooth_k: int = 10
    group: str | None = None
    group_switch: str = "icuByDummy"
    exposures: tuple[str, ...] = ()
    exposure_k: int = 5
    first_day: int = 5
    last_day: int = FOLLOW_UP

    def without(self, *names: str) -> "PamSpec":
        """The same model without some covariates, as the subgroup models need."""
        def keep(seq):
            return tuple(s for s in seq if (s[0] if isinstance(s, tuple) else s) not in names)
        return PamSpec(**{**self.__dict__, "factors": keep(self.factors), "linear": keep(self.linear),
                          "time_linear": keep(self.time_linear), "time_smooths": keep(self.time_smooths)})

    @property
    def covariates(self) -> list[str]:
        return list(dict.fromkeys([*[f for f, _ in self.factors], *self.linear, *self.time_linear,
                                   *self.time_smooths]))


FACTORS = ("Year", "DiagID2", "AdmCatID", "Gender")


def main_spec(levels: dict[str, Sequence[str]]) -> PamSpec:
    """The model of both causes: year, severity, age, BMI, diagnosis, admission, therapies, unit, intake.

    ``levels`` lists the levels of every factor, the reference level first.
    """
    return PamSpec(
        factors=tuple((f, tuple(levels[f])) for f in FACTORS),
        linear=("ApacheIIScore", "inMV2_4", "Propofol2_4", "OralIntake2_4", "PN2_4"),
        time_linear=("ApacheIIScore",), baseline_k=10, time_smooths=("Age", "BMI"),
        group="CombinedicuID", exposures=("proteinCat3", "proteinCat2"))


@dataclass
class BasisInfo:
    """What a design takes from the data: covariate ranges, spline means and the lag-lead table."""

    ranges: dict[str, tuple[float, float]]
    means: dict[str, list[float]]
    lag_lead: list[list[float]] = field(default_factory=list)


def observed_levels(df: DataFrame, cols: Sequence[str], most: int = 1000) -> dict[str, tuple[str, ...]]:
    """Sorted levels of categorical columns, found in one pass; refuses identifier-like columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    rows = (df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
            .distinct().limit(most * len(cols) + 1).collect())
    if len(rows) > most * len(cols):
        raise ValueError(f"more than {most} levels in {', '.join(cols)}")
    return {c: tuple(sorted(r.v for r in rows if r.c == c)) for c in cols}


def lag_lead_weights(spark, pred: LagLead, last_day: int) -> list[list[float]]:
    """The lag-lead table as a (last_day + 1) x width list; its size is fixed by the follow-up."""
    out = np.zeros((last_day + 1, WIDTH))
    for r in lag_lead(spark, range(last_day + 1), pred=pred).collect():
        out[r.t, r.tz - 1] = r.LL
    return out.tolist()


def basis_info(blocks: DataFrame, spec: PamSpec, pred: LagLead = protein_lag_lead) -> BasisInfo:
    """Ranges and spline means over the rows at risk, from blocks of days (two small aggregates).

    The exposure ranges include the zeros that padded diary days carry.
    """
    return basis_infos(blocks, spec, pred, {"all": F.lit(True)})["all"]


def basis_infos(blocks: DataFrame, spec: PamSpec, pred: LagLead, strata: dict[str, Column]) -> dict[str, BasisInfo]:
    """``basis_info`` of several strata, which may overlap, in the same two aggregates."""
    names = list(strata)
    belongs = F.filter(F.array(*[F.when(rule, i) for i, rule in enumerate(strata.values())]), lambda i: i.isNotNull())
    rows = blocks.withColumn("stratum", F.explode(belongs))
    aggs = [F.sum("n").alias("n")]
    for v in spec.time_smooths:
        aggs += [F.min(v).cast("double").alias(f"{v}_lo"), F.max(v).cast("double").alias(f"{v}_hi")]
    if spec.exposures:
        aggs.append(F.min("n_days").alias("n_days"))
    found = rows.groupBy("stratum", "from_day", "to_day").agg(*aggs).collect()  # at most one row per stratum and pair of days
    table = lag_lead_weights(blocks.sparkSession, pred, spec.last_day)
    out = {}
    for i, name in enumerate(names):
        spans = [x for x in found if x.stratum == i]
        if not spans:
            raise ValueError(f"no rows at risk in {name}")
        first, last = min(x.from_day for x in spans), max(x.to_day for x in spans)
        ranges: dict[str, tuple[float, float]] = {"int_mid": (first - 0.5, last - 0.5)}
        for v in spec.time_smooths:
            ranges[v] = (min(x[f"{v}_lo"] for x in spans), max(x[f"{v}_hi"] for x in spans))
        if spec.exposures:
            padded = min(x.n_days for x in spans) < WIDTH
            ranges["t"] = (0.0 if padded else first - 0.5, last - 0.5)
            ranges["tz"] = (0.0 if padded else 2.0, WIDTH + 1.0)
        means: dict[str, list[float]] = {}
        if spec.baseline_k:
            per_day = np.zeros(last + 1)
            for x in spans:
                per_day[x.from_day:x.to_day + 1] += x.n
            b = bspline_values(np.arange(first, last + 1) - 0.5, *ranges["int_mid"], spec.baseline_k)
            w = per_day[first:]
            means["int_mid"] = (w @ b / w.sum()).tolist()
        out[name] = BasisInfo(ranges, means, table)
    if spec.time_smooths:
        days = F.col("n") * (F.col("to_day") - F.col("from_day") + 1)
        found = _spline_means(rows, days, [{v: out[x].ranges[v] for v in spec.time_smooths} for x in names], spec.smooth_k)
        for name, means in zip(names, found):
            out[name].means.update(means)
    return out


def _spline_means(rows: DataFrame, weight: Column, ranges: list[dict[str, tuple[float, float]]],
                  k: int) -> list[dict[str, list[float]]]:
    """Weighted means of the spline columns per stratum; each task adds up its batches and emits one array per stratum."""
    names = list(ranges[0])

    def sums(batches):
        total = np.zeros((len(ranges), 1 + k * len(names)))
        for batch in batches:
            stratum, w = batch.column("stratum").to_numpy(), batch.column("w").to_numpy()
            x = {v: batch.column(v).to_numpy() for v in names}
            for i in np.unique(stratum):
                at = stratum == i
                total[i] += np.concatenate([[w[at].sum()], *[
                    w[at] @ bspline_values(x[v][at], *ranges[i][v], k) for v in names]])
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["k", "v"])

    got = (rows.select("stratum", weight.cast("double").alias("w"), *[F.col(v).cast("double").alias(v) for v in names])
           .mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect())
    v = np.zeros(len(got))
    for r in got:
        v[r.k] = r.v
    return [{name: (row[1 + i * k:1 + (i + 1) * k] / row[0]).tolist() for i, name in enumerate(names)}
            for row in v.reshape(len(ranges), -1)]


@dataclass
class Penalty:
    """One smoothing parameter: its matrix on the coefficients, and its non-zero pseudo-eigenvalues.

    Terms that share a parameter share one Penalty. Overlapping penalties of one term name the same
    ``term`` and carry eigenvalues in a common order.
    """

    label: str
    term: str
    matrix: np.ndarray
    eigen: np.ndarray


class Design:
    """Coefficient names, subject columns, day matrices and penalties of a specification."""

    def __init__(self, spec: PamSpec, info: BasisInfo):
        self.spec, self.info = spec, info
        self.z_names = ["1"]
        self.names: list[str] = ["(Intercept)"]
        entries = [(0, "one", None)]
        spans: dict[str, tuple[int, int]] = {}
        for f, levels in spec.factors:
            for lv in levels[1:]:
                entries.append((self._add_z(f"{f}{lv}"), "one", None))
                self.names.append(f"{f}{lv}")
        for v in dict.fromkeys([*spec.linear, *spec.time_linear]):
            self._add_z(v)
        for v in spec.linear:
            entries.append((self.z_names.index(v), "one", None))
            self.names.append(v)
        for v in spec.time_linear:
            entries.append((self.z_names.index(v), "mid", None))
            self.names.append(f"{v}:int_mid")
        self.parametric = len(self.names)
        if spec.baseline_k:
            self._span(spans, "s(int_mid)", spec.baseline_k - 1)
            entries.append((0, "baseline", centring(np.array(info.means["int_mid"]))))
        self.raw_width = len(self.z_names) + len(spec.time_smooths)
        for v in spec.time_smooths:
            at = len(self.z_names)
            self.z_names += [f"{v}#{i}" for i in range(spec.smooth_k)]
            self._span(spans, f"s({v}):int_mid", spec.smooth_k - 1)
            entries.append((at, "smooth", centring(np.array(info.means[v]))))
        self.fixed_width = len(self.z_names)
        for v in spec.exposures:
            self._span(spans, f"te(t,tz):I(LL * {v})", spec.exposure_k ** 2)
        self.entries, self.spans, self.p = entries, spans, len(self.names)
        self._blocks()
        self.width = self.fixed_width + spec.exposure_k * len(spec.exposures)
        self._maps: dict[int, np.ndarray] = {}
        self._weights: dict[int, np.ndarray] = {}

    def _blocks(self) -> None:
        """Places of the coefficients by how the day enters: not at all, times its middle, as a spline, in a tensor."""
        one, mid, base, col = [], [], [], 0
        self.one_z: list[int] = []
        self.mid_z: list[tuple[int, np.ndarray | None]] = []
        for at, kind, z in self.entries:
            n = 1 if z is None else z.shape[1]
            here = list(range(col, col + n))
            if kind == "one":
                one += here
                self.one_z.append(at)
            elif kind == "baseline":
                base += here
            else:
                mid += here
                self.mid_z.append((at, z))
            col += n
        self.one_cols, self.mid_cols, self.base_cols = (np.array(v, dtype=int) for v in (one, mid, base))
        self.exposure_cols = np.arange(col, self.p)

    def subject_blocks(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The covariates of the first two kinds of coefficients."""
        mid = [z[:, [at]] if c is None else z[:, at:at + c.shape[0]] @ c for at, c in self.mid_z]
        return np.ascontiguousarray(z[:, self.one_z]), np.hstack(mid) if mid else np.zeros((len(z), 0))

    def day_blocks(self, days: np.ndarray) -> dict[str, np.ndarray]:
        """What the day contributes: middle, centred baseline splines, splines of t and tz, lag-lead entries."""
        s, mid = self.spec, days - 0.5
        out = {"mid": mid, "base": np.zeros((len(days), 0))}
        if s.baseline_k:
            out["base"] = (bspline_values(mid, *self.info.ranges["int_mid"], s.baseline_k)
                           @ centring(np.array(self.info.means["int_mid"])))
        if s.exposures:
            out["bt"] = bspline_values(mid, *self.info.ranges["t"], s.exposure_k)
            out["bz"] = bspline_values(np.arange(1, WIDTH + 1) + 1, *self.info.ranges["tz"], s.exposure_k)
            out["ll"] = np.array(self.info.lag_lead)[days]
        return out

    def _add_z(self, name: str) -> int:
        self.z_names.append(name)
        return len(self.z_names) - 1

    def _span(self, spans, label: str, n: int) -> None:
        spans[label] = (len(self.names), len(self.names) + n)
        self.names += [f"{label}.{i + 1}" for i in range(n)]

    def __getstate__(self):
        return {"spec": self.spec, "info": self.info}

    def __setstate__(self, state):
        self.__init__(state["spec"], state["info"])

    def z_parts(self) -> list[tuple[str, Column]]:
        """The subject's covariates by name: constant, dummies, numbers, smooth arguments."""
        s = self.spec
        out = [("1", F.lit(1.0))]
        out += [(f"{f}{lv}", F.when(F.col(f) == lv, 1.0).otherwise(0.0)) for f, levels in s.factors for lv in levels[1:]]
        return out + [(v, F.col(v).cast("double")) for v in [*dict.fromkeys([*s.linear, *s.time_linear]), *s.time_smooths]]

    def z_column(self) -> Column:
        """The subject's covariates as one compact array column."""
        return F.array(*[c for _, c in self.z_parts()])

    def expand(self, raw: np.ndarray) -> np.ndarray:
        """Replace the smooth arguments by their spline values."""
        s = self.spec
        if not s.time_smooths:
            return raw
        at = self.raw_width - len(s.time_smooths)
        return np.hstack([raw[:, :at], *[
            bspline_values(raw[:, at + i], *self.info.ranges[v], s.smooth_k)
            for i, v in enumerate(s.time_smooths)]])

    def c_column(self) -> Column:
        """The diary windows of all exposures in one array column."""
        if not self.spec.exposures:
            return F.array().cast("array<double>")
        return F.concat(*[F.col(v) for v in self.spec.exposures])

    def day_weights(self, day: int) -> np.ndarray:
        """Diary day x spline of tz, already multiplied by the lag-lead entries of the day."""
        if day not in self._weights:
            b = bspline_values(np.arange(1, WIDTH + 1) + 1, *self.info.ranges["tz"], self.spec.exposure_k)
            self._weights[day] = np.array(self.info.lag_lead[day])[:, None] * b
        return self._weights[day]

    def day_map(self, day: int) -> np.ndarray:
        """K(day): subject part (rows) to coefficients (columns)."""
        if day in self._maps:
            return self._maps[day]
        s, mid = self.spec, day - 0.5
        k = np.zeros((self.width, self.p))
        col = 0
        for at, kind, z in self.entries:
            if kind == "one":
                k[at, col] = 1.0
                col += 1
            elif kind == "mid":
                k[at, col] = mid
                col += 1
            elif kind == "baseline":
                b = bspline_values([mid], *self.info.ranges["int_mid"], s.baseline_k) @ z
                k[0, col:col + b.shape[1]] = b
                col += b.shape[1]
            else:
                k[at:at + z.shape[0], col:col + z.shape[1]] = mid * z
                col += z.shape[1]
        if s.exposures:
            bt = bspline_values([mid], *self.info.ranges["t"], s.exposure_k)[0]
            m = s.exposure_k
            for e in range(len(s.exposures)):
                at = self.fixed_width + e * m
                for a in range(m):
                    for b in range(m):
                        k[at + b, col + a * m + b] = bt[a]
                col += m * m
        self._maps[day] = k
        return k

    def subject_rows(self, z: np.ndarray, c: np.ndarray, day: int) -> np.ndarray:
        """Subject parts on a day: fixed part and exposure sums side by side."""
        if not self.spec.exposures:
            return z
        w = self.day_weights(day)
        parts = [c[:, e * WIDTH:(e + 1) * WIDTH] @ w for e in range(len(self.spec.exposures))]
        return np.hstack([z, *parts])

    def part_weights(self, beta: np.ndarray, day: int) -> np.ndarray:
        """Weights of the covariates, spline values and diary days of a row in the linear predictor of a day."""
        k = self.day_map(day) @ beta
        out, m = [k[:self.fixed_width]], self.spec.exposure_k
        for e in range(len(self.spec.exposures)):
            at = self.fixed_width + e * m
            out.append(self.day_weights(day) @ k[at:at + m])
        return np.concatenate(out)

    def summed_parts(self, sums: np.ndarray) -> np.ndarray:
        """Sums of the design columns from sums per day (rows, from the first day on) of what ``part_weights`` weighs."""
        z, c = sums[:, :self.fixed_width], sums[:, self.fixed_width:]
        day = self.day_blocks(np.arange(self.spec.first_day, self.spec.first_day + len(sums)))
        out = np.zeros(self.p)
        out[self.one_cols] = self.subject_blocks(z.sum(axis=0)[None, :])[0][0]
        out[self.mid_cols] = self.subject_blocks((day["mid"] @ z)[None, :])[1][0]
        out[self.base_cols] = day["base"].T @ z[:, 0]
        if self.spec.exposures:
            c = c.reshape(len(sums), len(self.spec.exposures), WIDTH)
            out[self.exposure_cols] = np.einsum("ta,td,tcd,db->cab", day["bt"], day["ll"], c, day["bz"], optimize=True).ravel()
        return out

    def penalties(self) -> list[Penalty]:
        """Second differences for the one-dimensional smooths, first differences per tensor margin."""
        s, out = self.spec, []

        def eigen(m):
            e = np.linalg.eigvalsh(m)
            return np.where(e > 1e-9 * max(e.max(), 1e-300), e, 0.0)

        def place(span, block):
            m = np.zeros((self.p, self.p))
            m[span[0]:span[1], span[0]:span[1]] = block
            return m

        for label, z in [("int_mid", None)] * bool(s.baseline_k) + [(v, None) for v in s.time_smooths]:
            name = "s(int_mid)" if label == "int_mid" else f"s({label}):int_mid"
            k = s.baseline_k if label == "int_mid" else s.smooth_k
            z = centring(np.array(self.info.means[label]))
            block = z.T @ difference_penalty(k, 2) @ z
            out.append(Penalty(name, name, place(self.spans[name], block), eigen(block)))
        if s.exposures:
            k = s.exposure_k
            d, one = difference_penalty(k, 1), np.eye(k)
            e = eigen(d)
            n = len(s.exposures)
            spans = [self.spans[f"te(t,tz):I(LL * {v})"] for v in s.exposures]
            for label, block, ev in (("te t", np.kron(d, one), np.repeat(e, k)),
                                     ("te tz", np.kron(one, d), np.tile(e, k))):
                out.append(Penalty(label, "te", sum(place(sp, block) for sp in spans), np.tile(ev, n)))
        return out


def array_values(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A fixed-length array column of an Arrow batch as a matrix, without a copy per row."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(batch.num_rows, width)


def row_parts(df: DataFrame, design: Design, keep: Sequence[str] = ()) -> DataFrame:
    """Rows at risk with their subject parts ``z`` and ``c``; covariates that are not kept are dropped."""
    s = design.spec
    require_columns(df, ["tend", *s.covariates, *s.exposures, *keep], "rows at risk")
    return df.select(*keep, F.col("tend").alias("_day"), design.z_column().alias("z"),
                     design.c_column().alias("c"))


def map_rows(df: DataFrame, design: Design, keep: Sequence[str], fn, schema: str) -> DataFrame:
    """Apply ``fn(x)`` to the design matrix of every batch; it returns the new columns by name.

    Rows of a batch are handled day by day, so one matrix product serves all rows of a day.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    full = f"{types}, {schema}" if types else schema
    names = list(keep)
    e_width = WIDTH * len(design.spec.exposures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = design.expand(array_values(batch, "z", design.raw_width))
            c = array_values(batch, "c", e_width) if e_width else np.zeros((len(z), 0))
            day = batch.column("_day").to_numpy()
            x = np.zeros((len(z), design.p))
            for d in np.unique(day):
                at = day == d
                x[at] = design.subject_rows(z[at], c[at], int(d)) @ design.day_map(int(d))
            new = fn(x)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], *[pa.array(list(v) if v.ndim == 2 else v)
                                                      for v in new.values()]],
                names=[*names, *new.keys()])

    return row_parts(df, design, names).mapInArrow(run, full)


def design_rows(df: DataFrame, design: Design, keep: Sequence[str]) -> DataFrame:
    """The dense design as array column ``x``, for small prediction tables."""
    return map_rows(df, design, keep, lambda x: {"x": x}, "x array<double>")


def column_sums(df: DataFrame, design: Design, weight: str | None = None, per: str | None = None,
                also: Sequence[str] = ()) -> DataFrame:
    """Sum of every design column over all rows, times ``weight``: ``term, total``; each task emits its own sums.

    With ``per`` also the sums of the columns ``also`` per value of that column, in the same pass: ``grp, term, total``,
    where ``grp`` is null for the design columns. Rows without a value of ``per`` count in the design columns only.
    """
    e_width = WIDTH * len(design.spec.exposures)

    def packed(grp, term, total) -> pa.RecordBatch:
        head = [pa.array(grp, pa.string())] if per else []
        return pa.RecordBatch.from_arrays([*head, pa.array(term), pa.array(total)], names=[*(["grp"] if per else []), "term", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(design.p)
        for batch in batches:
            z = design.expand(array_values(batch, "z", design.raw_width))
            c = array_values(batch, "c", e_width) if e_width else np.zeros((len(z), 0))
            day = batch.column("_day").to_numpy()
            w = batch.column(weight).to_numpy() if weight else np.ones(len(z))
            for d in np.unique(day):
                at = day == d
                total += w[at] @ design.subject_rows(z[at], c[at], int(d)) @ design.day_map(int(d))
            if per and batch.num_rows:
                coded = batch.column("_per").dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
                for k in also:
                    got = np.bincount(code, batch.column(k).to_numpy(), len(names) + 1)[:len(names)]
                    yield packed(names, [k] * len(names), got)
        yield packed([None] * design.p, design.names, total)

    if per:
        df = df.withColumn("_per", F.col(per).cast("string"))
    keep = list(dict.fromkeys([*([weight] if weight else []), *(["_per", *also] if per else [])]))
    keys = [*(["grp"] if per else []), "term"]
    schema = ", ".join([*(f"{k} string" for k in keys), "total double"])
    return row_parts(df, design, keep).mapInArrow(run, schema).groupBy(*keys).agg(F.sum("total").alias("total"))


def tensor_exposure(tend: Column, window: Column, ranges: dict[str, tuple[float, float]], k: int = 5,
                    pred: LagLead = protein_lag_lead) -> Column:
    """The ``k * k`` exposure columns of one category as an array.

    The spline of t is constant within an end day, so the sum over the diary days is taken over the
    splines of tz only. The result is linear in ``window``: diary windows may be summed by end day first.
    """
    bz = bspline_values(np.arange(1, WIDTH + 1) + 1, *ranges["tz"], k)
    masked = [F.when(pred(tend, F.lit(d)), window[d - 1]).otherwise(0.0) for d in range(1, WIDTH + 1)]
    sums = F.array(*[add_all([m * float(bz[d, b]) for d, m in enumerate(masked)]) for b in range(k)])
    bt = F.array(*bspline_columns(tend - F.lit(0.5), *map(F.lit, ranges["t"]), k))
    return F.flatten(F.transform(bt, lambda a: F.transform(sums, lambda b: a * b)))
