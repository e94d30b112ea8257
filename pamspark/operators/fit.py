"""Penalised Poisson fits with a log offset, as one distributed aggregate per Newton step.

Input are *blocks*: rows that stand for ``n`` subjects sharing one design, at risk on every day from
``from_day`` to ``to_day``, with ``last_exposure`` person-time and ``events`` on the last day. A subject
is one block; so is a row at risk, or a group of identical rows. The days of a block are summed inside
the task and never become table rows.

Every pass adds up, for all models at once, X'WX, X'(y - mu) and the deviance parts, packed into one
array row per task and model; Spark sums them in two levels. The driver only sees matrices of the size
of the coefficient vector. Group effects (one per unit, ridge penalised) are eliminated block-wise and
never leave Spark: their sums are one array row per model and unit, what they contribute to a step is
summed at a few values of their smoothing parameter in one job, and the driver interpolates between them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut_lineage, ship_package
from ..sources.schemas import require_columns
from .design import BasisInfo, Design, PamSpec, Penalty, array_values, basis_info, basis_infos
from .exposure import WIDTH, LagLead, protein_lag_lead
from .model import PamModel
from .ped import FOLLOW_UP

#: Smoothing parameters stay within these multiples of the weight that equals the data's information.
SMOOTHING_RANGE = (1e-6, 1e3)
GROUP_RANGE = (1e-6, 1e4)
SMOOTHING_START = 1e-3
#: A smoothing parameter is settled when the restricted log likelihood has less slope than this in its logarithm.
GRADIENT = 1e-3
#: A Newton decrement below this that no longer falls is rounding, not distance from the optimum (log likelihood units).
ROUNDING = 1e-4
#: Most values of the group parameter at which a pass is summed, and how far they reach on the log scale.
NODES = 12
REACH = (0.5, 5.0)
#: Units whose effects are broadcast together; more units make more blocks of the fit table.
BLOCK_UNITS = 50_000
SALTS = 16
SUMS = "model int, grp string, b double, v array<double>"
EFFECTS = "model int, grp string, b double, old double"


@dataclass(frozen=True)
class Task:
    """One model to fit: the 0/1 event column on the subject rows, its terms, the subjects it uses.

    With ``own_basis`` its splines take their ranges and centring from the subjects it uses.
    """

    name: str
    event: str
    spec: PamSpec
    rule: Column | None = None
    own_basis: bool = False


def subject_blocks(subjects: DataFrame, time: str = "event_time", from_day: int = 5,
                   horizon: int = FOLLOW_UP) -> DataFrame:
    """One block per subject at risk from ``from_day`` on."""
    t = F.col(time)
    to_day = F.least(F.ceil(t).cast("int"), F.lit(horizon))
    return subjects.where(t > from_day - 1).withColumns({
        "from_day": F.lit(from_day), "to_day": to_day, "n": F.lit(1.0),
        "last_exposure": (F.least(t, to_day) - to_day + 1).cast("double"),
        "seen": (t <= horizon).cast("double")})


def row_blocks(rows: DataFrame, events: Mapping[str, str]) -> DataFrame:
    """Blocks from rows at risk, compressed or not: ``events`` maps new names to event columns.

    Compressed rows bring ``n_rows`` and ``exposure``, plain rows their ``offset``.
    """
    compressed = "exposure" in rows.columns
    n = F.col("n_rows").cast("double") if compressed else F.lit(1.0)
    exposure = F.col("exposure") if compressed else F.exp("offset")
    return rows.withColumns({"from_day": F.col("tend"), "to_day": F.col("tend"), "n": n,
                             "last_exposure": exposure, "seen": F.lit(1.0),
                             **{k: F.col(v) for k, v in events.items()}})


def _unit_block(n: int) -> Column:
    return F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int")


def _prepare(blocks: DataFrame, tasks: Sequence[Task], strata: Sequence[str | None], design: Design, parts: int | None,
             unit_blocks: int = 1) -> DataFrame:
    """Compact fit table: block columns, subject parts, and one event count per model (null: not used).

    Ranged by group, so a task holds few groups, and by a hash of the design inside a group, so a group
    of any size is spread over many tasks. Blocks of a unit lie by their last day, so that a task adds up neighbours
    over the days of the longest only. Units fall into ``unit_blocks`` folders, each of which is
    later met by the effects of its own units only. Rows without a unit are left out.
    """
    spec = design.spec
    events = [F.when(F.col(rows) if rows else F.lit(True), F.col(t.event) * F.col("seen")).cast("double")
              for t, rows in zip(tasks, strata)]
    group = F.col(spec.group).cast("string") if spec.group else F.lit(None).cast("string")
    switch = F.col(spec.group_switch).cast("double") if spec.group else F.lit(0.0)
    compact = blocks.select(
        "from_day", "to_day", "n", "last_exposure", F.array(*events).alias("y"),
        group.alias("grp"), switch.alias("switch"), design.z_column().alias("z"),
        design.c_column().alias("c"))
    if spec.group:
        spread = F.xxhash64("z", "c", "to_day")
        compact = compact.where(F.col("grp").isNotNull()).withColumn("block", _unit_block(unit_blocks))
        by = ("block", "grp", spread)
        compact = (compact.repartitionByRange(parts, *by) if parts
                   else compact.repartitionByRange(*by)).sortWithinPartitions("block", "grp", "to_day")
        return cut_lineage(compact, by=["block"])
    return cut_lineage(compact.repartition(parts) if parts else compact)


def _packed(model, grp, b, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of equal length as one array column beside their model, unit and the unit's effect."""
    n, width = rows.shape
    arrays = [pa.array(np.broadcast_to(model, n).astype(np.int32)), pa.array(grp, pa.string()), pa.array(np.broadcast_to(b, n).astype(float)),
              pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel()))]
    return pa.RecordBatch.from_arrays(arrays, names=["model", "grp", "b", "v"])


def _triangle(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    i, j = np.triu_indices(p)
    out[i, j] = out[j, i] = flat
    return out


def _sum_table(table: pa.Table) -> pa.Table:
    width = len(table.column("v")[0])
    v = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(-1, width).sum(axis=0)
    return pa.table({"model": table.column("model")[:1], "v": pa.array([v], pa.list_(pa.float64()))})


def _added(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the arrays ``v`` per model: in SALTS groups first, then over these, so that the driver gets one row a model."""
    schema = "model int, v array<double>"
    some = rows.withColumn("salt", F.spark_partition_id() % SALTS).select("model", "salt", "v")
    got = some.groupBy("model", "salt").applyInArrow(_sum_table, schema).groupBy("model").applyInArrow(_sum_table, schema).toArrow()
    out: dict[int, np.ndarray] = {}
    for batch in got.to_batches():
        model, v = batch.column("model").to_pylist(), batch.column("v")
        flat, at = v.flatten().to_numpy(), np.asarray(v.offsets) - v.offsets[0].as_py()
        for i, m in enumerate(model):
            out[m] = flat[at[i]:at[i + 1]].copy()
    return out


class _Sums:
    """Sums of one model over the blocks of a task, kept apart by how the day enters the coefficients.

    With U the covariates that do not depend on the day, V those multiplied by the day's middle m,
    B(t) the baseline splines and C the diary windows, every part of X'WX follows from a few products
    of U, V and C with weights already summed over the days; only the exposure corner needs products
    per day. Blocks are the last axis of every array, so that their products run along contiguous memory.
    """

    def __init__(self, design: Design, day: dict[str, np.ndarray], beta: np.ndarray):
        self.design, self.day = design, day
        q1, q2, self.q3 = len(design.one_cols), len(design.mid_cols), day["base"].shape[1]
        self.n_exp, self.k = len(design.spec.exposures), design.spec.exposure_k
        days, c = len(day["mid"]), self.n_exp * WIDTH
        self.b_one, self.b_mid = beta[design.one_cols], beta[design.mid_cols]
        self.oo, self.om, self.mm = np.zeros((q1, q1)), np.zeros((q1, q2)), np.zeros((q2, q2))
        self.ob, self.mb = np.zeros((q1, self.q3)), np.zeros((q2, self.q3))
        self.per_day, self.rest_day = np.zeros(days), np.zeros(days)
        self.s_one, self.s_mid, self.parts = np.zeros(q1), np.zeros(q2), np.zeros(4)
        self.seen = False
        mid = day["mid"][:, None]
        gain = np.zeros((days, 0))
        if self.n_exp:
            w = self.k * WIDTH
            theta = beta[design.exposure_cols].reshape(self.n_exp, self.k, self.k)
            gain = np.einsum("td,ta,cab,db->tcd", day["ll"], day["bt"], theta, day["bz"]).reshape(days, c)
            lead = np.einsum("td,ta->tda", day["ll"], day["bt"])
            lead = np.stack([lead, lead * mid[:, :, None]], axis=2)  # day, diary day, without and with the middle, spline of t
            self.leads = []  # a few diary days at a time, on the days between the first and the last on which they act
            for d in range(0, WIDTH, NEAR):
                acting = np.flatnonzero(day["ll"][:, d:d + NEAR].any(axis=1))
                if len(acting):
                    span = slice(acting[0], acting[-1] + 1)
                    at = lead[span, d:d + NEAR]
                    self.leads.append((slice(d, d + at.shape[1]), span, np.ascontiguousarray(at.reshape(len(at), -1).T)))
            self.oe, self.me = np.zeros((q1, self.n_exp * w)), np.zeros((q2, self.n_exp * w))
            self.c_mu, self.c_rest = np.zeros((days, c)), np.zeros((days, c))
            pairs = self.n_exp * self.k
            self.pairs = np.zeros((days, pairs * (pairs + 1) // 2))
        self.eta = np.hstack([gain, mid, np.ones_like(mid), (day["base"] @ beta[design.base_cols])[:, None]])
        columns = [np.ones_like(mid), mid, mid**2, day["base"], day["base"] * mid]
        self.kernel, self.ends = np.ascontiguousarray(np.hstack(columns).T), np.cumsum([m.shape[1] for m in columns])[:-1]

    def add(self, u, v, acts, shift, exposure, y, last_index, mu, from_day):
        """Add blocks; ``mu`` takes the expected events per day. Returns the per-block sums of weights times design.

        ``acts`` are the diary windows and three rows more for what the linear predictor adds to them. The days of
        ``exposure``, ``last_index`` and ``mu`` are those at risk, from the place ``from_day`` on.
        """
        c, days = acts[:-3], slice(from_day, from_day + len(mu))
        np.matmul(self.b_mid, v, out=acts[-3])
        np.add(self.b_one @ u, shift, out=acts[-2])
        np.matmul(self.eta[days], acts, out=mu)
        at = np.flatnonzero(y)
        seen = y[at] @ mu[last_index[at], at]
        with np.errstate(over="ignore", invalid="ignore"):
            np.multiply(exposure, np.exp(mu, out=mu), out=mu)
        of_day = mu.sum(axis=1)
        if not np.isfinite(of_day.sum()):  # too long a step: the days at risk stay infinite, the others count nothing
            mu[exposure == 0] = 0.0
            of_day = mu.sum(axis=1)
        self.seen = True
        self.parts[:3] += [of_day.sum(), seen, y.sum()]
        m0, m1, m2, mb, mbm = np.split(self.kernel[:, days] @ mu, self.ends)
        vm, uo = v * m1, u * m0
        self.oo += u @ uo.T
        self.om += u @ vm.T
        self.mm += v @ (v * m2).T
        self.ob += u @ mb.T
        self.mb += v @ mbm.T
        self.per_day[days] += of_day
        self.rest_day[days] += np.bincount(last_index, y, len(of_day)) - of_day
        self.s_one += u @ (y - m0[0])
        self.s_mid += v @ (y * self.day["mid"][days][last_index] - m1[0])
        pieces = [uo, vm, mb]
        if self.n_exp:
            f = np.zeros((WIDTH, 2, self.k, len(y)))
            for d, span, kernel in self.leads:
                a, b = max(span.start, days.start), min(span.stop, days.stop)
                if a < b:
                    np.matmul(kernel[:, a - span.start:b - span.start], mu[a - from_day:b - from_day], out=f[d].reshape(len(kernel), -1))
            wide, wide_mid = (self._acting(f[:, i], c) for i in range(2))
            self.oe += u @ wide.T
            self.me += v @ wide_mid.T
            cm = mu @ c.T
            self.c_mu[days] += cm
            self.c_rest[days] -= cm
            np.add.at(self.c_rest, last_index[at] + from_day, (c[:, at] * y[at]).T)
            pieces.append(wide)
        return m0[0], pieces

    def _acting(self, f: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Weights per diary day and spline of t, times the diary of every exposure."""
        n = c.shape[1]
        return (f * c.reshape(self.n_exp, WIDTH, 1, n)).reshape(-1, n)

    def per_block(self, pieces) -> np.ndarray:
        """Per-block sums in coefficient order."""
        d, n = self.design, len(pieces[0])
        out = np.zeros((n, d.p))
        out[:, d.one_cols], out[:, d.mid_cols], out[:, d.base_cols] = pieces[:3]
        if self.n_exp:
            out[:, d.exposure_cols] = self._spline_tz(pieces[3])
        return out

    def _spline_tz(self, wide: np.ndarray) -> np.ndarray:
        full = wide.reshape(len(wide), self.n_exp, WIDTH, self.k).swapaxes(2, 3) @ self.day["bz"]
        return full.reshape(len(wide), self.n_exp * self.k * self.k)

    def assemble(self) -> tuple[np.ndarray, np.ndarray]:
        """X'WX and X'(y - mu) in coefficient order."""
        d, day = self.design, self.day
        gram, score = np.zeros((d.p, d.p)), np.zeros(d.p)

        def put(r, c, block):
            gram[np.ix_(r, c)] = block
            gram[np.ix_(c, r)] = block.T

        o, m, b, e = d.one_cols, d.mid_cols, d.base_cols, d.exposure_cols
        put(o, o, self.oo)
        put(o, m, self.om)
        put(m, m, self.mm)
        put(o, b, self.ob)
        put(m, b, self.mb)
        put(b, b, day["base"].T @ (day["base"] * self.per_day[:, None]))
        score[o], score[m], score[b] = self.s_one, self.s_mid, day["base"].T @ self.rest_day
        if self.n_exp:
            put(o, e, self._spline_tz(self.oe))
            put(m, e, self._spline_tz(self.me))
            n, k, days = self.n_exp, self.k, len(day["mid"])

            def by_tz(c):
                return np.einsum("td,tcd,db->tcb", day["ll"], c.reshape(days, n, WIDTH), day["bz"])
            put(b, e, np.einsum("tj,ta,tcb->jcab", day["base"], day["bt"], by_tz(self.c_mu)).reshape(len(b), -1))
            score[e] = np.einsum("ta,tcb->cab", day["bt"], by_tz(self.c_rest)).ravel()
            i, j = np.triu_indices(n * k)
            both = np.zeros((days, n * k, n * k))
            both[:, i, j] = both[:, j, i] = self.pairs
            corner = np.einsum("ta,tA,tcbCB->cabCAB", day["bt"], day["bt"],
                               both.reshape(days, n, k, n, k), optimize=True)
            put(e, e, corner.reshape(len(e), len(e)))
        return gram, score


CHUNK = 2048
SUM_NAMES = ("model", "grp", "v")
#: Diary days whose weights are summed together, and blocks whose pairs of exposure columns are held at once.
NEAR = 3
PAIRED = 1024


def _add_pairs(rules: list[tuple], sums: Sequence[_Sums], mu: np.ndarray, c: np.ndarray, from_day: int) -> None:
    """Adds the products of exposure columns of blocks with diaries ``c``; ``mu`` holds the models' expected events per day.

    ``rules`` are the days on which the same diary days act, with what turns diaries into columns; such days share the
    products. The days of ``mu`` begin at the place ``from_day``.
    """
    days, n_models, n = mu.shape
    flat = mu.reshape(days * n_models, n)
    rules = [(at - from_day, weights) for all_days, weights in rules
             if len(at := all_days[(all_days >= from_day) & (all_days < from_day + days)])]
    for start in range(0, n, PAIRED):
        part = slice(start, start + PAIRED)
        diary = np.ascontiguousarray(c[:, part])
        for at, weights in rules:
            w = weights @ diary
            pairs = np.empty((len(w) * (len(w) + 1) // 2, w.shape[1]))
            row = 0
            for i in range(len(w)):
                np.multiply(w[i], w[i:], out=pairs[row:row + len(w) - i])
                row += len(w) - i
            if at[-1] - at[0] == len(at) - 1:
                of = flat[at[0] * n_models:(at[-1] + 1) * n_models, part]
            else:
                of = mu[at, :, part].reshape(-1, w.shape[1])
            products = (of @ pairs.T).reshape(-1, n_models, len(pairs))
            for i, one in enumerate(sums):
                one.pairs[at + from_day] += products[:, i]


def _with_effects(table: DataFrame, effects: DataFrame | None, n_models: int, unit_blocks: int) -> DataFrame:
    """The fit table with the unit effects of all models as an array; one bounded broadcast per folder of units."""
    if effects is None:
        return table.withColumn("b", F.array_repeat(F.lit(0.0), n_models))

    def met(k: int) -> DataFrame:
        wide = effects.where(F.col("block") == k).groupBy("grp").agg(F.array(*[
            F.coalesce(F.max(F.when(F.col("model") == i, F.col("b"))), F.lit(0.0)) for i in range(n_models)]).alias("b"))
        return table.where(F.col("block") == k).join(F.broadcast(wide), "grp", "left")

    return reduce(DataFrame.unionByName, map(met, range(unit_blocks))).withColumn(
        "b", F.coalesce("b", F.array_repeat(F.lit(0.0), n_models)))


def _pass(table: DataFrame, designs: Sequence[Design], betas: Mapping[int, np.ndarray],
          columns: Mapping[int, np.ndarray]) -> DataFrame:
    """The sums of one Newton step for the models in ``betas``: rows (model, grp, b, v), not yet summed over tasks.

    Rows without ``grp`` pack X'WX (upper triangle), the score and the deviance parts of a task; rows with
    it pack a unit's X'W, weight and score in all columns of the designs, beside the unit's effect. The designs share
    a specification, one stands for each model; ``columns`` gives the coefficients a model owns.
    """
    spec, raw_width, p = designs[0].spec, designs[0].raw_width, designs[0].p
    grouped, n_models = spec.group is not None, len(designs)
    c_width = WIDTH * len(spec.exposures)
    models = sorted(betas)
    bases: dict[int, list[int]] = {}
    for m in models:  # models of one basis share their spline values
        bases.setdefault(next(i for i, d in enumerate(designs) if d.info is designs[m].info), []).append(m)
    whole = {}
    for m in models:
        whole[m] = np.zeros(p)
        whole[m][columns[m]] = betas[m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days = np.arange(spec.first_day, spec.last_day + 1)
        day = {k: designs[k].day_blocks(days) for k in bases}
        sums = {m: _Sums(designs[k], day[k], whole[m]) for k, of in bases.items() for m in of}
        rules: dict[int, list[tuple]] = {}  # days on which the same diary days act, and their exposure columns
        for k in bases if c_width else ():
            found, of_rule = np.unique(day[k]["ll"], axis=0, return_inverse=True)
            rules[k] = [(np.flatnonzero(of_rule.ravel() == i), np.kron(np.eye(len(spec.exposures)), rule[:, None] * day[k]["bz"]).T)
                        for i, rule in enumerate(found) if rule.any()]
        carry: dict[int, tuple[str, float, np.ndarray]] = {}
        for big in batches:
            for start in range(0, big.num_rows, CHUNK):
                batch = big.slice(start, CHUNK)
                raw = array_values(batch, "z", raw_width)
                c = np.ascontiguousarray((array_values(batch, "c", c_width) if c_width else np.zeros((len(raw), 0))).T)
                y = array_values(batch, "y", n_models)
                first, last = (batch.column(k).to_numpy() for k in ("from_day", "to_day"))
                n, tail, switch = (batch.column(k).to_numpy() for k in ("n", "last_exposure", "switch"))
                effect = array_values(batch, "b", n_models) if grouped else np.zeros((len(raw), n_models))
                last_index = np.clip(last - days[0], 0, len(days) - 1)
                begin = min(int(np.clip(first.min() - days[0], 0, len(days) - 1)), int(last_index.min()))
                last_index = last_index - begin
                of_days = days[begin:begin + last_index.max() + 1, None]  # nobody is at risk outside of them
                exposure = np.where(of_days == last, tail, n) * ((of_days >= first) & (of_days <= last))
                used = ~np.isnan(y)
                if grouped:
                    coded = batch.column("grp").dictionary_encode()
                    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                    names = np.asarray(names, dtype=object)
                for k, of in bases.items():
                    any_model = used[:, of].any(axis=1)
                    if not any_model.any():
                        continue
                    rows = slice(None) if any_model.all() else np.flatnonzero(any_model)
                    u_all, v_all = (np.ascontiguousarray(b.T) for b in designs[k].subject_blocks(designs[k].expand(raw[rows])))
                    alike = [m for m in of if used[rows, m].all()]  # models of all these blocks share their arrays
                    for some in ([alike] if alike else []) + [[m] for m in of if m not in alike and used[rows, m].any()]:
                        u, v, pick = u_all, v_all, rows  # a slice copies nothing
                        if some is not alike:
                            mine = used[rows, some[0]]
                            u, v, pick = u_all[:, mine], v_all[:, mine], np.flatnonzero(used[:, some[0]])
                        at_risk, ends, sw = exposure[:, pick], last_index[pick], switch[pick]
                        acts = np.vstack([c[:, pick], np.ones((3, u.shape[1]))])
                        mu = np.empty((len(of_days), len(some), u.shape[1]))
                        if grouped:
                            g = code[pick]
                            order = slice(None) if (g[1:] >= g[:-1]).all() else np.argsort(g, kind="stable")
                            g = g[order]
                            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                            units = names[g[starts]]
                        for i, m in enumerate(some):
                            total, pieces = sums[m].add(u, v, acts, effect[pick, m] * sw, at_risk, y[pick, m], ends, mu[:, i], begin)
                            if not grouped:
                                continue
                            weight = total * sw * sw
                            sums[m].parts[3] += weight.sum()
                            if (sw != 1).any():
                                pieces = [piece * sw for piece in pieces]
                            summed = [np.add.reduceat(piece[:, order], starts, axis=1).T for piece in pieces]
                            unit_rows = np.hstack([sums[m].per_block(summed), *[np.add.reduceat(a[order], starts)[:, None] for a in (
                                weight, (y[pick, m] - total) * sw)]])
                            at = effect[pick, m][order][starts]
                            if m in carry and carry[m][0] == units[0]:
                                unit_rows[0] += carry[m][2]
                            elif m in carry:
                                yield _packed(m, [carry[m][0]], carry[m][1], carry[m][2][None, :])
                            if len(units) > 1:
                                yield _packed(m, units[:-1], at[:-1], unit_rows[:-1])
                            carry[m] = units[-1], at[-1], unit_rows[-1].copy()
                        if c_width:
                            _add_pairs(rules[k], [sums[m] for m in some], mu, acts[:-3], begin)
        for m, (unit, at, row) in carry.items():
            yield _packed(m, [unit], at, row[None, :])
        for m in models:
            if sums[m].seen:
                gram, score = sums[m].assemble()
                k = columns[m]
                yield _packed(m, [None], 0.0, np.concatenate(
                    [_triangle(gram[np.ix_(k, k)]), score[k], sums[m].parts])[None, :])

    return table.mapInArrow(run, SUMS)


def _unit_sums(sums: DataFrame) -> DataFrame:
    """One row per model and unit: its effect and its summed array ``v``, added up along the sorted rows."""

    def run(batches):
        held = None  # the unit that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            model, grp = batch.column("model").to_numpy(), np.asarray(batch.column("grp").to_pylist(), object)
            starts = np.flatnonzero(np.r_[True, (model[1:] != model[:-1]) | (grp[1:] != grp[:-1])])
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            model, grp, b, v = model[starts], grp[starts], batch.column("b").to_numpy()[starts], np.add.reduceat(v, starts)
            if held and (held[0], held[1]) == (model[0], grp[0]):
                v[0] += held[3]
            elif held:
                yield _packed(held[0], [held[1]], held[2], held[3][None, :])
            if len(grp) > 1:
                yield _packed(model[:-1], grp[:-1], b[:-1], v[:-1])
            held = model[-1], grp[-1], b[-1], v[-1].copy()
        if held:
            yield _packed(held[0], [held[1]], held[2], held[3][None, :])

    units = sums.where(F.col("grp").isNotNull()).repartition("model", "grp").sortWithinPartitions("model", "grp")
    return units.mapInArrow(run, SUMS)


def _by_model(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    model, v, b = batch.column("model").to_numpy(), array_values(batch, "v", width), batch.column("b").to_numpy()
    for m in np.unique(model):
        at = np.flatnonzero(model == m)
        yield int(m), at, v[at, :-2], v[at, -2], v[at, -1], b[at]


def _unit_terms(units: DataFrame, nodes: Mapping[int, np.ndarray], scale: Mapping[int, float],
                columns: Mapping[int, np.ndarray], width: int) -> DataFrame:
    """What eliminating the unit effects contributes at each value of the group parameter in ``nodes``; to be added up.

    Per model a matrix with a row per node. Parts that fall with the parameter are multiplied by it plus
    ``scale`` (once or twice), which keeps them level and their interpolation exact towards both ends.
    """

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, _, c, sw, s, b in _by_model(batch, width):
                c = c[:, columns[m]]
                got = []
                for lam in nodes[m]:
                    d, r = sw + lam, s - lam * b
                    level = lam + scale[m]
                    cd, plain = c / d[:, None], b + r / d
                    got.append(np.concatenate([
                        _triangle(c.T @ cd) * level, _triangle(cd.T @ cd) * level**2, cd.T @ r,
                        cd.T @ plain * level**2,
                        [(r * r / d).sum(), (plain**2).sum() * level**2, (1 / d).sum() * level, len(d), b @ b]]))
                flat = np.concatenate(got)
                total[m] = total[m] + flat if m in total else flat
        for m, flat in total.items():
            yield _packed(m, [None], 0.0, flat[None, :])

    return units.mapInArrow(run, SUMS)


def _between(nodes: np.ndarray, values: np.ndarray, scale: float, p: int):
    """The unit terms at any group parameter within ``nodes``: barycentric interpolation on the log scale."""
    x = np.log(nodes)
    sign = np.where(np.arange(len(x)) % 2, -1.0, 1.0)
    weights = sign * np.sin((2 * np.arange(len(x)) + 1) * np.pi / (2 * len(x)))
    tri = p * (p + 1) // 2

    def at(lam: float):
        gap = math.log(lam) - x
        near = int(np.argmin(np.abs(gap)))
        if len(x) == 1 or abs(gap[near]) < 1e-13:
            v = values[near]
        else:
            w = weights / gap
            v = (w @ values) / w.sum()
        level = lam + scale
        cc, cc2, cs, cplain, rest = np.split(v, [tri, 2 * tri, 2 * tri + p, 2 * tri + 2 * p])
        return (_square(cc / level, p), _square(cc2 / level**2, p), cs, cplain / level**2,
                rest / [1, level**2, level, 1, 1])

    return at


def _nodes(lam: float, reach: float, low: float, high: float) -> np.ndarray:
    """Chebyshev points of the log parameter around ``lam``, inside its range.

    What they interpolate has its nearest poles pi away from the log scale, so a narrower range needs fewer of them.
    """
    a, b = max(math.log(lam) - reach, math.log(low)), min(math.log(lam) + reach, math.log(high))
    n = min(NODES, max(4, math.ceil(18 / math.asinh(2 * math.pi / max(b - a, 1e-3)))))
    return np.exp((a + b) / 2 + (b - a) / 2 * np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n)))


def _moved_effects(units: DataFrame, steps: Mapping[int, tuple[float, np.ndarray]],
                   columns: Mapping[int, np.ndarray], width: int) -> DataFrame:
    """Unit effects after a step (group parameter, coefficient step) of their model."""

    def run(batches):
        for batch in batches:
            b = batch.column("b").to_numpy().copy()
            for m, at, c, sw, s, now in _by_model(batch, width):
                lam, delta = steps[m]
                b[at] = now + (s - lam * now - c[:, columns[m]] @ delta) / (sw + lam)
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("grp"), pa.array(b), batch.column("b")],
                                             names=["model", "grp", "b", "old"])

    return units.where(F.col("model").isin(list(steps))).mapInArrow(run, EFFECTS)


class _State:
    """Driver-side state of one model: coefficients, smoothing parameters, the last sums."""

    def __init__(self, index: int, task: Task, full: Design, penalties: list[Penalty], columns: np.ndarray):
        self.index, self.task, self.columns = index, task, columns
        self.p = len(columns)
        self.beta = np.zeros(self.p)
        self.pen = []
        for pen in penalties:
            m = pen.matrix[np.ix_(columns, columns)]
            if np.any(m):
                self.pen.append(Penalty(pen.label, pen.term, m, pen.eigen))
        self.lam = np.ones(len(self.pen))
        self.lam_group, self.reach = 1.0, REACH[1]
        self.unit = np.ones(len(self.pen))
        self.unit_group = 1.0
        self.gram = self.score = None
        self.parts = np.zeros(4)
        self.edf = math.inf
        self.passes = 0
        self.done = False
        self.gradient = self.decrement = math.inf
        self.group_edf = 0.0
        self.previous = None
        self.cov = None
        self.halvings = 0

    def load(self, flat: np.ndarray) -> None:
        tri = self.p * (self.p + 1) // 2
        self.gram = _square(flat[:tri], self.p)
        self.score, self.parts = flat[tri:tri + self.p], flat[tri + self.p:]

    def scale_penalties(self, n_groups: int) -> None:
        """Where each penalty weighs as much as the data of this pass: the unit of its parameter's range."""
        diag = np.diag(self.gram)
        for k, pen in enumerate(self.pen):
            on = np.diag(pen.matrix) > 0
            self.unit[k] = max(diag[on].mean(), 1e-300) / pen.eigen[pen.eigen > 0].min()
        self.unit_group = max(self.parts[3] / max(n_groups, 1), 1e-300)

    def penalty(self) -> np.ndarray:
        s = np.zeros((self.p, self.p))
        for lam, pen in zip(self.lam, self.pen):
            s += lam * pen.matrix
        return s

    def pseudo_traces(self, lam: np.ndarray) -> np.ndarray:
        """tr(S^- S_j) for every penalty, from the shared eigenvalues of a term's penalties."""
        out = np.zeros(len(self.pen))
        for term in {p.term for p in self.pen}:
            at = [k for k, p in enumerate(self.pen) if p.term == term]
            total = sum(lam[k] * self.pen[k].eigen for k in at)
            for k in at:
                ok = total > 0
                out[k] = (self.pen[k].eigen[ok] / total[ok]).sum()
        return out


def _solve(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inverse on the columns that carry data or a penalty; a tiny ridge settles directions the data leave open.

    A column is empty if nothing but rounding is left of its ``size``, what it had before the units were eliminated. It is
    not held against other columns: a heavy penalty elsewhere would switch lightly penalised ones on and off on the way.
    """
    diag = np.diag(h)
    live = diag > 1e-12 * size
    scale = 1 / np.sqrt(diag[live])
    sub = h[np.ix_(live, live)] * np.outer(scale, scale)
    inv = np.linalg.inv(sub + 1e-12 * np.eye(len(sub)))
    out = np.zeros_like(h)
    out[np.ix_(live, live)] = inv * np.outer(scale, scale)
    return out


class _Working:
    """The penalised weighted least squares problem of one pass at given smoothing parameters.

    ``gradient`` is that of the restricted log likelihood (negative) in the logarithms of the parameters, the
    group's last; ``fellner`` are their generalised Fellner-Schall updates, which never worsen it.
    """

    def __init__(self, st: _State, log_lam: np.ndarray, group_terms):
        lam = np.exp(log_lam)
        own_lam, n = lam[:len(st.pen)], len(st.pen)
        s = np.zeros((st.p, st.p))
        for x, pen in zip(own_lam, st.pen):
            s += x * pen.matrix
        h, score, own = st.gram + s, st.score - s @ st.beta, 0.0
        size = np.diag(h)
        if group_terms is not None:
            cc, cc2, cs, cplain, rest = group_terms(lam[-1])
            h, score, own = h - cc, score - cs, rest[0]
        self.v = _solve(h, size)
        self.delta = self.v @ score
        self.decrement = float(score @ self.delta + own)
        beta = st.beta + self.delta
        traces = np.array([np.sum(self.v * pen.matrix) for pen in st.pen])
        squares = np.array([beta @ pen.matrix @ beta for pen in st.pen])
        ranks = st.pseudo_traces(own_lam)
        self.edf, self.group_edf = st.p - float(own_lam @ traces), 0.0
        if group_terms is not None:
            spread = rest[2] + np.sum(self.v * cc2)
            self.group_edf = rest[3] - lam[-1] * spread
            self.edf += self.group_edf
            traces = np.append(traces, spread)
            squares = np.append(squares, rest[1] - 2 * self.delta @ cplain + self.delta @ cc2 @ self.delta)
            ranks = np.append(ranks, rest[3] / lam[-1])
        self.gradient = 0.5 * lam * (squares + traces - ranks)
        with np.errstate(divide="ignore"):
            self.fellner = np.log(lam * np.maximum(ranks - traces, 1e-300) / np.maximum(squares, 1e-300))


def _projected(gradient: np.ndarray, log_lam: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The gradient without what points out of the box."""
    out = ((log_lam <= low) & (gradient > 0)) | ((log_lam >= high) & (gradient < 0))
    return np.where(out, 0.0, gradient)


def _newton(st: _State, log_lam: np.ndarray, low: np.ndarray, high: np.ndarray, group_terms, rounds: int = 60):
    """The smoothing parameters that maximise the restricted likelihood of this pass, inside the box.

    Newton steps on their logarithms with differenced gradients; where the curvature is not positive or a step
    does not bring the gradient down, a Fellner-Schall step is taken instead.
    """
    now = _Working(st, log_lam, group_terms)
    for _ in range(rounds):
        slope = _projected(now.gradient, log_lam, low, high)
        free = np.flatnonzero(slope)
        if not len(free) or np.abs(slope).max() < GRADIENT / 10:
            break
        hessian = np.zeros((len(free), len(free)))
        for k, i in enumerate(free):
            moved = log_lam.copy()
            moved[i] += 1e-4 if log_lam[i] + 1e-4 <= high[i] else -1e-4
            hessian[k] = (_Working(st, moved, group_terms).gradient - now.gradient)[free] / (moved[i] - log_lam[i])
        hessian = (hessian + hessian.T) / 2
        chosen = None
        if np.linalg.eigvalsh(hessian).min() > 1e-8:
            tried = log_lam.copy()
            tried[free] -= np.clip(np.linalg.solve(hessian, slope[free]), -3, 3)
            tried = np.clip(tried, low, high)
            there = _Working(st, tried, group_terms)
            if np.linalg.norm(_projected(there.gradient, tried, low, high)) < 0.9 * np.linalg.norm(slope):
                chosen = tried, there
        if chosen is None:
            tried = np.clip(now.fellner, np.maximum(low, log_lam - 5), np.minimum(high, log_lam + 5))
            chosen = tried, _Working(st, tried, group_terms)
        if np.abs(chosen[0] - log_lam).max() < 1e-9:
            break
        log_lam, now = chosen
    return log_lam, now


def _step(st: _State, group_terms, smooth: bool) -> tuple[np.ndarray, float, float]:
    """Newton step with the sums of this pass: coefficient step, its Newton decrement, group parameter of the step.

    The sums are held fixed while the smoothing parameters are moved, the group's within the reach of this pass. The
    state keeps the restricted likelihood's gradient at the parameters it came with.
    """
    has_groups = group_terms is not None
    log_lam = np.log(np.append(st.lam, st.lam_group) if has_groups else st.lam)
    now = _Working(st, log_lam, group_terms)
    if smooth and len(log_lam):
        unit = np.append(st.unit, st.unit_group) if has_groups else st.unit
        factor = np.array([SMOOTHING_RANGE] * len(st.pen) + [GROUP_RANGE] * has_groups).reshape(-1, 2)
        low, high = np.log(factor[:, 0] * unit), np.log(factor[:, 1] * unit)
        log_lam = np.clip(log_lam, low, high)
        st.gradient = float(np.abs(_projected(now.gradient, log_lam, low, high)).max())
        if has_groups:
            around = np.log(_nodes(st.lam_group, st.reach, *(f * st.unit_group for f in GROUP_RANGE)))
            low[-1], high[-1] = around.min(), around.max()
        start = log_lam[-1]
        log_lam, now = _newton(st, np.clip(log_lam, low, high), low, high, group_terms)
        st.lam = np.exp(log_lam[:len(st.pen)])
        if has_groups:
            st.lam_group = float(np.exp(log_lam[-1]))
            st.reach = float(np.clip(3 * abs(log_lam[-1] - start), *REACH))
    else:
        st.gradient = 0.0
    st.cov, st.edf, st.group_edf = now.v, now.edf, now.group_edf
    return now.delta, now.decrement, st.lam_group


def _objective(st: _State, group_square: float) -> float:
    """Half the penalised deviance up to a constant."""
    return st.parts[0] - st.parts[1] + 0.5 * (st.beta @ st.penalty() @ st.beta + st.lam_group * group_square)


def fit_many(blocks: DataFrame, tasks: Sequence[Task], pred: LagLead = protein_lag_lead,
             info: BasisInfo | None = None, smooth: bool = True, smoothing: Mapping[str, float] | None = None,
             max_passes: int = 200, tol: float = 1e-7, parts: int | None = None,
             block_units: int = BLOCK_UNITS, spec: PamSpec | None = None) -> dict[str, PamModel]:
    """Fit several models that share one set of subject rows; each pass over the data serves all of them.

    ``spec`` contains the terms of all tasks (default: the first task's). With ``smooth`` the smoothing
    parameters maximise the restricted likelihood of the working model, as a performance iteration: a fit is done when
    both the Newton decrement and the gradient in the log parameters are small. Otherwise ``smoothing`` fixes them (by
    penalty label, default 1). Splines are those of ``info``, by default of all rows, but tasks with a basis of
    their own take it from their rows. Unit effects are broadcast ``block_units`` units at a time, which changes no result.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    spec = spec or tasks[0].spec
    used = ["from_day", "to_day", "n", "last_exposure", "seen", *spec.covariates, *spec.exposures,
            *(["n_days"] if spec.exposures else []),
            *([spec.group, spec.group_switch] if spec.group else [])]
    require_columns(blocks, [c for c in used if c != "n_days"], "blocks")
    rules: dict[str, Column] = {}
    strata = []  # the column that marks a task's rows; tasks with the same rule share it
    for t in tasks:
        known = next((name for name, rule in rules.items() if rule is t.rule), f"_use{len(rules)}")
        strata.append(known if t.rule is not None else None)
        rules |= {known: t.rule} if t.rule is not None else {}
    blocks = cut_lineage((blocks.withColumns(rules) if rules else blocks).select(
        *dict.fromkeys([*used, *[t.event for t in tasks], *rules])))
    own = {s: F.col(s) for s, t in zip(strata, tasks) if t.own_basis and s}
    bases = basis_infos(blocks, spec, pred, own) if own else {}
    if info is None and any(s not in bases for s in strata):
        info = basis_info(blocks, spec, pred)
    infos = [bases.get(s, info) for s in strata]
    fulls = [Design(spec, one) for one in infos]
    designs = [Design(t.spec, one) for t, one in zip(tasks, infos)]
    place = {n: i for i, n in enumerate(fulls[0].names)}
    columns = {i: np.array([place[n] for n in d.names]) for i, d in enumerate(designs)}
    states = [_State(i, t, full, full.penalties(), columns[i]) for i, (t, full) in enumerate(zip(tasks, fulls))]
    for st in states:
        for k, pen in enumerate(st.pen):
            st.lam[k] = (smoothing or {}).get(pen.label, 1.0)
        st.lam_group = (smoothing or {}).get("group", 1.0)

    grouped = spec.group is not None
    n_groups = blocks.agg(F.count_distinct(spec.group)).first()[0] if grouped else 0
    unit_blocks = max(1, math.ceil(n_groups / block_units))
    table = _prepare(blocks, tasks, strata, fulls[0], parts, unit_blocks)
    start = table.agg(*[f(i) for i in range(len(tasks)) for f in (
        lambda i: F.sum(F.when(~F.isnull(F.col("y")[i]), F.col("y")[i])).alias(f"e{i}"),
        lambda i: F.sum(F.when(~F.isnull(F.col("y")[i]), F.col("n") * (F.col("to_day") - F.col("from_day"))
                               + F.col("last_exposure"))).alias(f"t{i}"))]).first()
    for st in states:
        events, time = start[f"e{st.index}"], start[f"t{st.index}"]
        if not events or not time:
            raise ValueError(f"model {st.task.name} has no events")
        st.beta[0] = math.log(events / time)

    effects: DataFrame | None = None
    width = fulls[0].p + 2

    def starting(got: dict[int, np.ndarray], active: list[_State]) -> None:
        for st in active:
            st.load(got[st.index])
            if not st.passes and smooth:
                st.scale_penalties(n_groups)
                st.lam, st.lam_group = st.unit * SMOOTHING_START, st.unit_group

    for _ in range(max_passes):
        active = [st for st in states if not st.done]
        if not active:
            break
        met = _with_effects(table, effects, len(tasks), unit_blocks) if grouped else table
        sums = _pass(met, fulls, {st.index: st.beta for st in active}, columns)
        terms, squares = {}, {}
        if not grouped:
            starting(_added(sums), active)
        else:
            sums = cut_lineage(sums)
            units = _unit_sums(sums).persist()
            own_sums = sums.where(F.col("grp").isNull())
            known = all(st.passes for st in active) or not smooth
            if not known:  # the first pass tells the units of the parameters
                starting(_added(own_sums), active)
            nodes = {st.index: _nodes(st.lam_group, st.reach, *(f * st.unit_group for f in GROUP_RANGE)) if smooth
                     else np.array([st.lam_group]) for st in active}
            scales = {st.index: st.unit_group for st in active}
            of_units = _unit_terms(units, nodes, scales, columns, width)
            shift = len(tasks)  # both kinds of sums in one job
            both = of_units.withColumn("model", F.col("model") + shift)
            got = _added(both.unionByName(own_sums) if known else both)
            if known:
                starting(got, active)
            for st in active:
                values = got[st.index + shift].reshape(len(nodes[st.index]), -1)
                terms[st.index] = _between(nodes[st.index], values, scales[st.index], st.p)
                squares[st.index] = float(values[0, -1])
        steps: dict[int, tuple[float, np.ndarray]] = {}
        for st in active:
            square = squares.get(st.index, 0.0)
            st.passes += 1
            before = st.previous
            if before is not None and not (
                    _objective(st, square) <= before["objective"](st) + 1e-8 * abs(before["expected"])):
                if st.halvings >= 20:
                    raise RuntimeError(f"model {st.task.name}: no step along the last direction lowers the objective")
                st.halvings += 1
                st.beta = before["beta"] + (st.beta - before["beta"]) / 2
                continue
            st.halvings = 0
            delta, decrement, lam_group = _step(st, terms.get(st.index), smooth)
            stalled = st.decrement / 2 < decrement < ROUNDING
            st.done = bool((stalled or decrement < tol * max(st.parts[0], 1.0)) and st.gradient < GRADIENT)
            st.decrement = decrement
            st.previous = {"beta": st.beta.copy(), "expected": st.parts[0],
                           "objective": _old_objective(st, st.parts.copy(), st.beta.copy(), square)}
            steps[st.index] = (lam_group, delta)
            st.beta = st.beta + delta
        if grouped:
            moved = _moved_effects(units, steps, columns, width) if steps else None
            halved = [st.index for st in active if st.index not in steps]
            if effects is not None:
                back = F.when(F.col("model").isin(halved), (F.col("b") + F.col("old")) / 2).otherwise(F.col("b"))
                kept = effects.where(~F.col("model").isin(list(steps))).select("model", "grp", back.alias("b"), "old")
                moved = kept if moved is None else moved.unionByName(kept)
            effects = cut_lineage(moved.withColumn("block", _unit_block(unit_blocks)), by=["block"])
            units.unpersist()

    unsettled = [st.task.name for st in states if not st.done]
    if unsettled:
        raise RuntimeError(f"no convergence within {max_passes} passes: {', '.join(unsettled)}")

    out = {}
    for st, design in zip(states, designs):
        groups = None
        if grouped:
            groups = effects.where(F.col("model") == st.index).select("grp", F.col("b").alias("effect"))
        out[st.task.name] = PamModel(
            st.task.name, st.task.spec, design.info, st.beta, st.cov,
            {**{p.label: float(v) for p, v in zip(st.pen, st.lam)},
             **({"group": float(st.lam_group)} if grouped else {})},
            {"edf": float(st.edf), "passes": st.passes, "converged": float(st.done), "gradient": st.gradient,
             "events": float(st.parts[2]), "expected": float(st.parts[0]), **_term_edf(st, design, grouped)}, groups)
    return out


def _term_edf(st: _State, design: Design, grouped: bool) -> dict[str, float]:
    """Effective degrees of freedom of each smooth: the trace of its part of I - V S."""
    lost = np.einsum("ij,ji->i", st.cov, st.penalty())
    out = {f"edf {term}": float(b - a - lost[a:b].sum()) for term, (a, b) in design.spans.items()}
    return {**out, "edf units": float(st.group_edf)} if grouped else out


def fit_pam(blocks: DataFrame, spec: PamSpec, event: str, name: str = "model", **options) -> PamModel:
    """Fit one model."""
    return fit_many(blocks, [Task(name, event, spec)], **options)[name]


def _old_objective(st: _State, parts, beta, square):
    """The last accepted point's objective under the smoothing parameters of the moment."""
    def at(now: _State) -> float:
        return parts[0] - parts[1] + 0.5 * (beta @ now.penalty() @ beta + now.lam_group * square)
    return at
