"""Exact interpolated quantiles that never gather a group's values in one task.

`percentile` keeps every distinct value of a group in one aggregation buffer. Here the values are
first counted (a distributed group by value) and written; a bounded sketch over the distinct values supplies
bin edges; bin totals give each bin's first rank; only the bins that hold a wanted rank go on. A bin that
holds more than IN_ONE_BIN distinct values gets a sketch of its own, until the bins are small enough to be
ordered. The sketches decide how work is split, never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut_lineage

BINS = 64
IN_ONE_BIN = 10_000


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the key columns of ``left`` are kept."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long table ``by, variable, value, n`` of the values of several columns, null included."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    return (df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.variable", "p.value")
            .groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float],
                    bins: int = BINS, in_one_bin: int = IN_ONE_BIN) -> DataFrame:
    """Interpolated quantiles (rank ``(n - 1) p``) of ``cols`` per stratum: ``by, variable, q0, q1, ...``.

    ``bins`` splits every stratum; many strata are spread already and need few.
    """
    hist = cut_lineage(value_counts(df, by, cols))
    return _count_quantiles(hist, [*by, "variable"], probs, bins, in_one_bin)


def _rank_columns(total: str, probs: Sequence[float]) -> list[tuple[str, Column]]:
    out = []
    for i, p in enumerate(probs):
        h = (F.col(total) - 1) * F.lit(float(p))
        out += [(f"lo{i}", F.floor(h)), (f"hi{i}", F.ceil(h))]
    return out


def wanted_bins(hist: DataFrame, keys: Sequence[str], probs: Sequence[float], bins: int = BINS,
                in_one_bin: int = IN_ONE_BIN) -> tuple[DataFrame, list[str]]:
    """Values of the bins that hold a wanted rank, ``keys, bin0, bin1, ..., value, n, total, first_rank``, and the
    columns of a bin; ``hist`` is a written table ``keys, value, n``.

    Edges and bins are written: they are tables of the size of the strata, whose known size decides how they are joined.
    """
    if bins < 2:
        raise ValueError("a stratum needs two bins or more")
    # nulls weigh nothing here; filtering them would lose strata that have no other value
    hist = hist.withColumn("n", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    group, total = list(keys), F.sum("n")
    rows = hist.withColumn("first_rank", F.lit(0).cast("long"))
    for level in count():
        edges = cut_lineage(rows.groupBy(*group).agg(
            F.percentile_approx("value", [i / bins for i in range(1, bins)], 10 * bins).alias("edges"), total.alias("total")))
        bin_ = f"bin{level}"
        binned = _join_on(rows.drop("total"), edges, group).withColumn(
            bin_, F.size(F.filter("edges", lambda e: e < F.col("value")))).drop("edges")
        per_bin = binned.groupBy(*group, bin_).agg(
            F.sum("n").alias("bin_n"), F.count(F.lit(1)).alias("values"), F.max("total").alias("bin_total"),
            F.max("first_rank").alias("before"))
        earlier = F.sum("bin_n").over(Window.partitionBy(*group).orderBy(bin_)) - F.col("bin_n")
        per_bin = per_bin.withColumn("first_rank", F.col("before") + earlier)
        holds = reduce(or_, [(r >= F.col("first_rank")) & (r < F.col("first_rank") + F.col("bin_n"))
                             for _, r in _rank_columns("bin_total", probs)])
        group = [*group, bin_]
        held = cut_lineage(per_bin.where(holds).select(*group, "values", "first_rank"))
        rows = _join_on(binned.drop("first_rank"), held.drop("values"), group)
        if (held.agg(F.max("values")).first()[0] or 0) <= in_one_bin:
            return rows, group
        rows, total = cut_lineage(rows), F.max("total")


def _count_quantiles(hist: DataFrame, keys: Sequence[str], probs: Sequence[float], bins: int = BINS,
                     in_one_bin: int = IN_ONE_BIN) -> DataFrame:
    placed, group = wanted_bins(hist, keys, probs, bins, in_one_bin)
    inside = Window.partitionBy(*group).orderBy("value")
    ranked = placed.withColumn(
        "end", F.col("first_rank") + F.sum("n").over(inside)).withColumn(
        "start", F.col("end") - F.col("n"))
    picked = ranked.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[F.max(F.when((r >= F.col("start")) & (r < F.col("end")), F.col("value"))).alias(a)
          for a, r in _rank_columns("total", probs)])
    out = []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(p))
        out.append((F.col(f"lo{i}") + (h - F.floor(h)) * (F.col(f"hi{i}") - F.col(f"lo{i}")))
                   .alias(f"q{i}"))
    return picked.select(*keys, *out)


def mean_and_quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float],
                       bins: int = BINS) -> DataFrame:
    """Mean and exact quantiles per stratum from one count per value: ``by, variable, mean, q0, ...``."""
    keys = [*by, "variable"]
    hist = cut_lineage(value_counts(df, by, cols))
    weight = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    means = hist.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum(weight)).alias("mean"))
    return _join_on(means, _count_quantiles(hist, keys, probs, bins), keys)


def six_number_summary(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of several columns per stratum.

    Everything is taken from one count per value, so the input is read once.
    """
    keys = [*by, "variable"]
    hist = cut_lineage(value_counts(df, by, cols))
    known = F.col("value").isNotNull()
    moments = hist.groupBy(*keys).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.min("value").alias("min_value"),
        F.sum(F.col("value") * F.col("n")).alias("weighted"), F.max("value").alias("max_value"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_missing"))
    q = _count_quantiles(hist, keys, [0.25, 0.5, 0.75])
    return _join_on(moments, q, keys, "left").select(
        *keys, "n", "min_value", F.col("q0").alias("q1_value"), F.col("q1").alias("median_value"),
        (F.col("weighted") / F.col("n")).alias("mean_value"), F.col("q2").alias("q3_value"),
        "max_value", "n_missing")


def global_rank(df: DataFrame, order: str, salts: int = 64) -> DataFrame:
    """Add ``rank`` 1..n in ascending order over all rows, nulls first, without one task seeing them all.

    Rows are counted by value and a hash of the row, so that ties of one value are spread over ``salts``
    groups and numbered in any order. The counts are split at approximate quantiles of the values and
    added up inside each bin and over the bins; only then do rows get their place in their group.
    """
    keys = [order, "_salt"]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    edges = df.agg(F.percentile_approx(order, [i / BINS for i in range(1, BINS)], 20 * BINS).alias("_edges"))
    binned = counts.crossJoin(F.broadcast(edges)).withColumn("_bin", F.when(F.col(order).isNull(), -1).otherwise(
        F.size(F.filter("_edges", lambda e: e < F.col(order))))).drop("_edges")
    per_bin = binned.groupBy("_bin").agg(F.sum("_n").alias("_bin_n"))
    before = per_bin.select("_bin", (F.sum("_bin_n").over(Window.orderBy("_bin")) - F.col("_bin_n")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_bin").orderBy(*keys)) - F.col("_n")
    starts = binned.withColumn("_inside", inside).join(F.broadcast(before), "_bin").select(
        *keys, (F.col("_before") + F.col("_inside")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return _join_on(salted, starts, keys).withColumn("rank", place + F.col("_start")).drop("_salt", "_start")
