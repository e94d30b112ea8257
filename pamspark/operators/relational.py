"""Relational operators shared by the reports: strata, frequency tables, last rows, joins, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import matched


def keep_known(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys`` (left semi join)."""
    return df.join(keys.select(key), key, "left_semi")


def drop_known(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``keys`` (left anti join); a null key is kept."""
    return df.join(keys.select(key), key, "left_anti")


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every shared column name."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no shared column to join on")
    return left.join(right, shared, "left")


def relabel(df: DataFrame, col: str, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace codes by labels and add ``<col>_ord``, the place in the given order.

    The label list is written in the program, so it becomes a CASE expression, not a join.
    """
    text = F.lit(None).cast("string")
    order = F.lit(None).cast("int")
    for i, (code, label) in reversed(list(enumerate(labels, 1))):
        text = F.when(F.col(col) == code, F.lit(label)).otherwise(text)
        order = F.when(F.col(col) == code, F.lit(i)).otherwise(order)
    return df.withColumns({f"{col}_ord": order, col: text})


def label_join(df: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Inner join to a label dictionary of the program's own, broadcast."""
    return df.join(F.broadcast(labels), on, "inner")


def exclude_names(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """Drop rows whose name matches one of the patterns; a pattern without match drops nothing."""
    for p in patterns:
        df = df.where(~matched(col, p))
    return df


def round_columns(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    """Round several columns in one projection."""
    return df.withColumns({c: F.bround(c, digits) for c in cols})


def last_per_group(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key.

    The filter on row_number lets Spark keep one row per key before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def levels(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct levels."""
    return df.select(col).distinct().orderBy(col)


def stack_strata(df: DataFrame, strata: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, stratum) as ``variable, level`` text, so all strata are one group by."""
    pairs = F.array(*[F.struct(F.lit(s).alias("variable"), F.col(s).cast("string").alias("level"))
                      for s in strata])
    return df.select(*keep, F.explode(pairs).alias("p")).select("p.variable", "p.level", *keep)


def stratum_rates(df: DataFrame, strata: Sequence[str], outcome: str) -> DataFrame:
    """Count, percent of all rows and mean outcome per level of every stratum, in one pass.

    Null levels are counted in the denominator but are not listed.
    """
    per_level = stack_strata(df, strata, [outcome]).groupBy("variable", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate"))
    total = Window.partitionBy("variable")
    return (per_level.withColumn("percent", 100 * F.col("n") / F.sum("n").over(total))
            .where(F.col("level").isNotNull())
            .select("variable", "level", "n", "percent", (100 * F.col("rate")).alias("outcome_percent")))


def frequency(df: DataFrame, col: str, all_levels: Sequence | None = None) -> DataFrame:
    """Count per level without nulls; with ``all_levels`` also the levels that do not occur, as 0."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if all_levels is None:
        return counts
    spark = df.sparkSession
    kind = df.schema[col].dataType.simpleString()
    known = spark.createDataFrame([(v,) for v in all_levels], f"{col} {kind}")
    return known.join(counts, col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(cols), name, value)


def bind_named(frames: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Union named frames by column name, the name becoming a column."""
    out = None
    for label, frame in frames.items():
        tagged = frame.withColumn(name, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def cut_labels(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest edge included; outside the edges is null."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        above = col >= edges[i] if i == 0 else col > edges[i]
        top = edges[i + 1]
        inside = above if top is None else above & (col <= top)
        out = F.when(inside, F.lit(labels[i])).otherwise(out)
    return out


def extreme_rows(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows holding the smallest or largest value of their group, ties kept.

    The extremes are aggregated first and joined back, so no group moves as a whole. A row that is both
    (all values of its group equal) comes twice.
    """
    ends = df.groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.col(value)
    which = F.filter(F.array(F.when(v == F.col("_lo"), "min"), F.when(v == F.col("_hi"), "max")),
                     lambda e: e.isNotNull())
    return df.join(ends, by).withColumn("extreme", F.explode(which)).drop("_lo", "_hi")
