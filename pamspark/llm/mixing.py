"""Mixing sources to target weights with hash-random order and exact budgets.

Sources, ordered by code point with null last, get weights in turn and share a multiple of all words; a target stops
at `most` times its source's size and the excess is shared again by weight. Every document gets a hash-random key;
keys are cut into hash cells, words are summed by source and cell, running sums over the cells of a source and then
over the documents of a cell give each document the words that come before it in its source. A budget takes whole
epochs first and cuts the last one at the exact word. A source with a third of all rows is spread over its cells.
Only one row per source comes to the driver, where the weights are given per source.

Defined cases: a null or empty text has size 0 and is never taken; a source without words has target 0; repeated
rows share a key and follow one another; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pamspark.llm.common import cells_for

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source, in source order."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = {i: weights[i % len(weights)] for i in range(len(sizes))}
    while free:
        whole = sum(free.values())
        full = [i for i, w in free.items() if left * w / whole > most * sizes[i]]
        if not full:
            return [left * free[i] / whole if i in free else out[i] for i in range(len(sizes))]
        for i in full:
            out[i] = most * sizes[i]
            del free[i]
        left = max(0.0, left - sum(out[i] for i in full))
    return out


def mix(docs: DataFrame, size: str = "size", source: str = "source", keys: Sequence[str] = ("doc_id",), seed: int = 17,
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with source_size, target, epochs (whole ones), part (words of the last, cut one) and taken."""
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "epochs", "part", "taken").withColumn(
        "_source", F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("a"), F.col(source))))
    found = sorted(docs.groupBy("_source").agg(F.sum(size).alias("words"), F.count("*").alias("rows")).collect())
    wanted = targets([r.words for r in found], weights, share, most)
    rows = [(r._source, int(r.words), t, min(int(t), int(most * r.words))) for r, t in zip(found, wanted)]
    plan = spark.createDataFrame(rows, "_source string, source_size long, target double, _budget long")
    cells = cells_for(max([r.rows for r in found], default=0))
    docs = docs.withColumn("_at", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), 1))
    docs = docs.withColumn("_cell", F.shiftright("_at", 63 - (cells.bit_length() - 1)).cast("int"))
    ahead = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = (docs.groupBy("_source", "_cell").agg(F.sum(size).alias("_words"))
            .withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).drop("_words")
            .join(plan, "_source"))
    order = [F.col("_at"), *[F.col(k).asc_nulls_first() for k in keys]]
    before = Window.partitionBy("_source", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = docs.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).join(sums, ["_source", "_cell"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0).cast("long")
    ranked = ranked.withColumn("epochs", epochs)
    rest = F.col("_budget") - F.col("epochs") * F.col("source_size") - F.col("_ahead") - F.col("_before")
    ranked = ranked.withColumn("part", F.least(F.greatest(rest, F.lit(0)), F.col(size)))
    return ranked.withColumn("taken", F.col("epochs") * F.col(size) + F.col("part")).drop(
        "_source", "_at", "_cell", "_ahead", "_before", "_budget")


def mixed_texts(mixed: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """A row for each time that the mix takes a document; the one cut document of a source ends after `part` words,
    which are then joined by single spaces."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")
    times = F.col("epochs") + (F.col("part") > 0).cast("long")
    rows = mixed.filter(F.col("taken") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    last = (F.col("epoch") > F.col("epochs")) & (F.col("part") < F.col(size))
    return rows.withColumn(text, F.when(last, cut).otherwise(F.col(text)))
