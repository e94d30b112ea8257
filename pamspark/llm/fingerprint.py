"""One-permutation MinHash fingerprints of documents, in DataFrame expressions only.

A text is lower-cased and split at white space; its shingles are runs of five words (a shorter text has one
shingle of all its words, an empty one a single empty shingle). Every shingle is hashed once. The top bits of the
hash choose one of BINS bins, the rest is ordered, and each bin keeps its least hash. An empty bin takes the value
of another one by optimal densification: it probes bins drawn by a hash of its own number until it meets a filled
one. Of each bin, hashed with its number so that copied values differ by chance alone, the low BITS bits are kept,
packed as hexadecimal text. Likeness is the share of equal bins,
corrected for the 2^-BITS chance of equal low bits.

Defined cases: a null text is empty; equal texts, repeated rows and empty texts have equal fingerprints and
likeness 1; an empty table gives an empty result; other columns of the input pass through `fingerprints`. A very
long text is handled within its row, in memory in proportion to that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pamspark.llm.common import SHINGLE, let

BINS, BITS = 128, 8
#: Probes that are tried one after another before the filled bins are ranked instead.
PROBES = 12
_SHIFT = 63 - (BINS.bit_length() - 1)
_REST = (1 << _SHIFT) - 1
_PER_WORD = 64 // BITS


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Array of non-negative 63-bit hashes, one for each run of width words of text."""
    words = F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w)))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) < width, whole).otherwise(each)

    return F.transform(let(hashed, runs), lambda s: s.bitwiseAND((1 << 63) - 1))


def _bin_minima(hashes: Column) -> Column:
    """The least hash of each bin in bin order; a bin without any holds the largest value it could have."""
    fences = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)),
                         lambda i: F.shiftleft(i.cast("long"), _SHIFT).bitwiseOR(F.lit(_REST)))
    return let(F.sort_array(F.concat(hashes, fences)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT))))


def _densified(minima: Column) -> Column:
    """Minima without their bin numbers, empty bins filled from others."""
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))

    def fill(v: Column) -> Column:
        def value(i: Column) -> Column:
            probes = [F.nullif(F.get(v, F.pmod(F.xxhash64(i, F.lit(r)), F.lit(BINS)).cast("int")), F.lit(_REST))
                      for r in range(PROBES)]
            ranked = F.array_min(F.transform(
                F.filter(bins, lambda j: F.get(v, j) != _REST),
                lambda j: F.struct(F.xxhash64(i, F.lit(PROBES), j).alias("at"), F.get(v, j).alias("value"))))["value"]
            return F.coalesce(F.nullif(F.get(v, i), F.lit(_REST)), *probes, ranked)
        return F.transform(bins, value)

    return let(F.transform(minima, lambda x: x.bitwiseAND(F.lit(_REST))), fill)


def fingerprint(text: Column) -> Column:
    """BINS values of BITS bits each as hexadecimal text."""
    def pack(v: Column) -> Column:
        def word(k: Column) -> Column:
            out = F.lit(0).cast("long")
            for b in range(_PER_WORD):
                at = k * _PER_WORD + b
                low = F.xxhash64(F.get(v, at), at).bitwiseAND(F.lit((1 << BITS) - 1))
                out = out.bitwiseOR(F.shiftleft(low, BITS * (_PER_WORD - 1 - b)))
            return F.lpad(F.lower(F.hex(out)), 16, "0")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_WORD - 1)), word), "")

    return let(_densified(_bin_minima(shingle_hashes(F.coalesce(text, F.lit(""))))), pack)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1; null if one is null."""
    chars = BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)),
                           lambda i: F.substring(a, i * chars + 1, F.lit(chars)) == F.substring(b, i * chars + 1, F.lit(chars))))
    chance = 2.0 ** -BITS
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text."""
    return docs.withColumn(out, fingerprint(docs[text]))


def _range_number(docs: DataFrame, key: str, rows_per_range: int) -> Column:
    """Number of the quantile range that key lies in, by binary search among at most 65,535 bounds; null is first."""
    ranges = min(1 << 16, -(-docs.count() // rows_per_range))
    if ranges < 2:
        return F.lit(0)
    bounds = docs.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    known = F.split(F.lit(",".join(str(int(b)) for b in sorted(set(bounds)))), ",").cast("array<bigint>")
    steps = F.split(F.lit(",".join(str(1 << i) for i in reversed(range(ranges.bit_length())))), ",").cast("array<int>")
    return F.when(F.col(key).isNull(), 0).otherwise(F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.col(key), at + step).otherwise(at)))


def with_next(docs: DataFrame, key: str, column: str, rows_per_range: int = 2_000) -> DataFrame:
    """Each row with next_<column> of the next one in the order of key (ties by the column), the last with the first.

    Rows meet their neighbour within a range of keys, by one shuffle; only the first row of each range is looked up
    from the range before it. `_range` and `_is_last` stay, so that what is computed of a row can be passed on to
    the row before it by the same window; see `next_in_range`.
    """
    order = [F.col(key).asc_nulls_first(), F.col(column).asc_nulls_first()]
    ranged = docs.withColumn("_range", _range_number(docs, key, rows_per_range))
    within = Window.partitionBy("_range").orderBy(*order)
    after = F.lead(F.struct(column)).over(within)
    ahead = ranged.withColumn("_after", after)
    firsts = ranged.withColumn("_n", F.row_number().over(within)).filter("_n = 1").select("_range", F.col(column).alias("_first"))
    # one row for each range, none for each document
    turn = Window.orderBy("_range")
    turns = ranged.groupBy("_range").count().select(
        "_range", F.coalesce(F.lead("_range").over(turn), F.first("_range").over(turn)).alias("_from"))
    firsts = turns.join(firsts.withColumnRenamed("_range", "_from"), "_from").select("_range", "_first")
    is_last = F.col("_after").isNull()
    return (ahead.join(firsts, "_range")
            .withColumn(f"next_{column}", F.when(is_last, F.col("_first")).otherwise(F.col("_after")[column]))
            .withColumn("_is_last", is_last).drop("_after", "_first"))


def next_in_range(value: str, key: str, column: str) -> Column:
    """value of the next row after `with_next(.., key, column)`; null for the last row of a range."""
    return F.lead(value).over(Window.partitionBy("_range").orderBy(
        F.col(key).asc_nulls_first(), F.col(column).asc_nulls_first()))
