"""Spelling variant grouping by permuterm rotations.

A word marked with a terminator has one rotation more than it has code points. Written from behind an edited code point on,
a word differs from its variant in the rotation's last place only: two words that replace one code point share all but the last of a
rotation, and a word with one code point inserted has a rotation that is a whole rotation of the other plus one. So every rotation
stands twice in the sorted table, whole and without its last code point, and words are near exactly if they meet under the
same prefix (two shortened ones: a replacement; a whole and a shortened one: an insertion). A prefix and the code point
that follows it determine the word, so a group holds at most one word per letter and the whole one: 27 + 64 with the
letters taken here. Groups are scanned by windows over the sorted prefixes; a group's members are never paired, each
takes the group's size and the best or second best of it. An inserted code point that equals the one before it is found under
several prefixes; only the place at the start of such a run counts.

Words get ids in the order of falling count, then code points, so the best neighbour is the least id and rotations carry 8
bytes instead of words. Prefixes over EXACT code points, which only very long words have, are replaced by sums modulo a
prime of 127 bits that take one step per rotation, so a word of any length costs in proportion to its length. Roots are found by pointer doubling; counts at least halve along a chain, so
few rounds are needed, each written to the shared folder.

Defined cases: a null or empty text has no words; equal rows count as
often as they stand; no words, no rows; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pamspark.llm.common import written

#: Letters of words: A-Z, a-z and the code points C0 to FF.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, FEWEST, RATIO = 5, 3, 2
EXACT = 64
MARK = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PRIME, BASE = (1 << 127) - 1, 0x1F3D5B79A2C4E680B5D7F91A3C5E7081


def runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs without text, with run: a row for each maximal run of at least `shortest` letters, A-Z lower-cased."""
    found = F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    run = F.col("run")
    ascii_only = F.octet_length(run) == F.length(run)
    return docs.withColumn("run", found).drop(text).withColumn("run", F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)))


def counted(words: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of the words that occur often enough; counts are summed in the tasks before they are exchanged."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def numbered(words: DataFrame) -> DataFrame:
    """words (word, n) with id, ascending by falling n and then by code points; written once."""
    ordered = words.orderBy(F.col("n").desc(), "word")
    return written(ordered.withColumn("id", F.monotonically_increasing_id()))


def _long_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `prefixes` for words of at least EXACT code points, by sums that take one step per rotation."""
    for batch in batches:
        for id_, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            sums, powers = [0], [1]
            for c in word:
                sums.append((sums[-1] * BASE + ord(c)) % PRIME)
                powers.append(powers[-1] * BASE % PRIME)
            n, mark = len(word), ord(MARK)

            def prefix(tail, head):
                """word[tail:] + MARK + word[:head]"""
                if n - tail + 1 + head <= EXACT:
                    return word[tail:] + MARK + word[:head]
                back = (sums[n] - sums[tail] * powers[n - tail]) % PRIME
                return f"#{((back * BASE + mark) * powers[head] + sums[head]) % PRIME:x}"

            rows = [(prefix(i, i), id_, True, False) for i in range(n + 1)]
            rows += [(prefix(i + 1, i), id_, False, i == 0 or word[i - 1] != word[i]) for i in range(n)]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 10_000])], ["prefix", "id", "whole", "counts"])


def prefixes(words: DataFrame) -> DataFrame:
    """(prefix, id, whole, counts): every rotation of every word (id, word), whole and without its last code point.

    counts marks the shortened ones whose missing code point differs from the one before it.
    """
    n, i, word = F.length("word"), F.col("i"), F.col("word")
    turned = words.filter(n < EXACT).select("id", "word", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    head = F.concat(F.lit(MARK), F.substring(word, F.lit(1), i))
    after = F.substring(word, i + 2, n)
    letter, before = F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1))
    whole = F.struct(F.concat(F.substring(word, i + 1, n), head).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("counts"))
    short = F.struct(F.concat(after, head).alias("prefix"), F.lit(False).alias("whole"), ((i == 0) | (letter != before)).alias("counts"))
    both = F.when(i < n, F.array(whole, short)).otherwise(F.array(whole))
    rows = turned.select("id", F.explode(both).alias("r")).select("r.prefix", "id", "r.whole", "r.counts")
    long = words.filter(n >= EXACT).select("id", "word").mapInArrow(_long_prefixes, "prefix string, id long, whole boolean, counts boolean")
    return rows.unionByName(long)


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have near ones: how many, and the least id among them."""
    group = Window.partitionBy("prefix").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short, counts = F.col("whole").cast("int"), F.col("counts").cast("int")
    scanned = prefixes(words).select(
        "prefix", "id", "whole", "counts", F.count("*").over(group).alias("members"), F.sum(short).over(group).alias("wholes"),
        F.sum(counts).over(group).alias("inserted"), F.first("id").over(group).alias("first"), F.nth_value("id", 2).over(group).alias("second"))
    scanned = scanned.filter(F.col("members") > 1)
    replaced = F.col("members") - F.col("wholes") - 1
    near = F.when(F.col("whole"), F.col("inserted")).otherwise(replaced + F.when(F.col("counts"), F.col("wholes")).otherwise(0))
    best = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return scanned.select("id", near.alias("near"), best.alias("best")).groupBy("id").agg(
        F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for links (id, form): the end of each chain, doubling what is skipped in every round."""
    links = written(forms.select("id", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("id", "root")
        if not moved.filter("moved").limit(1).count():
            return links


def group(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, n, form, root, n_near, form_n) from counted words (word, n).

    A word's form is its near word of the largest n (ties: the first by code points) if that is at least ratio times its own.
    """
    words = numbered(words)
    near = written(neighbours(words))
    by_id = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = near.join(by_id, "best").join(words.select("id", "n"), "id")
    fits = F.col("form_n") >= ratio * F.col("n")
    found = written(found.select("id", "n_near", *[F.when(fits, F.col(c)).alias(c) for c in ("best", "form", "form_n")]))
    ends = roots(found.filter(F.col("best").isNotNull()).select("id", F.col("best").alias("form")))
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    rows = words.join(found.drop("best"), "id", "left").join(ends, "id", "left")
    return rows.select("word", "n", "form", F.coalesce("root_word", "word").alias("root"),
                       F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
