"""Importance resampling toward a target: documents whose hashed word runs look like the target's are drawn more often.

Features are all runs of 1 to `order` consecutive words (lower-cased A-Z), joined by one space; a feature's bucket is the CRC-32
of its UTF-8 bytes modulo `buckets`. CRC-32 is linear, so the checksum of a span is the XOR of one table entry per byte,
chosen by the byte and its distance from the span's end, and of a constant that depends on the length alone: a whole batch of
spans is one gather and one `bitwise_xor.reduceat`. Spans of more than BLOCK bytes are cut into blocks from their end; each
block is summed like a short span and neighbouring blocks fold pairwise, the earlier one moved on by the length of the later.

Bucket counts of all documents and of the target are summed in each task and then by bucket, so only `buckets` numbers per
task are exchanged. A bucket's gain is the scaled log ratio of its smoothed shares; a document's weight is the floored mean
over its features. Weight plus Gumbel noise from a digest of the id is the score, and the highest scores are the sample:
drawing without replacement in proportion to the exponential weights. Ranks need no global sort: scores are whole numbers
of a bounded range (at most some 100,000 values whatever the corpus), so a histogram tells how many rows lie ahead of each
score, and ties are numbered by id, repeated ids over SALTS groups.

Defined cases: a null or empty text has no features and weight 0; a null id counts as empty in the digest and comes last
among ties; repeated rows each have a rank of their own; a text of any length is read in pieces of CHUNK bytes of words;
documents of fewer than `least` words get a score but are never drawn; an empty table gives an empty result, an empty target
gives every bucket its smoothed share alone. Only the id and the results
are returned; keep=True adds the row's own columns as one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pamspark.llm.common import ALNUM, blocks, text_bytes, word_places, written

BUCKETS, ORDER, PERCENT, LEAST, SEED = 10_000, 1, 10, 20, 2024
SALTS = 256
BLOCK = 64
#: Bytes of words that are expanded at once.
CHUNK = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _step(register: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC registers after one more zero byte."""
    return first[register & np.uint32(255)] ^ (register >> np.uint32(8))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte contributes at each distance from a span's end, and the constants of lengths 0 to BLOCK."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> np.uint32(1)) ^ np.uint32(0xEDB88320), first >> np.uint32(1)).astype(np.uint32)
    rows, start = [first], [np.uint32([0xFFFFFFFF])]
    for _ in range(BLOCK):
        rows.append(_step(rows[-1], first))
        start.append(_step(start[-1], first))
    return np.stack(rows), np.concatenate(start)


_BY_DISTANCE, _START = _tables()
#: The bytes of a register at the end of a message, moved on by BLOCK zero bytes; one table of 256 for each byte.
_MOVES = [np.stack([_BY_DISTANCE[BLOCK - 1 - i] for i in range(4)])]


def _moved(register: np.ndarray, level: int) -> np.ndarray:
    """Registers after BLOCK * 2^level more zero bytes."""
    def move(r, tables):
        out = np.zeros(r.shape, np.uint32)
        for i in range(4):
            out ^= tables[i][(r >> np.uint32(8 * i)) & np.uint32(255)]
        return out

    while len(_MOVES) <= level:
        _MOVES.append(move(_MOVES[-1], _MOVES[-1]))
    return move(register, _MOVES[level])


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What a CRC-32 has from its length alone: the starting register moved on by the length, and the closing flip."""
    register = _START[lengths % BLOCK]
    whole, level = lengths // BLOCK, 0
    while whole.any():
        register = np.where(whole & 1, _moved(register, level), register)
        whole, level = whole >> 1, level + 1
    return register ^ np.uint32(0xFFFFFFFF)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for each span, none of them empty; spans may overlap."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    parts = -(-lengths // BLOCK)
    span, after = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    if parts.max() > 1:
        span = np.repeat(span, parts)
        after = np.arange(len(span)) - np.repeat(np.cumsum(parts) - parts, parts)  # blocks behind this one
    stop = ends[span] - after * BLOCK
    begin = np.maximum(starts[span], stop - BLOCK)
    size = stop - begin
    at = np.cumsum(size) - size
    distance = np.repeat(at + size - 1, size) - np.arange(int(size.sum()))
    found = _BY_DISTANCE[distance, data[np.repeat(stop - 1, size) - distance]]
    register = np.bitwise_xor.reduceat(found, at)
    level = 0
    while len(register) > len(starts):  # the blocks of a span stand from its last one on; pairs fold
        odd = (after & 1).astype(bool)
        moved = _moved(register[odd], level)
        register = register.copy()
        register[np.flatnonzero(odd) - 1] ^= moved
        register, span, after, level = register[~odd], span[~odd], after[~odd] >> 1, level + 1
    return register ^ length_constants(lengths)


def feature_buckets(column: pa.Array, buckets: int = BUCKETS, order: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of a run, rows, buckets) of all features of the texts, in pieces with ascending rows."""
    data, offsets = text_bytes(column)
    _, at, (starts, ends) = word_places(data, offsets, ALNUM)
    if not len(starts):
        return
    lengths = ends - starts + 1
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    last = np.repeat(at[1:], np.diff(at))  # one more than the text's last word
    piece = np.cumsum(lengths) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        reach = min(len(starts), b + order - 1)
        size = lengths[a:reach] + 1  # a space behind each word
        place = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(place, size)
        source = np.minimum(np.repeat(starts[a:reach], size) + inside, len(data) - 1)
        joined = np.where(inside < np.repeat(size - 1, size), _LOWER[data[source]], np.uint8(32))
        for width in range(1, order + 1):
            first = np.flatnonzero(np.arange(a, b) + width <= last[a:b])
            if len(first):
                end = place[first + width - 1] + size[first + width - 1] - 1
                yield width, rows[a + first], crc32_spans(joined, place[first], end).astype(np.int64) % buckets


def bucket_counts(table: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task sends every bucket once at most."""
    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in blocks(batches):
            for _, _, found in feature_buckets(batch.column("text"), buckets, order):
                total += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])

    found = table.select(table[text].alias("text")).mapInArrow(counted, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed share in the target to that in the raw texts, rounded down."""
    b, raw, target = len(raw), raw.astype(float), target.astype(float)
    ratio = (target + 1) * (raw.sum() + b) / ((raw + 1) * (target.sum() + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def fitted_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Gains of all buckets, from all documents and all target texts; `buckets` numbers of each come to the driver."""
    def dense(table):
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(table, text, buckets, order).collect():
            out[bucket] = n
        return out

    return gains(dense(docs), dense(target))


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_features and weight of all rows; with keep, the row's own columns as a struct `row` beside them."""
    def weighed(batches):
        for batch in blocks(batches):
            n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for width, row, found in feature_buckets(batch.column("text"), len(gain), order):
                here = np.bincount(row, minlength=batch.num_rows)
                n += here
                words += here if width == 1 else 0
                sums = np.concatenate(([0], np.cumsum(gain[found])))
                edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
                total += sums[edge[1:]] - sums[edge[:-1]]
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(words), pa.array(n), pa.array(mean)],
                                             [*own, "n_words", "n_features", "weight"])

    own = [docs[doc_id].alias("doc_id"), *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else [])]
    table = docs.select(*own, docs[text].alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name != "text")
    return table.mapInArrow(weighed, f"{kinds}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """scored (doc_id, n_words, score and others) with rank: 1, 2, .. by falling score for the drawn rows, else null.

    scored is written once with a salt for each row: rows of one id and score, however many, are numbered in SALTS groups.
    """
    rows = written(scored.withColumn("_salt", (F.rand(SEED) * SALTS).cast("int")))
    able = F.col("n_words") >= least
    by_score = rows.filter(able).groupBy("score").count()
    wanted = (by_score.agg(F.sum("count")).first()[0] or 0) * percent // 100
    ahead = F.sum("count").over(Window.orderBy(F.col("score").desc())) - F.col("count")
    # one row per whole score, a bounded number: see the module's text
    starts = by_score.select("score", ahead.alias("_ahead")).filter(F.col("_ahead") < wanted)
    rows = rows.join(F.broadcast(starts), "score", "left").withColumn("_ahead", F.when(able, F.col("_ahead")))
    drawn = rows.filter(F.col("_ahead").isNotNull())
    cell = ["score", "doc_id", "_salt"]
    before = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = drawn.groupBy(*cell).count().select(*[F.col(c).alias(f"c_{c}") for c in cell],
                                                F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_inside"))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in cell]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(F.lit(0)))
    rank = (F.col("_ahead") + F.col("_inside") + place).cast("long")
    drawn = drawn.join(cells, same).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    others = rows.filter(F.col("_ahead").isNull()).withColumn("rank", F.lit(None).cast("long"))
    out = [*scored.columns, "rank"]
    return drawn.select(*out).unionByName(others.select(*out))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, order: int = ORDER,
             percent: int = PERCENT, least: int = LEAST, seed: int = SEED, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of all documents; those with a rank are the sample."""
    gain = fitted_gains(docs, target, text, buckets, order)
    scored = weights(docs, gain, text, doc_id, order, keep).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(scored, percent, least)
