"""Helpers of the corpus operators: shared folder, word hashes over Arrow text, ranks within hash cells."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

SHINGLE = 5
#: Bytes of text that are hashed at once; arrays of eight bytes per text byte are made for it.
CHUNK = 500_000
BATCH_BYTES = 8_000_000

_X = np.uint64(0x9E3779B97F4A7C15)
_X_INVERSE = np.uint64(pow(int(_X), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES: a limit in rows alone would let long texts fill a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends at files that outlive executors."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written_in_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """df written like `written`, a file for each bucket of a column: groups by it are read where they lie, without an exchange."""
    spark = df.sparkSession
    if buckets > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")):
        return written(df).repartition(buckets, column)
    name = f"written_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", shared_folder(spark))
    dealt.saveAsTable(name, format="parquet")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files under its path stay
    return found


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: list[str], salts: int = 64) -> DataFrame:
    """All rows with what table, which has one row per key, says of theirs: a key of many rows is spread over salts by a hash of by.

    Only the pairs of key and salt that occur are joined to the table first, at most salts for a key.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    spread = rows.select(key, "_salt").distinct().join(table, key, "left")
    return rows.join(spread, [key, "_salt"], "left").drop("_salt")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, so that value is computed once per row whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        ones = np.full(max(n, CHUNK), _X, np.uint64)
        ones[0] = 1
        _POWERS["up"] = np.multiply.accumulate(ones)
        ones[1:] = _X_INVERSE
        _POWERS["down"] = np.multiply.accumulate(ones)
    return _POWERS["up"], _POWERS["down"]


def byte_classes(word: bytes | None = None) -> np.ndarray:
    """For each byte its code inside a word after lower-casing A-Z, 0 for bytes that separate words.

    word: the ASCII bytes that belong to words beside all bytes over 127; None: all but white space.
    """
    codes = np.arange(256, dtype=np.uint64) + np.uint64(1)
    codes[65:91] += np.uint64(32)
    keep = np.ones(256, bool)
    if word is None:
        keep[[32, 9, 10, 11, 12, 13]] = False
    else:
        keep[:128] = False
        keep[np.frombuffer(word, np.uint8)] = True
    codes[~keep] = 0
    return codes


ALNUM = byte_classes(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SPACED = byte_classes()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word and the n + 1 offsets of each text's words; equal words hash alike everywhere."""
    h, at, _ = word_places(data, offsets, codes)
    return h, at


def word_places(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`word_hashes` with the first and the last byte of each word, as an array of two rows."""
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    spans: list[np.ndarray] = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # cut where a text begins or a word ends
            cuts = offsets[(offsets > at) & (offsets <= end)]
            gaps = np.flatnonzero(codes[data[at:end]] == 0)
            end = max(int(cuts[-1]) if len(cuts) else 0, at + int(gaps[-1]) + 1 if len(gaps) else 0)
            if end <= at:
                rest = np.flatnonzero(codes[data[at + CHUNK :]] == 0)
                later = offsets[offsets > at]
                end = min(int(later[0]), at + CHUNK + int(rest[0]) + 1 if len(rest) else n)
        c = codes[data[at:end]]
        inside = c != 0
        edge = np.zeros(len(c) + 1, bool)
        edge[offsets[(offsets >= at) & (offsets <= end)] - at] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:]))
        up, down = _powers(len(c))
        sums = np.cumsum(c * up[: len(c)])
        h = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
        found.append(mix(h * down[starts]))
        spans.append(np.stack((starts + at, ends + at)))
        rows = np.searchsorted(offsets, starts + at, "right") - 1
        counts += np.bincount(rows, minlength=len(counts))
        at = end
    return (np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts))),
            np.concatenate(spans, axis=1) if spans else np.zeros((2, 0), np.int64))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of width words and the row it belongs to; a shorter text with words has one of all its words."""
    lengths = np.diff(offsets)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    h = np.zeros(len(words), np.uint64)
    ends = np.repeat(offsets[1:], lengths)
    at = np.arange(len(words))
    for i in range(width):
        part = padded[i : i + len(words)]
        h = h * _X + np.where(at + i < ends, part, np.uint64(0))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    first = at == np.repeat(offsets[:-1], lengths)
    keep = (at + width <= ends) | (first & (ends - at < width))
    return mix(h[keep]), rows[keep]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one have about most bytes; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(column))[1])
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table has."""
    return df.select(*[df[n] for n in names])


def cells_for(rows: int, per_cell: int = 2_000, least: int = 64, most: int = 1 << 20) -> int:
    """A power of two of hash cells, about per_cell rows each; at most a million, as one sum per cell is gathered."""
    return min(most, max(least, 1 << max(0, (rows // per_cell).bit_length())))


def rank_window(*by: str, order: list[Column]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)
