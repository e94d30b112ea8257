"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (letters, digits, bytes over 127, lower-cased). A shingle weighs its number of places
times 1 + IDF_SHARE * log(N / df) / log(N): the share is small, so that 0.8 of weighted Jaccard similarity lies close to
0.8 of the plain one even inside a group of thousands of copies. Document frequencies of all documents are summed in
2^DF_BITS hash buckets, a table of fixed size that every task may hold.

Improved consistent weighted sampling draws SAMPLES (shingle, level) pairs from each text; two texts agree in a sample
with the probability of their weighted Jaccard similarity. BANDS bands of ROWS samples make the candidates. Equal texts
are one from the start. In each bucket all texts are compared with one pivot, not with each other; verified pairs are
joined into classes; buckets that still hold several classes get another pivot of their own, and what is left in them
is compared in blocks of whole texts, of which only links leave a task. Every candidate pair is judged by the weighted
Jaccard similarity of the whole texts. Nothing is capped or sampled, and no links or components come to the driver.

Defined cases: a null text is empty; texts without words are alike only if equal; a text of fewer than five words is one
shingle; repeated rows and rows without id belong to the class of their text; a class is named by its least doc_id; an
empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pamspark.llm.common import ALNUM, blocks, mix, shingle_hashes, text_bytes, word_hashes, written

BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
THRESHOLD = 0.8
DF_BITS = 20
IDF_SHARE = 0.25
#: Texts on either side of a block, and shared shingles that are multiplied at once.
BLOCK, COLUMNS = 1024, 2048
_SLOT_BITS = 15
_DRAWS: dict[str, np.ndarray] = {}


def _draws() -> dict[str, np.ndarray]:
    """Random numbers of the sampling, by sample and shingle slot; the same everywhere."""
    if not _DRAWS:
        cells = np.arange(SAMPLES << _SLOT_BITS, dtype=np.uint64).reshape(SAMPLES, -1)
        uniform = [((mix(cells * np.uint64(8) + np.uint64(i + 1)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53) for i in range(5)]
        r = -np.log(uniform[0] * uniform[1])
        _DRAWS.update(r=r.astype(np.float32), per_r=(1 / r).astype(np.float32), beta=uniform[2].astype(np.float32),
                      log_c=np.log(-np.log(uniform[3] * uniform[4])).astype(np.float32))
    return _DRAWS


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, their numbers of places, and the n + 1 offsets of the texts."""
    words, offsets = word_hashes(*text_bytes(column), ALNUM)
    h, rows = shingle_hashes(words, offsets)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    keys, counts, sizes = [], [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        own = np.sort(h[a:b])
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if b > a else np.zeros(0, np.int64)
        keys.append(own[first])
        counts.append(np.diff(np.append(first, b - a)))
        sizes[i] = len(first)
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(counts) if counts else np.zeros(0, np.int64),
            np.concatenate(([0], np.cumsum(sizes))))


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - DF_BITS)).astype(np.int64)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight factor of each hash bucket, from the document frequencies of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DF_BITS, np.int64)
        for batch in blocks(batches):
            total += np.bincount(bucket(term_counts(batch.column("text"))[0]), minlength=1 << DF_BITS)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "df"])

    # a row for each bucket, whatever the corpus
    found = docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    n = max(2, docs.count())
    df = np.ones(1 << DF_BITS)
    df[found.column("bucket").to_numpy()] = found.column("df").to_numpy()
    return (1 + IDF_SHARE * np.log(np.maximum(1, n / df)) / np.log(n)).astype(np.float32)


def signatures(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLES 32-bit hashes for each text that has shingles, and the rows of these texts."""
    keys, counts, offsets = term_counts(column)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes)
    out = np.zeros((len(rows), SAMPLES), np.uint32)
    if not len(rows):
        return out, rows
    draws, starts = _draws(), offsets[:-1][rows]
    log_w = np.log(counts.astype(np.float32) * idf[bucket(keys)])
    slot = (keys & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int32)
    which = np.repeat(np.arange(len(rows)), sizes[rows])
    for k in range(SAMPLES):
        r, beta = draws["r"][k][slot], draws["beta"][k][slot]
        level = np.floor(log_w * draws["per_r"][k][slot] + beta)
        a = draws["log_c"][k][slot] - r * (level - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[which])
        at = at[np.searchsorted(which[at], np.arange(len(rows)))]
        out[:, k] = mix(keys[at] ^ (level[at].astype(np.int64).view(np.uint64) << np.uint64(1))) >> np.uint64(32)
    return out, rows


def band_keys(signs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(signs), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(signs), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h ^ signs[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = h
    return out


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts, given by all their shingle hashes in order."""
    (ka, na), (kb, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    wa, wb = idf[bucket(ka)] * na, idf[bucket(kb)] * nb
    common = float(np.minimum(wa[ia], wb[ib]).sum(dtype=float))
    return common / (float(wa.sum(dtype=float) + wb.sum(dtype=float)) - common)


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _signed(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, tid, sign, bands) of each row; sign and bands are null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            signs, rows = signatures(batch.column("text"), idf.value)
            sign, bands = [None] * batch.num_rows, [None] * batch.num_rows
            for row, s, b in zip(rows, signs, band_keys(signs).view(np.int64)):
                sign[row], bands[row] = s.tobytes(), b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(sign, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "tid", "sign", "bands"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tid", "text").mapInArrow(run, f"doc_id {kind}, tid binary, sign binary, bands array<bigint>")


def _terms(docs: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """(tid, terms): the ordered shingle hashes of the texts that share a bucket, as bytes; whole texts move once."""
    wanted = buckets.select("tid").distinct().join(reps.select("tid", "first_id"), "tid")
    texts = docs.join(wanted, (docs["tid"] == wanted["tid"]) & docs["doc_id"].eqNullSafe(wanted["first_id"])).select(docs["tid"], docs["text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys, counts, offsets = term_counts(batch.column("text"))
            each = [np.repeat(keys[a:b], counts[a:b]).tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(each, pa.binary())], ["tid", "terms"])

    # rows of one id and text that stand more than once are one
    return written(texts.mapInArrow(sets, "tid binary, terms binary").groupBy("tid").agg(F.first("terms").alias("terms")))


def _verified(pairs: DataFrame, terms: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of text ids whose texts are alike."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), idf.value) >= THRESHOLD
                    for x, y in zip(batch.column("left"), batch.column("right"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(terms.select(F.col("tid").alias("a"), F.col("terms").alias("left")), "a")
            .join(terms.select(F.col("tid").alias("b"), F.col("terms").alias("right")), "b"))
    return both.select("a", "b", "left", "right").mapInArrow(verify, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(tid, class): the least id of each connected set, by passing on least labels and jumping along them."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("tid"), F.least("a", "b").alias("class")))
    while True:
        near = both.join(labels.withColumnRenamed("tid", "b"), "b").groupBy("a").agg(F.min("class").alias("near"))
        moved = labels.join(near.withColumnRenamed("a", "tid"), "tid").select("tid", F.least("class", "near").alias("to"), "class")
        jump = moved.select(F.col("tid").alias("to"), F.col("to").alias("further"))
        moved = written(moved.join(jump, "to").select("tid", F.least("to", "further").alias("class"), F.col("class").alias("was")))
        labels = moved.select("tid", "class")
        if moved.filter("class <> was").isEmpty():
            return labels


def _pivot_pairs(buckets: DataFrame, own: bool) -> DataFrame:
    """Each text of a bucket with the bucket's pivot, where they are in different classes; a pair once.

    Pivots are first the most central texts, which share the most buckets' places with others, like the origin of many
    copies, or come from a random order of each bucket's own.
    """
    draw = F.xxhash64("band", "tid") if own else F.xxhash64("tid")
    order = F.struct(F.lit(0) if own else -F.col("central"), draw)
    pivots = buckets.groupBy("band").agg(F.min(F.struct(order.alias("at"), "tid", "class")).alias("pivot"))
    pairs = buckets.join(pivots, "band").filter(F.col("class") != F.col("pivot.class"))
    return pairs.select(F.least("tid", "pivot.tid").alias("a"), F.greatest("tid", "pivot.tid").alias("b")).distinct()


def _mixed_buckets(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(band, tid, central, class, n) of the buckets that hold several classes; a text without label is its own class."""
    if labels is None:
        rows = buckets.withColumn("class", F.col("tid"))
    else:
        rows = buckets.join(labels, "tid", "left").withColumn("class", F.coalesce("class", "tid"))
    several = rows.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).filter("low <> high")
    return written(rows.join(several.select("band", "n"), "band"))


def common_weights(own: list[np.ndarray], other: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights that each text of own shares with each of other, and all weights of either; texts as in `similarity`."""
    texts = own + other
    keys, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    rows = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(keys))
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))
    place = at - np.maximum.accumulate(np.where(new, at, 0))
    weight = idf[bucket(keys)].astype(float)
    total = np.bincount(rows, weight, len(texts))
    # the second place of a shingle is a column of its own, so that counts meet in their minimum
    _, column, times = np.unique(mix(keys + place.astype(np.uint64)), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    rows, column, weight = rows[shared], number[column[shared]], weight[shared]
    order = np.argsort(column, kind="stable")
    rows, column, weight = rows[order], column[order], weight[order]
    out = np.zeros((len(own), len(other)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        x, w = np.zeros((len(texts), COLUMNS)), np.zeros(COLUMNS)
        x[rows[part], column[part] - low] = 1
        w[column[part] - low] = weight[part]
        out += (x[: len(own)] * w) @ x[len(own) :].T
    return out, total[: len(own)], total[len(own) :]


def _block_links(buckets: DataFrame, terms: DataFrame, idf) -> DataFrame:
    """All pairs (a, b) of alike texts in different classes of a bucket, found in blocks of about BLOCK x BLOCK texts.

    A bucket of two has been compared already. Only links leave a task.
    """
    rows = buckets.filter("n > 2").join(terms, "tid")
    # blocks are dealt by a hash and so hold BLOCK texts at most on average
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("tid"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        tid, kind = table.column("tid").to_pylist(), table.column("class").to_pylist()
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        part = table.column("own").to_numpy()
        a, b = np.flatnonzero(part == first), np.flatnonzero(part == second)
        out: list[tuple[bytes, bytes]] = []
        if len({kind[k] for k in (*a, *b)}) > 1 and len(a) and len(b):
            sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in table.column("terms")]
            common, wa, wb = common_weights([sets[k] for k in a], [sets[k] for k in b], idf.value)
            for x, y in np.argwhere(common >= THRESHOLD * (wa[:, None] + wb[None, :] - common)):
                u, v = a[x], b[y]
                if kind[u] != kind[v]:
                    out.append((min(tid[u], tid[v]), max(tid[u], tid[v])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})

    return (rows.select("band", "i", "j", "own", "tid", "class", "terms").groupBy("band", "i", "j")
            .applyInArrow(compare, "a binary, b binary").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, tid, first_tid): a row for each row of docs (doc_id, text).

    class_id is the least doc_id of the class, first_tid the id of a text that has it.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", text_id(F.col("text")))
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(docs))
    signed = written(_signed(docs, idf))
    reps = written(signed.groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.first("sign").alias("sign"), F.first("bands").alias("bands")))
    banded = reps.select("tid", F.explode("bands").alias("band"))
    shared = written(banded.join(banded.groupBy("band").count().filter("count > 1"), "band"))
    central = shared.groupBy("tid").agg(F.sum("count").alias("central"))
    buckets = written(shared.select("band", "tid").join(central, "tid"))
    terms = _terms(docs, reps, buckets)
    edges, labels = None, None
    for step in ("central pivot", "own pivot", "blocks"):
        mixed = _mixed_buckets(buckets, labels)
        if step == "blocks":
            fresh = written(_block_links(mixed, terms, idf))
        else:
            fresh = written(_verified(written(_pivot_pairs(mixed, step == "own pivot")), terms, idf))
        if not fresh.isEmpty():
            edges = fresh if edges is None else edges.unionByName(fresh)
            labels = components(edges)
    rows = signed.select("doc_id", "tid")
    if labels is None:
        rows = rows.withColumn("class", F.col("tid"))
    else:
        rows = rows.join(labels, "tid", "left").withColumn("class", F.coalesce("class", "tid"))
    rows = written(rows)
    named = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("least"), F.count("*").alias("class_size"))
    return rows.join(named, "class").select("doc_id", F.col("least.doc_id").alias("class_id"), "class_size", "tid", F.col("least.tid").alias("first_tid"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each class the document that names it, with all columns; repeated rows of it once."""
    tid = text_id(F.coalesce(docs["text"], F.lit("")))
    firsts = found.select(F.col("class_id").alias("_first"), F.col("first_tid").alias("_tid")).distinct()
    rows = docs.withColumns({"_tid": tid, "_key": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    firsts = firsts.select("_tid", F.coalesce("_first", F.lit(-(1 << 63))).alias("_key"))
    once = Window.partitionBy("_tid", "_key").orderBy("_key")
    return rows.join(firsts, ["_tid", "_key"], "left_semi").withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_tid", "_key", "_n")
