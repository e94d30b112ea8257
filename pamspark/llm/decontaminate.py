"""Benchmark decontamination by template windows.

Texts become sequences of tokens in which numbers (numerals with their decimal and thousands parts, runs of number words), names (capitalised words that go on in small letters; neighbours within a
sentence are one) and units after a number are typed placeholders. Whether a capitalised word that begins a sentence is a name cannot be
told, so texts are read twice, with all such words plain and with all of them names; items also with their first word read on its own,
as what stands before it in a document is not the item's (a heading without a full stop, a number before a unit).
Windows of WIDTH tokens with at least LITERAL plain words are hashed; an item shorter than that is one window of its own width.
Of every item the untyped windows of WIDTH words, or of all its words if it has fewer, are searched besides: so each item that has
a word is found where it stands word for word, however short it is and however many numbers and names it has. Documents are searched for the windows' hashes,
in blocks of at most BLOCK of them, and only hits leave a task. Hits are hash-joined to the items' windows; hits of
one reading of document and item with one distance between their places in both are one occurrence. In an occurrence each value of the item's
slots must stand for one value of the document: then a question is caught however its numbers, names and units were
changed, and a chance meeting of templates is not.

An occurrence counts if it has LEAST windows, or all of a shorter item, and at least CONSISTENT of its slot values
keep to one value; the item's first and last token may run on in the document and are not held to that. Windows, share and kind
are those of the occurrence with the greatest share. Defined cases: null and empty texts and items match nothing; items without a word match nothing,
those of fewer than SHORTEST tokens or without enough plain words are not found if their numbers, names or units were changed; a repeated row is found as often as it stands, as one result; hits of a
window that many items share count for each item; an item of fewer than LEAST_WIDTH tokens (a common word or phrase) is reported like others,
with its width, but no document is dropped for it; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pamspark.llm.common import ALNUM, blocks, mix, text_bytes, word_hashes, word_places, written

WIDTH, LITERAL, SHORTEST = 8, 5, 5
LEAST = 5
#: Items of fewer tokens do not drop documents.
LEAST_WIDTH = 5
CONSISTENT = 0.8
BLOCK = 1_000_000
#: Words that count as numbers, and units that may follow a number.
NUMBERS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
           "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
SCALES = "hundred thousand million billion".split()
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l "
         "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year "
         "years percent dollar dollars cent cents euro euros mph kmh degree degrees meter meters metre metres kilometer kilometers").split()
NUMBER, NAME, UNIT = (np.uint64(k) for k in (1, 2, 3))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes(*text_bytes(pa.array([" ".join(words)])), ALNUM)[0])


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


#: Canonical token hashes (placeholders are 1 to 3), n + 1 offsets of the texts, first and last byte of each token.
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]


def readings(data: np.ndarray, offsets: np.ndarray, alone: bool = False) -> list[Tokens]:
    """Plain words alone; tokens with the words that may begin a sentence plain, and with the capitalised ones among them names.

    alone: what stands before a text is not known, so its first word is also read on its own, as a name, a unit and plain.
    """
    h, at, (first, last) = word_places(data, offsets, ALNUM)
    if not len(h):
        return [(h, at, np.zeros((2, 0), np.int64))] * (7 if alone else 3)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    digit = (data[first] >= 48) & (data[first] <= 57)
    spelled, scale = _among(h, _hashes(NUMBERS)), _among(h, _hashes(SCALES))
    number = digit | spelled
    following = np.concatenate(([False], rows[1:] == rows[:-1]))
    # digits joined by a sign, number words in a row, and a scale after digits are one numeral
    gap = first - np.concatenate(([0], last[:-1])) - 1
    signs = np.frombuffer(b".,/", np.uint8)
    joined = digit & following & (gap == 1) & np.isin(data[np.maximum(first - 1, 0)], signs)
    joined &= np.concatenate(([False], (data[last[:-1]] >= 48) & (data[last[:-1]] <= 57) & digit[:-1]))
    loose = np.ones(256, bool)
    loose[np.frombuffer(b" \t\n\r\v\f-", np.uint8)] = False
    marks = np.concatenate(([0], np.cumsum(loose[data])))
    clean = following & np.concatenate(([False], marks[first[1:]] == marks[last[:-1] + 1]))
    joined |= spelled & clean & np.concatenate(([False], spelled[:-1] | digit[:-1])) & (scale | np.concatenate(([False], spelled[:-1])))
    linked = np.flatnonzero(_among(h[1:-1], _hashes(["and"])) & scale[:-2] & spelled[2:] & clean[1:-1] & clean[2:]) + 1
    number[linked] = joined[linked] = joined[linked + 1] = True
    unit = _among(h, _hashes(UNITS)) & following & np.concatenate(([False], number[:-1]))
    # the last byte before a word that is not white space tells whether a sentence begins
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    before = np.maximum.accumulate(np.where(solid[data], np.arange(len(data)), -1))[np.maximum(first - 1, 0)]
    inner = following & (before >= 0) & ~np.isin(data[np.maximum(before, 0)], np.frombuffer(b".!?:;\"", np.uint8))
    second = data[np.minimum(first + 1, len(data) - 1)]
    capital = ((data[first] >= 65) & (data[first] <= 90)) | ((data[first] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    # words in capitals throughout are plain words
    small = ((second >= 97) & (second <= 122)) | (second >= 0x80)
    capital &= small & (last > first) & ~number & ~unit

    def read(name: np.ndarray, unit: np.ndarray) -> Tokens:
        # a run of names is one token that ends with its last word, as is a numeral
        again = name & np.concatenate(([False], name[:-1])) & inner | joined
        keep = np.flatnonzero(~again)
        out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))[keep]
        sizes = np.bincount(rows[keep], minlength=len(at) - 1)
        return out, np.concatenate(([0], np.cumsum(sizes))), np.stack((first[keep], last[np.append(keep[1:], len(h)) - 1]))

    found = [(h, at, np.stack((first, last))), read(capital & inner, unit), read(capital, unit)]
    if alone:
        begins = ~following
        known_unit = begins & ~number & _among(h, _hashes(UNITS))
        found += [read(capital & (inner | begins), unit), read(capital & ~begins, unit), read(capital & inner & ~known_unit, unit | known_unit),
                  read(capital & ~known_unit, unit | known_unit)]
    return found


def windows(canonical: np.ndarray, offsets: np.ndarray, width: int, typed: bool) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window of width tokens within a text; of typed ones those that have enough plain words."""
    n = len(canonical) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(width if typed else width + 2 * WIDTH))
    for i in range(width):
        h = h * _MULTIPLIER + canonical[i : i + n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    held = np.arange(n) + width <= ends
    if typed:
        plain = np.concatenate(([0], np.cumsum(canonical > 3)))
        held &= plain[width:] - plain[:n] >= min(LITERAL, width)
    at = np.flatnonzero(held)
    return at, mix(h[at])


def _slots(canonical: np.ndarray, spans: np.ndarray, data: np.ndarray, at: int, width: int) -> list[str]:
    return [f"{canonical[i]}:{data[spans[0, i] : spans[1, i] + 1].tobytes().decode('utf-8', 'replace').lower()}"
            for i in range(at, at + width) if canonical[i] <= 3]


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, reading, place, hash, slots, inner, width, windows) of all benchmark items (item_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column("text"))
            read = readings(data, offsets, alone=True)
            rows: list[tuple] = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                seen = set()
                for reading, (canonical, at, spans) in enumerate(read):
                    a, b = at[i], at[i + 1]
                    width, key, typed = min(WIDTH, int(b - a)), canonical[a:b].tobytes(), reading > 0
                    if width < (SHORTEST if typed else 1) or (key, typed) in seen:
                        continue
                    seen.add((key, typed))
                    places, h = windows(canonical[a:b], np.array([0, b - a]), width, typed)
                    rows += [(item, reading, int(p), int(x), _slots(canonical, spans, data, a + p, width),
                              [a < j < b - 1 for j in range(a + p, a + p + width) if canonical[j] <= 3], width, len(places))
                             for p, x in zip(places, h.view(np.int64))]
            columns = list(zip(*rows)) if rows else [[]] * 8
            types = [batch.column("item_id").type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["item_id", "reading", "place", "hash", "slots", "inner", "width", "windows"])
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(
        run, f"item_id {kind}, reading int, place long, hash long, slots array<string>, inner array<boolean>, width int, windows long")


def _hits(docs: DataFrame, known: np.ndarray, widths: list[tuple[bool, int]]) -> DataFrame:
    """(doc_id, tid, seen, at, hash, found) of the documents' windows whose hash is among known."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column("text"))
            rows, seen, places, hashes, slots = [], [], [], [], []
            for (reading, (canonical, at, spans)), (typed, width) in product(enumerate(readings(data, offsets)), widths):
                if typed != (reading > 0):
                    continue
                first, h = windows(canonical, at, width, typed)
                hit = np.flatnonzero(_among(h, held.value))
                row = np.searchsorted(at, first[hit], "right") - 1
                if not typed and width < WIDTH:
                    # the whole of its items, so one place in a text tells all
                    hit = hit[np.unique(np.stack((row.astype(np.uint64), h[hit])), axis=1, return_index=True)[1]]
                    row = np.searchsorted(at, first[hit], "right") - 1
                rows += row.tolist()
                seen += [reading] * len(row)
                places += (first[hit] - at[row]).tolist()
                hashes += h[hit].view(np.int64).tolist()
                slots += [_slots(canonical, spans, data, p, width) for p in first[hit]] if typed else [[]] * len(hit)
            taken = batch.select(["doc_id", "tid"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(seen, pa.int32()), pa.array(places, pa.int64()), pa.array(hashes, pa.int64()),
                                              pa.array(slots, pa.list_(pa.string()))], ["doc_id", "tid", "seen", "at", "hash", "found"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "tid", "text").mapInArrow(run, f"doc_id {kind}, tid binary, seen int, at long, hash long, found array<string>")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tid, item_id, windows, item_windows, width, share, kind, consistency): a row for each document and item it holds.

    width is that of the windows, WIDTH or all tokens of a shorter item; tid names the text (its MD5); kind is exact if no slot value was changed, else reparameterised.
    """
    docs = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"), "text")
    known = written(item_windows(items))
    widths = sorted(tuple(r) for r in known.select(F.col("reading") > 0, "width").distinct().collect())
    hashes = known.select("hash").distinct()
    parts = max(1, -(-hashes.count() // BLOCK))
    found = None
    for part in range(parts):
        block = hashes.filter(F.pmod("hash", F.lit(parts)) == part).toArrow().column("hash").to_numpy()
        hits = _hits(docs, np.sort(block.view(np.uint64)), widths)
        found = hits if found is None else found.unionByName(hits)
    joined = written(found.join(known, "hash").withColumn("gap", F.col("at") - F.col("place")))
    key = ["doc_id", "tid", "item_id", "reading", "seen", "gap"]
    runs = joined.groupBy(*key).agg(F.countDistinct("place").alias("windows"), F.first("windows").alias("item_windows"),
                                   F.max("width").alias("width"))
    runs = runs.filter(F.col("windows") >= F.least("item_windows", F.lit(LEAST)))
    slots = joined.select(*key, F.explode(F.arrays_zip("slots", "inner", "found")).alias("s")).select(*key, "s.slots", "s.inner", "s.found")
    kept = F.when(F.col("inner"), F.col("found"))
    values = slots.groupBy(*key, "slots").agg(F.min("found").alias("low"), F.max("found").alias("high"), (F.min(kept) == F.max(kept)).alias("one"))
    values = values.groupBy(*key).agg(F.avg(F.col("one").cast("double")).alias("consistency"),
                                      F.min((F.col("low") == F.col("slots")) & (F.col("high") == F.col("slots"))).alias("exact"))
    same = reduce(and_, [runs[k].eqNullSafe(values[k]) for k in key])
    judged = runs.join(values, same, "left").select(
        *[runs[k] for k in key], runs["windows"], runs["item_windows"], runs["width"], F.coalesce("consistency", F.lit(1.0)).alias("consistency"),
        F.coalesce("exact", F.lit(True)).alias("exact")).filter(F.col("consistency") >= CONSISTENT)
    best = F.struct((F.col("windows") / F.col("item_windows")).alias("share"), "exact", "windows", "item_windows", "consistency", "width")
    judged = judged.groupBy("doc_id", "tid", "item_id").agg(F.max(best).alias("b"))
    return judged.select("doc_id", "tid", "item_id", "b.windows", "b.item_windows", "b.width", "b.share",
                         F.when(F.col("b.exact"), "exact").otherwise("reparameterised").alias("kind"), "b.consistency")


def without_leaks(docs: DataFrame, items: DataFrame, least_width: int = LEAST_WIDTH) -> DataFrame:
    """docs without the documents that hold a benchmark item of at least least_width tokens; `leaks` reports shorter ones."""
    found = leaks(docs, items).filter(F.col("width") >= least_width)
    found = written(found.select(F.col("doc_id").alias("_doc_id"), F.col("tid").alias("_tid")).distinct())
    rows = docs.withColumn("_text_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    same = (rows["_text_id"] == found["_tid"]) & rows["doc_id"].eqNullSafe(found["_doc_id"])
    return rows.join(found, same, "left_anti").drop("_text_id")
