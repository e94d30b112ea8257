"""License scan: exact phrases and fuzzy short notices with their spans.

A text is lower-cased (A-Z) and cut into words of letters, digits and bytes over 127; notices are searched in the
words joined by single blanks. A notice of n letters may differ by n // LETTERS_PER_EDIT edits. It is split into one
more pieces than that: at least one piece of any such occurrence stands unchanged (pigeonhole), so only places around
an exact piece are looked at. There the bounded-error matching of the regex library verifies the notice and tells its
span and edits, best match first, then in what is left on both sides of it. Of overlapping matches the one with the fewest edits stays, then the longer one.

Defined cases: a null text is empty, an empty one has no words, labels or spans; notices may repeat within a text;
repeated rows get equal results; an empty table gives an empty result; other columns pass through, but columns named
like the results are replaced. Whole texts are searched, in memory in proportion to one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from pamspark.llm.common import blocks

#: Phrases whose exact places are counted, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices as they stand in public license texts, in words, and their SPDX-like labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl-3",
    "subject to the terms of the mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under the bsd license": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under a creative commons attribution license": "cc-by",
    "dedicated to the public domain under cc0": "cc0",
}
LETTERS_PER_EDIT = 9
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@lru_cache
def searchers(notices: tuple[tuple[str, str], ...]) -> list[tuple]:
    """For each notice: text, label, edits, pieces with their offsets, pattern."""
    out = []
    for text, label in notices:
        edits = len(text) // LETTERS_PER_EDIT
        cuts = [i * len(text) // (edits + 1) for i in range(edits + 2)]
        pieces = [(text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        out.append((text, label, edits, pieces, regex.compile(rf"(?b)\b(?:{regex.escape(text, special_only=True)}){{e<={edits}}}\b")))
    return out


def normal_words(text: str) -> list[str]:
    return [w.decode() for w in WORD.findall(text.encode().lower())]


def places(normal: str, text: str, edits: int, pieces: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Merged windows of the normalized text around exact pieces of a notice."""
    found = []
    for piece, offset in pieces:
        at = normal.find(piece)
        while at >= 0:
            # a blank more on either side, so that word ends can be seen
            found.append((max(0, at - offset - edits - 1), at - offset + len(text) + edits + 1))
            at = normal.find(piece, at + 1)
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def notice_matches(normal: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, str, int]]:
    """(edits, start, end, label, letters of the notice) of the matches that stay, in text order."""
    found = []
    for text, label, edits, pieces, pattern in searchers(notices):
        for low, high in places(normal, text, edits, pieces):
            # the library returns the best match of what it is given, so both sides of it are searched again
            open_parts = [(low, min(high, len(normal)))]
            while open_parts:
                a, b = open_parts.pop()
                m = pattern.search(normal, a, b) if b - a >= len(text) - edits else None
                if m:
                    found.append((sum(m.fuzzy_counts), m.start(), m.end(), label, len(text)))
                    open_parts += [(a, m.start()), (m.end(), b)]
    kept: list[tuple[int, int, int, str, int]] = []
    for one in sorted(found, key=lambda f: (f[0], f[1] - f[2], f[1], f[3])):
        if all(one[2] <= k[1] or one[1] >= k[2] for k in kept):
            kept.append(one)
    return sorted(kept, key=lambda k: k[1])


def scan_text(text: str | None, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> dict:
    """All results of one text."""
    words = WORD.findall((text or "").encode().lower())
    normal = b" ".join(words).decode()
    padded, starts, base = f" {normal} ", [], set()
    for phrase, label in phrases:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append(padded.count(" ", 0, at))
            base.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    spans = [{"label": label, "first_word": normal.count(" ", 0, start + (normal[start:start + 1] == " ")),
              "last_word": normal.count(" ", 0, end), "edits": edits, "similarity": 1 - edits / letters}
             for edits, start, end, label, letters in notice_matches(normal, notices)]
    labels = base | {s["label"] for s in spans}
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
            "score": 1.0 if base else max((s["similarity"] for s in spans), default=0.0), "spans": spans}


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])
RESULTS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
           "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(SPAN)}
_SQL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, " \
       "spans array<struct<label:string,first_word:long,last_word:long,edits:long,similarity:double>>"


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         keep_text: bool = True) -> DataFrame:
    """docs with counts, labels, score and the spans of fuzzy notices (words from 0, last one included)."""
    known, fuzzy = tuple((phrases or PHRASES).items()), tuple((notices or NOTICES).items())
    docs = docs.drop(*[c for c in RESULTS if c != text])
    passed = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            rows = [scan_text(t, known, fuzzy) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed] + [pa.array([r[n] for r in rows], t) for n, t in RESULTS.items()], [*passed, *RESULTS])

    schema = T.StructType([f for f in docs.schema.fields if f.name in passed] + T.StructType.fromDDL(_SQL).fields)
    return docs.mapInArrow(run, schema)
