"""Spelling variants, packing and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pamspark.llm import importance, packing, queries, spelling
from pamspark.llm.common import bounded_batches

from .test_corpus import EDGES, LONG, SF, docs, edges, folder  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ---- spelling ------------------------------------------------------------------------------------------------------


def brute_groups(counts):
    """form, root, n, n_near and form_n of each word by all its edits."""
    letters = sorted({c for w in counts for c in w})

    def near(w):
        found = {w[:i] + w[i + 1:] for i in range(len(w))}
        found |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        found |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        return sorted((x for x in found - {w} if x in counts), key=lambda x: (-counts[x], x))

    nears = {w: near(w) for w in counts}
    form = {w: x[0] if x and counts[x[0]] >= 2 * counts[w] else None for w, x in nears.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(nears[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def grouped(spark, counts):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(rows).collect()}


def test_variants_of_documents(spark, docs):
    counts = collections.Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", r.text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = brute_groups({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_permuterm_variants(spark, SF).collect()}
    assert got == want and sum(v[3] > 0 for v in got.values()) > 50 and any(v[0] != v[1] and v[0] for v in got.values())


def test_variants_of_random_and_long_words(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    for n in (spelling.EXACT - 2, spelling.EXACT - 1, spelling.EXACT, spelling.EXACT + 1, 300):
        base = "".join(rng.choice("abc") for _ in range(n))
        words |= {base, base + "a", "a" + base, base[:5] + base[6:], base[:-1] + "d", base[:9] + "dd" + base[11:], "a" * n}
    counts = {w: rng.choice([3, 4, 9, 20, 50]) for w in words}
    assert grouped(spark, counts) == brute_groups(counts)


def test_chains_end_at_their_root(spark):
    counts = {"abcde" + "f" * i: 3 * 2 ** i for i in range(13)}
    got = grouped(spark, counts)
    assert {v[1] for v in got.values()} == {"abcde" + "f" * 12} and got["abcde"][0] == "abcdef"
    assert grouped(spark, {}) == {}


def test_variants_of_edge_rows(spark, folder):  # noqa: F811
    rows = {r.word: r.n for r in queries.op11_permuterm_variants(spark, folder[0]).collect()}
    assert rows == {"three": 3, "seven": 3}


# ---- packing -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_of_every_code_point(tokenizer):
    import tiktoken
    own = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=packing.ranks(VOCABULARY), special_tokens={})
    assert packing.PATTERN == public_tokenizers.PATTERN
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 50_000):
        texts = [f"a{c}1 {c}{c}b.{c}  {c}" for c in points[i:i + 50_000]]
        for text, wanted in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert own.encode_ordinary(text) == wanted.ids


def checked(rows, texts, tokenizer):
    """Every id in exactly one piece; sequences gapless, full or of a power of two; digests of the pieces."""
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(part.tobytes())
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1]) and sum(p.length for p in pieces) == len(ids[k])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1])
        assert len(pieces) <= packing.SEGMENTS and total <= 2048 and not total & (total - 1)
    return by_sequence


def test_packing_of_documents(spark, docs, tokenizer):  # noqa: F811
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_sequence = checked(queries.op12_vector_packing(spark, SF).collect(), texts, tokenizer)
    full = sum(sum(p.length for p in s) == 2048 for s in by_sequence.values())
    assert full >= len(by_sequence) - 11


def test_packing_of_edge_rows(spark, folder, tokenizer):  # noqa: F811
    rows = queries.op12_vector_packing(spark, folder[0]).collect()
    sizes = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for k, t, *_ in EDGES}
    want = collections.Counter(k for k, *_ in EDGES)
    for k in (1, 2, 3, 4, 6, 7):
        assert sum(r.length for r in rows if r.doc_id == k) == sizes[k] * want[k]
    assert sum(r.length for r in rows if r.doc_id is None) == 1 + sizes[4]


def example_rows(spark, rng, n):
    rows = []
    for i in range(n):
        size = rng.choice([1, 2, 5, 30, 90, 200])
        bears = rng.randint(0, size)
        rows.append((i, np.arange(size, dtype="<u4").tobytes(), bytes([0] * (size - bears) + [1] * bears)))
    return rows, spark.createDataFrame(rows, "doc_id int, ids binary, loss binary")


@pytest.mark.parametrize("cut", [True, False])
def test_three_limits_hold_at_once(spark, cut):
    bounded_batches(spark)
    rows, table = example_rows(spark, random.Random(7), 800)
    out = packing.pack(table, tokens=128, segments=4, loss_tokens=60, cut=cut).collect()
    sequences = collections.defaultdict(list)
    for r in out:
        mask = rows[r.doc_id][2][r.start:r.start + r.length]
        assert r.loss == sum(mask) and r.ids == rows[r.doc_id][1][4 * r.start:4 * (r.start + r.length)]
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        assert sum(r.length for r in s) <= 128 and len(s) <= 4 and sum(r.loss for r in s) <= 60
    if not cut:  # nothing that fits a sequence is cut, and first fit of the longest first does little better
        whole = [r for r in rows if len(r[2]) <= 128 and sum(r[2]) <= 60]
        assert {r[0] for r in whole} == {r.doc_id for r in out if r.length == r.doc_tokens}
        bins = []
        for r in sorted(out, key=lambda r: -r.length):
            fits = next((b for b in bins if b[0] + r.length <= 128 and b[1] < 4 and b[2] + r.loss <= 60), None) or bins.append([0, 0, 0]) or bins[-1]
            fits[:] = fits[0] + r.length, fits[1] + 1, fits[2] + r.loss
        assert len(sequences) <= 1.05 * len(bins)
    assert sum(r.length for r in out) == sum(len(r[2]) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0, 1)), max_size=40), st.integers(1, 5), st.integers(1, 16), st.booleans())
def test_any_examples_are_packed_whole(examples, segments, bearing, cut):
    rng = np.random.default_rng(1)
    edges = np.concatenate(([0], np.cumsum([n for n, _ in examples]))).astype(np.int64)
    loss = np.concatenate(([0], np.cumsum(np.concatenate([rng.random(n) < p for n, p in examples] or [[]])))).astype(np.int64)
    seen = []
    for parts in packing.sequences(edges, loss, (16, segments, bearing), cut):
        total = sum(e - b for b, e in parts)
        assert 0 < total <= 16 and len(parts) <= segments and sum(loss[e] - loss[b] for b, e in parts) <= bearing
        assert not cut or not total & (total - 1)
        seen += [i for b, e in parts for i in range(b, e)]
        assert all(np.searchsorted(edges, b, "right") == np.searchsorted(edges, e - 1, "right") for b, e in parts)
    assert sorted(seen) == list(range(edges[-1]))


def test_one_id_in_a_third_of_all_rows_spreads(spark):
    bounded_batches(spark)
    table = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.unhex(F.repeat(F.lit("01000000"), 100)).alias("ids"))
    out = packing.pack(table)
    blocks = [r["count"] for r in out.filter("doc_id is null").groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(blocks) > 4 and max(blocks) < 3 * sum(blocks) / len(blocks)


# ---- importance ----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.data())
def test_crc_of_any_spans(data, draw):
    n = len(data)
    spans = draw.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(1, n)), min_size=1, max_size=20))
    starts = np.array([s for s, _ in spans])
    ends = np.minimum(starts + [k for _, k in spans], n)
    got = importance.crc32_spans(np.frombuffer(data, np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(data[s:e]) for s, e in zip(starts, ends)]


def test_crc_of_long_spans_folds():
    data = np.random.default_rng(2).integers(0, 256, 100_000).astype(np.uint8)
    lengths = np.array([1, 63, 64, 65, 128, 129, 4095, 4096, 4097, 99_999])
    got = importance.crc32_spans(data, np.zeros(len(lengths), np.int64), lengths)
    assert got.tolist() == [zlib.crc32(data[:n].tobytes()) for n in lengths]


@pytest.mark.parametrize("order", [1, 3])
def test_features_in_pieces(monkeypatch, order):
    texts = ["One two, three!", None, "", "caf\u00e9 \u00e9t\u00e9 X1", LONG[:3000], "w" * 500 + " end", "..."]
    monkeypatch.setattr(importance, "CHUNK", 100)
    got = [collections.Counter() for _ in texts]
    for _, rows, found in importance.feature_buckets(pa.array(texts), 1 << 32, order):
        for r, b in zip(rows, found):
            got[r][int(b)] += 1
    for text, counts in zip(texts, got):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        runs = [" ".join(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]
        assert counts == collections.Counter(zlib.crc32(r.encode()) for r in runs)


def test_resampling_of_documents(spark, docs):  # noqa: F811
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    raw = collections.Counter(bucket(w) for t in texts.values() for w in t)
    target = collections.Counter(bucket(w) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in words(r.text))
    a, b = sum(raw.values()), sum(target.values())
    gain = {k: math.floor(1000 * math.log((target[k] + 1) * (a + 10_000) / ((n + 1) * (b + 10_000)))) for k, n in raw.items()}
    rows = {r.doc_id: r for r in queries.op13_importance_sample(spark, SF).collect()}
    scores = {}
    for k, t in texts.items():
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in t) // len(t) if t else 0
        scores[k] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        assert (rows[k].n_features, rows[k].weight, rows[k].score) == (len(t), weight, scores[k])
    able = sorted((k for k, t in texts.items() if len(t) >= 20), key=lambda k: (-scores[k], k))
    want = {k: i + 1 for i, k in enumerate(able[:10 * len(able) // 100])}
    assert {k: r.rank for k, r in rows.items() if r.rank} == want


def test_ranks_of_repeated_ids_and_nulls(spark):
    rows = [(1, 30, 5)] * 40 + [(None, 30, 5)] * 10 + [(2, 30, 5)] * 3 + [(0, 30, 7)] * 2 + [(9, 3, 99)] + [(8, 30, -4)] * 45
    out = importance.draw(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), percent=54).collect()
    ranks = {k: sorted(r.rank for r in out if r.doc_id == k and r.rank) for k in (0, 1, 2, None, 8, 9)}
    assert ranks == {0: [1, 2], 1: list(range(3, 43)), 2: [43, 44, 45], None: list(range(46, 55)), 8: [], 9: []} and len(out) == len(rows)


def test_resampling_keeps_clashing_columns(spark, docs):  # noqa: F811
    bounded_batches(spark)
    names = ["weight", "score", "rank", "row", "_salt", "_ahead", "bucket", "n_words", "_inside", "c_score"]
    table = docs.select("*", *[F.lit(n).alias(n) for n in names])
    out = importance.resample(table, docs, keep=True)
    assert out.count() == docs.count() and all(out.filter(F.col(f"row.{n}") != n).count() == 0 for n in names)
