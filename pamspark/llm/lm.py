"""Language-model scoring by context-tree weighting over bytes, with an add-one unigram score beside it.

Every byte of a lower-cased (A-Z) text, and a closing byte 255, is eight binary decisions. A decision is predicted
from the bits of its byte so far and from the 0 to DEPTH bytes before it (255 before a text begins). Contexts of up to
SPLIT bytes are all nodes; a longer one is a node if it occurs LEAST times in the training texts, and what a node saw
under longer contexts that are none forms one child more. A node's block probability is the Krichevsky-Trofimov
estimate of how often either bit followed; bottom-up each node mixes it half and half with the product of its
children. Top-down the posterior weights of stopping at a depth turn into one probability per decision, a mix of the
estimates of all depths. Contexts of up to SPLIT bytes that were never met in training estimate one half.

Texts are dealt into blocks of about BLOCK_BYTES by a hash, compressed as they are read. A block sends its distinct
strings of DEPTH + 1 bytes and its distinct words once, with their number in training texts, sorted and packed, to
buckets, which are written bucket by bucket so that they are exchanged once; a bucket holds all strings whose last
SPLIT context bytes are the same, so it has whole subtrees. Nodes of up to SPLIT bytes are tables of Spark. The answers
come back to the block in the order of its strings, so what is exchanged follows the corpus and nothing is broadcast.
A task holds a block and its distinct strings, or the distinct strings of a bucket with the subtrees of about
TREE_KEYS of them at a time. Words are known by 64-bit hashes.

Defined cases: a null text is empty and an empty text has its closing byte and one end token; a null id counts as
empty for the fold; equal rows get equal scores; without training texts every decision has probability one half and
c = N = V = 0; an empty table gives an empty result. A text is never cut: a block grows by a very long one, which is
read in pieces of about CHUNK bytes only where other texts end. Only the id and the results are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pamspark.llm.common import SPACED, mix, text_bytes, word_hashes, written, written_in_buckets

#: Bytes of context; with the byte that follows they are one 64-bit key.
DEPTH = 7
#: Contexts up to this length are all nodes, in Spark tables; longer ones are kept in buckets.
SPLIT = 4
#: Occurrences in training texts that make a node of a longer context.
LEAST = 2
BLOCK_BYTES = 10_000_000
CHUNK = 1_000_000
#: Keys that are sorted at once.
SORT_KEYS = 1_000_000
#: Strings whose subtrees are held at once; those of one context of SPLIT bytes stay together.
TREE_KEYS = 400_000
#: The key of the end token; no word hash is looked up under it.
END_TOKEN = np.uint64(0)
_BYTE = np.uint64(8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte and each closing byte its key: the DEPTH bytes before it, the nearest one highest, and itself lowest."""
    n = np.diff(offsets)
    stream = np.full(len(data) + len(n) * (DEPTH + 1), 255, np.uint8)
    shift = np.repeat(np.arange(len(n)) * (DEPTH + 1) + DEPTH, n)
    stream[np.arange(len(data)) + shift] = _LOWER[data]
    keys = np.zeros(len(stream) - DEPTH, np.uint64)
    for i in range(1, DEPTH + 1):
        keys = (keys << _BYTE) | stream[DEPTH - i : len(stream) - i]
    keys = (keys << _BYTE) | stream[DEPTH:]
    # windows that reach over the end of a text are not its own
    own = np.ones(len(keys), bool)
    ends = np.cumsum(n + DEPTH + 1)[:-1]
    own[(ends[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return keys[own]


def _packed(values: np.ndarray) -> bytes:
    """The values byte place by byte place, compressed: sorted keys share their high bytes."""
    places = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(places).tobytes(), 1)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    places = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(places.T).view(kind).ravel()


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ids, trains, sizes, texts): one row for each block in a batch, its texts one after the other, compressed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order = np.argsort(batch.column("block").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        block = batch.column("block").to_numpy()
        data, offsets = text_bytes(batch.column("text"))
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        rows = np.append(first, len(block))
        starts = pa.array(rows.astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, c) for c in (batch.column("doc_id"), batch.column("trains"), pa.array(np.diff(offsets)))]
        texts = [zstandard.compress(data[offsets[a] : offsets[b]].tobytes(), 1) for a, b in zip(rows, rows[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block[first]), *lists, pa.array(texts, pa.binary())], ["block", "ids", "trains", "sizes", "texts"])


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of all texts of a block, and which of them are learned from."""
    data = np.frombuffer(b"".join(zstandard.decompress(x.as_buffer()) for x in table.column("texts")), np.uint8)
    sizes = pc.list_flatten(table.column("sizes")).to_numpy()
    return data, np.concatenate(([0], np.cumsum(sizes))), pc.list_flatten(table.column("trains")).to_numpy(zero_copy_only=False)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK bytes: first row, bytes, offsets."""
    rows = len(offsets) - 1
    if not rows:
        return
    part = offsets[1:] // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), rows]
    for a, b in zip(cuts, cuts[1:]):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _sorted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all parts in order and which are the first of their kind; the list of parts is emptied."""
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys, first


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    keys, first = _sorted(parts)
    return keys[first]


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts in order and how often each is there."""
    keys, first = _sorted(parts)
    at = np.flatnonzero(first)
    return keys[at], np.diff(at, append=len(keys)).astype(np.uint32)


def _union(sources: Iterator[np.ndarray]) -> np.ndarray:
    """Distinct keys of all sources in order; beside them SORT_KEYS keys, or half as many as the distinct ones, are held."""
    # what is merged stands in no other list, so that it goes when it is merged
    parts, fresh, known = [], [], [np.zeros(0, np.uint64)]
    for keys in sources:
        parts.append(keys)
        if sum(map(len, parts)) > SORT_KEYS:
            fresh.append(_distinct(parts))
            if sum(map(len, fresh)) > max(SORT_KEYS, len(known[0]) // 2):
                known += fresh
                fresh.clear()
                known.append(_distinct(known))
    keys = None
    known += fresh + parts
    del fresh, parts
    return _distinct(known)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text's end token after them, and the offsets of the texts."""
    words, at = word_hashes(data, offsets, SPACED)
    return np.insert(words, at[1:], END_TOKEN), at + np.arange(len(at))


def _strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all bytes and closing bytes and the offsets of the texts."""
    return grams(data, offsets), offsets + np.arange(len(offsets))


def _block_numbers(texts: tuple[np.ndarray, ...], keys_of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block in order, and how often each is met in training texts."""
    data, offsets, trains = texts
    counted, parts = [], []

    def sources() -> Iterator[np.ndarray]:
        for row, piece, at in _pieces(data, offsets):
            keys, starts = keys_of(piece, at)
            learned = np.repeat(trains[row : row + len(at) - 1], np.diff(starts))
            yield keys[~learned]
            parts.append(keys[learned])
            if sum(map(len, parts)) > SORT_KEYS:
                counted.append(_counted(parts))
                yield counted[-1][0]
        if parts:
            counted.append(_counted(parts))
            yield counted[-1][0]

    keys = _union(sources())
    n = np.zeros(len(keys), np.uint32)
    for k, times in counted:
        n[np.searchsorted(keys, k)] += times
    return keys, n


def _split(keys: np.ndarray, buckets: int, context: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by bucket and key, the buckets met and where they begin."""
    # numpy sorts short integers by their digits
    bucket = np.empty(len(keys), np.uint16 if buckets <= 1 << 16 else np.int64)
    for at in range(0, len(keys), CHUNK):
        part = keys[at : at + CHUNK]
        bucket[at : at + CHUNK] = mix(part >> np.uint64(8 * (DEPTH + 1 - SPLIT)) if context else part) % np.uint64(buckets)
    n = np.bincount(bucket, minlength=buckets)
    met = np.flatnonzero(n)
    return np.argsort(bucket, kind="stable"), met, np.append(0, np.cumsum(n[met]))


def _block_counts(table: pa.Table, buckets: int) -> pa.Table:
    """(block, bucket, grams, gram_n, words, word_n): packed distinct strings and words of a block and their numbers in training texts."""
    rows: dict[int, dict] = {}
    texts = _texts(table)
    for kind, keys_of in (("gram", _strings), ("word", _words)):
        keys, n = _block_numbers(texts, keys_of)
        order, met, first = _split(keys, buckets, kind == "gram")
        for bucket, a, b in zip(met, first, first[1:]):
            row = rows.setdefault(int(bucket), {"block": table.column("block")[0].as_py(), "bucket": int(bucket)})
            row[kind + "s"], row[kind + "_n"] = _packed(keys[order[a:b]]), _packed(n[order[a:b]])
    return pa.Table.from_pylist(list(rows.values()), _COUNTS)


_COUNTS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("gram_n", pa.binary()), ("words", pa.binary()), ("word_n", pa.binary())])
_NODES = pa.schema([("bucket", pa.int32()), ("context", pa.int64()), ("prefix", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("weighted", pa.float64())])
_ANSWERS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())])


def _sums(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket and their numbers over all blocks."""
    lists, numbers = table.column(kind + "s"), table.column(kind + "_n")
    keys = _union(_unpacked(k.as_buffer(), np.uint64) for k in lists if k.is_valid)
    n = np.zeros(len(keys), np.int64)
    for k, times in zip(lists, numbers):
        if k.is_valid:
            n[np.searchsorted(keys, _unpacked(k.as_buffer(), np.uint64))] += _unpacked(times.as_buffer(), np.uint32)
    return keys, n


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    y, steps = x + 6, x.copy()
    for i in range(1, 6):
        steps *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


#: Log gamma of 0, 1, 2... and one half, and of 1, 2, 3...: most counts are small.
_HALVES, _WHOLES = _ln_gamma(np.arange(4096) + 0.5), _ln_gamma(np.arange(4096) + 1.0)


def _log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    a, b = n0.astype(np.int64), n1.astype(np.int64)
    large = np.flatnonzero(a + b >= len(_WHOLES))
    x, y = n0[large], n1[large]
    a[large] = b[large] = 0
    found = _HALVES[a] + _HALVES[b] - _WHOLES[a + b] - math.log(math.pi)
    found[a + b == 0] = 0.0
    found[large] = _ln_gamma(x + 0.5) + _ln_gamma(y + 0.5) - _ln_gamma(x + y + 1.0) - math.log(math.pi)
    return found


class Subtrees:
    """All nodes of SPLIT to DEPTH bytes above the strings of a bucket.

    An entry of a level is a context of its length with the byte that follows; entries are in order, so a node, which is
    a context with the first bits of that byte, is a run of them.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.level = np.full(len(keys), SPLIT, np.int8)
        self.entries, self.n, self.at, self.up = [], [], [], []
        left = np.arange(len(keys))
        for depth in range(SPLIT, DEPTH + 1):
            context = keys[left] >> np.uint64(8 * (DEPTH + 1 - depth))
            if depth > SPLIT:
                # the strings of a context are a run, as its bytes are the highest of a key
                edge = np.concatenate(([True], context[1:] != context[:-1])) if len(left) else np.zeros(0, bool)
                runs = np.cumsum(edge) - 1
                met = np.bincount(runs, weights=n[left])[runs] >= LEAST if len(left) else edge
                left, context = left[met], context[met]
                self.level[left] = depth
            entries, inverse = np.unique((context << _BYTE) | (keys[left] & np.uint64(255)), return_inverse=True)
            at = np.full(len(keys), -1, np.int32)
            at[left] = inverse
            first = np.zeros(len(entries), np.int64)
            first[inverse] = left
            self.entries.append(entries)
            self.n.append(np.bincount(inverse, weights=n[left], minlength=len(entries)))
            self.up.append(self.at[-1][first] if self.at else first)
            self.at.append(at)
        self.rest = [own - np.bincount(up, weights=below, minlength=len(own))
                     for own, up, below in zip(self.n, self.up[1:], self.n[1:])] + [np.zeros(len(self.n[-1]))]

    def nodes(self, bit: int) -> list[tuple[np.ndarray, ...]]:
        """For each level: first entries of its nodes, node of each entry, n0, n1, log block, log weighted, chance of a one at the node and at its rest."""
        out: list[tuple[np.ndarray, ...]] = []
        below = None
        for i in range(DEPTH - SPLIT, -1, -1):
            entries = self.entries[i]
            if not len(entries):
                out.insert(0, ())
                continue
            head = entries >> np.uint64(8 - bit)
            edge = np.concatenate(([True], head[1:] != head[:-1]))
            first, node = np.flatnonzero(edge), np.cumsum(edge) - 1
            one = ((entries >> np.uint64(7 - bit)) & np.uint64(1)).astype(float)
            n, rest = self.n[i], self.rest[i]
            n1, r1 = np.add.reduceat(n * one, first), np.add.reduceat(rest * one, first)
            n0, r0 = np.add.reduceat(n, first) - n1, np.add.reduceat(rest, first) - r1
            own = _log_block(n0, n1)
            weighted = own
            if i < DEPTH - SPLIT:
                apart = _log_block(r0, r1)
                if below is not None:
                    apart = apart + np.bincount(node[self.up[i + 1][below[0]]], weights=below[1], minlength=len(first))
                weighted = np.logaddexp(own, apart) - math.log(2)
            below = first, weighted
            out.insert(0, (first, node, n0, n1, own, weighted, (n1 + 0.5) / (n0 + n1 + 1), (r1 + 0.5) / (r0 + r1 + 1)))
        return out

    def values(self, above: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log2 of each string's last byte's probability; above: by bit the chance so far and the weight left at each node of SPLIT bytes."""
        logs = [np.zeros(len(e)) for e in self.entries]
        for bit in range(8):
            chance = left = None
            for i, level in enumerate(self.nodes(bit)):
                if not level:
                    break
                _, node, _, _, own, weighted, kt, rest = level
                if i:
                    chance, left = chance[self.up[i]], left[self.up[i]]
                else:
                    chance, left = above[bit][0][node], above[bit][1][node]
                stop = np.exp(own - weighted - math.log(2))[node] if i < DEPTH - SPLIT else 1.0
                chance, left = chance + left * stop * kt[node], left * (1 - stop)
                one = (self.entries[i] >> np.uint64(7 - bit)) & np.uint64(1) == 1
                p = chance + left * rest[node]
                logs[i] += np.log2(np.where(one, p, 1 - p))
        out = np.zeros(len(self.level))
        for i, at in enumerate(self.at):
            here = self.level == i + SPLIT
            out[here] = logs[i][at[here]]
        return out


def _trees(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, Subtrees]]:
    """Subtrees of runs of about TREE_KEYS strings that end where a context of SPLIT bytes does: first string, end, subtrees."""
    at = 0
    while at < len(keys):
        last = keys[min(at + TREE_KEYS, len(keys)) - 1] | np.uint64((1 << 8 * (DEPTH + 1 - SPLIT)) - 1)
        end = int(np.searchsorted(keys, last, "right"))
        yield at, end, Subtrees(keys[at:end], n[at:end])
        at = end


def _bucket_nodes(table: pa.Table) -> pa.Table:
    """The nodes of SPLIT bytes of a bucket; under context -1 the number of its words in training texts and of distinct ones."""
    bucket = table.column("bucket")[0].as_py()
    _, n = _sums(table, "word")
    columns = [[np.array([v]) for v in (-1, 0, n.sum(), (n > 0).sum(), 0.0)]]
    for _, _, tree in _trees(*_sums(table, "gram")):
        for bit in range(8):
            first, _, n0, n1, _, weighted, *_ = tree.nodes(bit)[0]
            head = tree.entries[0][first]
            columns.append([head >> _BYTE, (1 << bit) | (head & np.uint64(255)).astype(int) >> (8 - bit), n0, n1, weighted])
    context, prefix, n0, n1, weighted = (np.concatenate(c) for c in zip(*columns))
    return pa.table([np.full(len(context), bucket, np.int32), context.astype(np.int64), prefix.astype(np.int32), n0.astype(np.int64),
                     n1.astype(np.int64), weighted.astype(float)], schema=_NODES)


def _bucket_answers(table: pa.Table, top: pa.Table) -> pa.Table:
    """For each block the values of its strings of a bucket and the numbers of its words, in its order."""
    words, counts = _sums(table, "word")
    keys, n = _sums(table, "gram")
    values = np.zeros(len(keys), np.float32)
    prefix = top.column("prefix").to_numpy()
    context, p, left = (top.column(c).to_numpy() for c in ("context", "p", "rest"))
    above = {}
    for bit in range(8):
        here = np.flatnonzero(prefix >> bit == 1)
        here = here[np.lexsort((prefix[here], context[here]))]
        above[bit] = context[here], p[here], left[here]
    for a, b, tree in _trees(keys, n):
        ends = (keys[[a, b - 1]] >> np.uint64(8 * (DEPTH + 1 - SPLIT))).astype(np.int64)
        own = {}
        for bit, (c, *found) in above.items():
            i, j = np.searchsorted(c, ends[0]), np.searchsorted(c, ends[1], "right")
            own[bit] = found[0][i:j], found[1][i:j]
        values[a:b] = tree.values(own)
    rows = []
    for row in table.to_pylist():
        found = {"block": row["block"], "bucket": row["bucket"]}
        if row["grams"] is not None:
            found["values"] = _packed(values[np.searchsorted(keys, _unpacked(row["grams"], np.uint64))])
        if row["words"] is not None:
            found["counts"] = _packed(counts[np.searchsorted(words, _unpacked(row["words"], np.uint64))])
        rows.append(found)
    return pa.Table.from_pylist(rows, _ANSWERS)


def _found(known: pa.Table, column: str, kind: type, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block and what the buckets answered."""
    order, met, first = _split(keys, buckets, column == "values")
    blobs = dict(zip(known.column("bucket").to_pylist(), known.column(column)))
    answers = np.empty(len(keys), kind)
    for bucket, a, b in zip(met.tolist(), first, first[1:]):
        answers[order[a:b]] = _unpacked(blobs[bucket].as_buffer(), kind)
    return keys, answers


def _lookup(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """What is known of each key; keys are searched in order."""
    order = np.argsort(keys)
    found = np.empty(len(keys), known[1].dtype)
    found[order] = known[1][np.searchsorted(known[0], keys[order])]
    return found


def _block_scores(known: pa.Table, table: pa.Table, total: int, distinct: int, buckets: int) -> pa.Table:
    """Scores of the texts of a block, from the values of its strings and words."""
    data, offsets, trains = _texts(table)
    tokens, hits, base, score = (np.zeros(len(trains)) for _ in range(4))
    strings = _found(known, "values", np.float32, _union(_strings(piece, at)[0] for _, piece, at in _pieces(data, offsets)), buckets)
    for first, piece, at in _pieces(data, offsets):
        keys, starts = _strings(piece, at)
        score[first : first + len(at) - 1] = np.add.reduceat(_lookup(strings, keys).astype(float), starts[:-1])
    del strings
    pieces = [(first, *_words(piece, at)) for first, piece, at in _pieces(data, offsets)]
    numbers = _found(known, "counts", np.int64, _union(words for _, words, _ in pieces), buckets)
    for first, words, starts in pieces:
        rows = slice(first, first + len(starts) - 1)
        count = _lookup(numbers, words)
        tokens[rows] = np.diff(starts)
        hits[rows] = np.add.reduceat((count > 0).astype(float), starts[:-1])
        base[rows] = np.add.reduceat(np.log10((count + 1) / (total + distinct + 1)), starts[:-1])
    size = np.diff(offsets)
    return pa.table({"doc_id": pc.list_flatten(table.column("ids")), "held_out": pa.array(~trains),
                     "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(hits.astype(np.int64)),
                     "train_tokens": pa.array(np.full(len(trains), total, np.int64)), "base_score": pa.array(base),
                     "score": pa.array(score * math.log10(2)), "n_bytes": pa.array(size), "bits_per_byte": pa.array(-score / (size + 1))})


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 6, stepped down; for x of at least one half."""
    y = x + 6
    steps = x
    for i in range(1, 6):
        steps = steps * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _estimates(nodes: DataFrame) -> DataFrame:
    """nodes with kt (probability of a one) and own (log of the block probability)."""
    a, b = F.col("n0"), F.col("n1")
    own = F.when(a + b == 0, 0.0).otherwise(_log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi))
    return nodes.withColumns({"kt": (b + 0.5) / (a + b + 1.0), "own": own})


def top_of_tree(nodes: DataFrame) -> DataFrame:
    """nodes (bucket, context, prefix, n0, n1, weighted) of SPLIT bytes with p, the chance of a one that shorter contexts add, and the weight left as rest."""
    levels = [nodes]
    for depth in range(SPLIT - 1, -1, -1):
        shorter = levels[0].groupBy(F.shiftright("context", 8).alias("context"), "prefix").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        shorter = _estimates(shorter)
        apart = F.abs(F.col("own") - F.col("below"))
        shorter = shorter.withColumn("weighted", F.greatest("own", "below") + F.log1p(F.exp(-apart)) - math.log(2)).drop("below")
        levels.insert(0, written(shorter.withColumn("stop", F.exp(F.col("own") - F.col("weighted") - math.log(2)))))
    mixed = levels[0].select("context", "prefix", (F.col("stop") * F.col("kt")).alias("p"), (1 - F.col("stop")).alias("rest"))
    for level in levels[1:]:
        above = mixed.withColumnsRenamed({"context": "above", "p": "p_above", "rest": "rest_above"})
        joined = level.withColumn("above", F.shiftright("context", 8)).join(above, ["above", "prefix"])
        mixed = joined.select("context", "prefix", (F.col("p_above") + F.col("rest_above") * F.col("stop") * F.col("kt")).alias("p"),
                              (F.col("rest_above") * (1 - F.col("stop"))).alias("rest")) if level is not nodes else joined
    return mixed.select("bucket", "context", "prefix", F.col("p_above").alias("p"), F.col("rest_above").alias("rest"))


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Scores of all documents; those that held_out marks are not learned from."""
    body = F.coalesce(docs[text], F.lit(""))
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    buckets = max(count, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(docs[doc_id].alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("trains"), body.alias("text"))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int"))
    kind = base.schema["doc_id"].dataType.simpleString()
    base = base.mapInArrow(_packed_texts, f"block int, ids array<{kind}>, trains array<boolean>, sizes array<long>, texts binary")
    base = base.repartition(buckets, "block")

    def counts_of(table: pa.Table) -> pa.Table:
        return _block_counts(table, buckets)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_scores(left, right, total, distinct, buckets)

    sent = base.groupBy("block").applyInArrow(counts_of, "block int, bucket int, grams binary, gram_n binary, words binary, word_n binary")
    dealt = written_in_buckets(sent, "bucket", buckets)
    nodes = written(dealt.groupBy("bucket").applyInArrow(
        _bucket_nodes, "bucket int, context long, prefix int, n0 long, n1 long, weighted double"))
    total, distinct = nodes.filter("context < 0").agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    top = top_of_tree(nodes.filter("context >= 0"))
    known = dealt.groupBy("bucket").cogroup(top.groupBy("bucket")).applyInArrow(
        _bucket_answers, "block int, bucket int, values binary, counts binary")
    return known.groupBy("block").cogroup(base.groupBy("block")).applyInArrow(
        scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
                "n_bytes long, bits_per_byte double")
