"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

An example is a row of ids with, for instruction data, a mask of the ids that bear loss. A sequence takes pieces while three
limits hold at once. The next piece is the example that fits whole and whose demand has the largest dot product with the
room left, each dimension in shares of its limit and weighted by how much of it the examples left want (the dot-product heuristic);
examples of equal demand are one entry, so a step looks at the distinct demands only. With `cut`, what no whole
example fills is filled with the head of the longest one, and a sequence that still cannot be filled is cut back to the
largest power of two in it, so nothing is padded; without it, examples stay whole and sequences end with a gap.

Examples are written once as ids, then dealt into blocks by a hash of their id and a stored random number, so that rows of
one id or of equal texts, however many, spread over all blocks. A block has BLOCK_TOKENS ids at most on average, less while there
are few for the session's tasks, and is packed in one task; sequences never span blocks, ids are exchanged once.

Tokenizing: the vocabulary's ranks with a fixed splitting pattern; every id is that of the `tokenizers` library
(tests compare all code points), at four times its speed. The vocabulary is read on the driver and sent to the tasks.

Defined cases: a null text is empty and has its end id alone; a null id is kept; equal rows are separate examples; an
example over a limit is cut at it even without `cut`, its last part is packed like a short one; texts of any length are encoded whole; an
empty table gives an empty result; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pamspark.llm.common import blocks as text_blocks, shared_folder

TOKENS, SEGMENTS = 2048, 128
END_ID = 1
BLOCK_TOKENS, LEAST_BLOCK = 2_000_000, 100 * TOKENS
SEED = 12
#: Fixed value: how the vocabulary's tokenizer splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(path: str) -> dict[bytes, int]:
    """Tokens as bytes with their ids, from a tokenizer's JSON file of byte-level BPE; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def tokenized(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of all rows: ids of the whole text and the end id, as little-endian unsigned 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        end = np.uint32([end_id]).tobytes()
        for batch in text_blocks(batches):
            ids = [encoding.encode_to_numpy(t or "", disallowed_special=()).astype("<u4").tobytes() + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    table = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return table.mapInArrow(encoded, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, ids binary")


class _Pool:
    """Parts of examples by demand: (tokens, loss-bearing tokens) with the parts (begin, end) of each."""

    def __init__(self) -> None:
        self.tokens, self.loss, self.count = (np.zeros(1024, np.int64) for _ in range(3))
        self.parts: list[list[tuple[int, int]]] = []
        self.kind: dict[tuple[int, int], int] = {}
        self.left = np.zeros(3)  # tokens, loss-bearing tokens and parts

    def add(self, begin: int, end: int, loss: int) -> None:
        k = self.kind.setdefault((end - begin, loss), len(self.parts))
        if k == len(self.parts):
            if k == len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate((x, np.zeros(k, np.int64))) for x in (self.tokens, self.loss, self.count))
            self.tokens[k], self.loss[k] = end - begin, loss
            self.parts.append([])
        self.parts[k].append((begin, end))
        self.count[k] += 1
        self.left += (end - begin, loss, 1)

    def pop(self, k: int) -> tuple[int, int]:
        self.count[k] -= 1
        self.left -= (self.tokens[k], self.loss[k], 1)
        return self.parts[k].pop()


def sequences(edges: np.ndarray, loss: np.ndarray, most: tuple[int, int, int], cut: bool) -> Iterator[list[tuple[int, int]]]:
    """Sequences as lists of parts (begin, end) of the concatenated ids.

    edges: where examples begin and the last one ends; loss: running number of loss-bearing ids, from 0 on; most: limits
    on tokens, segments and loss-bearing tokens.
    """
    tokens, segments, bearing = most
    pool = _Pool()

    def head(begin: int, end: int, room: int, loss_room: int) -> int:
        """Where the longest piece from begin on ends that fits."""
        stop = min(end, begin + room)
        return begin + int(np.searchsorted(loss[begin + 1 : stop + 1] - loss[begin], loss_room, "right"))

    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        while end - begin > tokens or loss[end] - loss[begin] > bearing:
            stop = head(begin, end, tokens, bearing)
            if stop - begin < tokens and cut:
                break
            yield [(begin, stop)]
            begin = stop
        pool.add(begin, end, int(loss[end] - loss[begin]))
    limits = np.array([tokens, bearing, segments], float)
    while pool.left[2]:
        out, room, places, loss_room = [], tokens, segments, bearing
        weight = pool.left / limits**3
        while room and places and pool.left[2]:
            n = len(pool.parts)
            size, bears, count = pool.tokens[:n], pool.loss[:n], pool.count[:n]
            fits = (count > 0) & (size <= room) & (bears <= loss_room)
            dot = weight[0] * room * size + weight[1] * loss_room * bears + weight[2] * places
            k = int(np.argmax(np.where(fits, dot, -1.0)))
            longest = int(np.argmax(np.where(count > 0, size, -1)))
            if fits[k] and not (cut and places == 1 and size[k] < room < size[longest]):
                begin, end = pool.pop(k)
            elif cut:
                begin, whole = pool.pop(longest)
                end = head(begin, whole, room, loss_room)
                if end < whole:
                    pool.add(end, whole, int(loss[whole] - loss[end]))
                if end == begin:
                    break
            else:
                break
            out.append((begin, end))
            room, places, loss_room = room - (end - begin), places - 1, loss_room - int(loss[end] - loss[begin])
        if cut and room:
            excess = tokens - room
            excess -= 1 << (excess.bit_length() - 1)
            while excess:
                begin, end = out.pop()
                keep = max(begin, end - excess)
                excess -= end - keep
                pool.add(keep, end, int(loss[end] - loss[keep]))
                if keep > begin:
                    out.append((begin, keep))
        yield out


def _packed(table: pa.Table, most: tuple[int, int, int], cut: bool) -> pa.Table:
    """The pieces of one block."""
    size = np.array([len(b) // 4 for b in table.column("ids").to_pylist()], np.int64)
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4")
    edges = np.concatenate(([0], np.cumsum(size)))
    if "loss" in table.column_names:
        bears = np.frombuffer(b"".join(table.column("loss").to_pylist()), np.uint8) != 0
    else:
        bears = np.ones(len(ids), bool)
        bears[edges[:-1][size > 0]] = False
    loss = np.concatenate(([0], np.cumsum(bears)))
    rows = []
    for number, parts in enumerate(sequences(edges, loss, most, cut)):
        at = 0
        for begin, end in parts:
            rows.append((begin, end, number, at))
            at += end - begin
    begin, end, number, at = np.array(rows, np.int64).reshape(-1, 4).T
    doc = np.searchsorted(edges, begin, "right") - 1
    block = table.column("block")[0].as_py()
    return pa.table({
        "doc_id": table.column("doc_id").take(pa.array(doc)), "start": pa.array(begin - edges[doc]), "length": pa.array(end - begin),
        "ids": pa.array([ids[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()), "loss": pa.array(loss[end] - loss[begin]),
        "doc_tokens": pa.array(size[doc]), "sequence_id": pa.array((block << 32) + number), "offset": pa.array(at)})


def pack(examples: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None, cut: bool = True) -> DataFrame:
    """All examples (doc_id, ids and, if there is one, loss: a byte for each id) in sequences, a row for each piece.

    Without a mask every id but an example's first bears loss. A piece has its ids, where it starts in its example (start) and
    in its sequence (offset), and the number of loss-bearing ids (loss).
    """
    columns = [c for c in ("doc_id", "ids", "loss") if c in examples.columns]
    rows = examples.select(*columns, (F.octet_length("ids") / 4).cast("long").alias("n"), F.floor(F.rand(SEED) * (1 << 30)).alias("salt"))
    folder = shared_folder(examples.sparkSession)
    rows.write.option("compression", "zstd").parquet(folder)  # half the bytes of an id are zero
    rows = examples.sparkSession.read.schema(rows.schema).parquet(folder)
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = 4 * int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, -(-total // min(BLOCK_TOKENS, max(LEAST_BLOCK, total // tasks))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(count)))
    most = (tokens, segments, loss_tokens or tokens)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("block", *columns).groupBy("block").applyInArrow(
        lambda table: _packed(table, most, cut),
        f"doc_id {kind}, start long, length long, ids binary, loss long, doc_tokens long, sequence_id long, offset long")
