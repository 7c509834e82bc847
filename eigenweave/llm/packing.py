"""Vector bin packing of examples into training sequences by the dot-product heuristic.

An example demands tokens, one segment and loss-bearing tokens; a sequence has a limit on each.
One sequence is filled at a time: of the examples that fit, the one with the largest dot product of
its demand and the sequence's room, both as shares of the limits and weighted by the total demand
of each kind, goes in. Work is local to a partition, with a bounded pool of waiting examples, so
nothing is shuffled and memory does not grow with the input.

Where examples may be cut, one that is longer than a sequence first gives whole sequences, which go
out as they are cut; only its tail, shorter than a sequence, waits. When nothing fits into the room
that is left, the waiting example with the largest product is cut to fill it. A sequence that ends
short of the limit on tokens (the last of a partition, or one that another limit ends) is dealt out
over powers of two, so that it needs no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_input

#: Waiting examples of a partition at which sequences are filled, and down to which.
POOL = 2048
#: Bytes of ids in one Arrow batch, and rows of a batch without ids.
OUT_BYTES, OUT_ROWS = 4 << 20, 10_000


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


class Packer:
    """Fills sequences from a pool of (key, start, tokens, loss). placed: (sequence, offset, key, start, tokens).

    keep(key, start) is what waits in place of a key whose ids before start are placed.
    """

    def __init__(self, limits: Limits, cut: bool, first: int = 0, pool: int = POOL, keep: Callable[[object, int], object] = lambda key, start: key):
        self.limits, self.cut, self.next, self.pool, self.keep = limits, cut, first, pool, keep
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.keys: list[object] = []
        self.starts: list[int] = []
        self.need = np.zeros((2 * pool, 3))
        self.total = np.zeros(3)
        self.placed: list[tuple[int, int, object, int, int]] = []

    def add(self, key: object, tokens: int, loss: int) -> None:
        start, whole = 0, min(self.limits.tokens, self.limits.loss)
        if self.cut and loss != tokens:
            raise ValueError("only examples whose tokens all bear loss can be cut")
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, fits no sequence")
        while self.cut and tokens - start >= whole:
            self.placed.append((self._open(), 0, key, start, whole))
            start += whole
        if tokens > start or tokens == 0:
            self._wait(self.keep(key, start), start, tokens - start, loss - start if self.cut else loss)
        if len(self.keys) >= 2 * self.pool - 1:
            self._fill(self.pool)

    def finish(self) -> None:
        self._fill(0)

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def _wait(self, key: object, start: int, tokens: int, loss: int) -> None:
        k = len(self.keys)
        self.need[k] = tokens, 1, loss
        self.total += self.need[k]
        self.keys.append(key)
        self.starts.append(start)

    def _drop(self, k: int) -> tuple[object, int, int]:
        key, start, tokens, last = self.keys[k], self.starts[k], int(self.need[k, 0]), len(self.keys) - 1
        self.keys[k], self.starts[k], self.need[k] = self.keys[last], self.starts[last], self.need[last]
        self.keys.pop()
        self.starts.pop()
        return key, start, tokens

    def _fill(self, down_to: int) -> None:
        while len(self.keys) > down_to:
            room, inside = self.cap.copy(), []
            while self.keys and room[1] >= 1:
                need = self.need[: len(self.keys)]
                score = need @ (self.total * room / (self.cap * self.cap))
                fits = (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
                k = int(np.argmax(np.where(fits, score, -1.0)))
                if fits[k]:
                    room -= need[k]
                    inside.append(self._drop(k))
                    continue
                part = int(min(room[0], room[2]))
                if not self.cut or part < 1:
                    break
                k = int(np.argmax(score))
                key, start = self.keys[k], self.starts[k]
                inside.append((key, start, part))
                self.starts[k] += part
                self.need[k, [0, 2]] -= part
                room -= part, 1, part
            self._close(inside)

    def _close(self, inside: list[tuple[object, int, int]]) -> None:
        filled = sum(n for _, _, n in inside)
        sizes = [self.limits.tokens]
        if self.cut and filled < self.limits.tokens:
            sizes = [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1] or sizes
        at, left, seq = 0, sizes.pop(0), self._open()
        for key, start, n in inside:
            while n > left and sizes:
                if left:
                    self.placed.append((seq, at, key, start, left))
                start, n = start + left, n - left
                at, left, seq = 0, sizes.pop(0), self._open()
            self.placed.append((seq, at, key, start, n))
            at, left = at + n, left - n


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits(), over: str = "error") -> DataFrame:
    """Place whole examples: (id, sequence_id long, offset long, length long) for each row.

    Null counts are 0 tokens; an example without tokens takes a segment. An example over a limit is
    an error, or with over="apart" comes back with a null sequence_id and offset, for the caller to
    cut. Ids may be null or repeat: each row is an example. Other columns are left aside, whatever
    their names. An empty table gives an empty table. sequence_id holds the partition in its upper bits.
    """
    check_input(examples, id_col, tokens_col, loss_col)
    if over not in ("error", "apart"):
        raise ValueError("over must be error or apart")
    rows = examples.select(F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("t"), F.coalesce(F.col(loss_col), F.lit(0)).cast("long").alias("l"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "length"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, False, TaskContext.get().partitionId() << 40)

        def out() -> pa.RecordBatch:
            seq, at, keys, _, n = zip(*packer.placed)
            packer.placed.clear()
            return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], type_), *(pa.array(x, pa.int64()) for x in (seq, at, n))], schema.names)

        type_ = None
        for b in batches:
            type_ = b.column(0).type
            for key, t, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if over == "apart" and (t > limits.tokens or n > limits.loss):
                    packer.placed.append((None, None, key, 0, t))
                else:
                    packer.add(key, t, n)
            if packer.placed:
                yield out()
        packer.finish()
        if packer.placed:
            yield out()

    return rows.mapInArrow(run, schema)


def conversation_tokens(turns: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, tokens long, loss long) for each conversation of turns: ids of all its turns, each with end_id, and those that bear loss.

    Turns are counted where they lie and summed before the shuffle, so a very long conversation is
    never gathered. Null and empty texts are their end id; a null role bears no loss; turns without
    a conversation's id make one conversation of id null. Repeated rows count as often as they come.
    """
    check_input(turns, id_col, role_col, text_col)
    rows = turns.select(F.col(id_col).alias("id"), F.coalesce(F.col(role_col).isin(*loss_roles), F.lit(False)).alias("bears"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("id", "bears").schema.add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(tokenizer).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) + 1 for x in encode(b.column(2))], pa.int64())], schema.names)

    total = rows.mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss"))
    return total.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise texts, append end_id to each and pack the ids, cutting freely.

    Returns a row for each piece: id, start long (ids of its document before it), length long, ids
    binary (little-endian 32-bit), doc_tokens long, sequence_id long, offset long (in its sequence,
    without gaps from 0). Every id lies in exactly one piece. A null or empty text is its end id.
    Ids of documents may be null or repeat: each row is a document. Other columns are left aside,
    whatever their names. An empty table gives an empty table. tokenizer: path of a tokenizers JSON
    file. A worker holds the ids of one slice of an Arrow batch, at most OUT_BYTES of pieces on
    their way out, and 2 * POOL waiting tails, each shorter than a sequence.
    """
    check_input(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in longs), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        part_id = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield from pieces_of(batches, encoder(tokenizer).encode, end_id, limits, part_id << 40, schema.names)

    return rows.mapInArrow(run, schema)


def pieces_of(batches: Iterator[pa.RecordBatch], encode: Callable[[pa.StringArray], list[np.ndarray]], end_id: int, limits: Limits, first: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """One task's work: batches of (id, text) become batches of pieces. A key is (id, ids of the document, first id held, ids)."""
    tail = lambda key, start: (key[0], key[1], start, key[3][start - key[2] :].copy())
    packer, type_ = Packer(limits, True, first, keep=tail), pa.null()

    def out(rest: bool) -> Iterator[pa.RecordBatch]:
        placed, packer.placed = packer.placed, []
        at = 0
        while at < len(placed):
            size = n = 0
            for n, x in enumerate(placed[at : at + OUT_ROWS], 1):
                size += 4 * x[4]
                if size >= OUT_BYTES:
                    break
            if size < OUT_BYTES and at + n == len(placed) and n < OUT_ROWS and not rest:
                packer.placed = placed[at:]
                return
            seq, place, keys, start, length = zip(*placed[at : at + n])
            ids = [k[3][s - k[2] : s - k[2] + m].tobytes() for k, s, m in zip(keys, start, length)]
            cols = [start, length, [k[1] for k in keys], seq, place]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], type_), *(pa.array(c, pa.int64()) for c in cols), pa.array(ids, pa.binary())], names)
            at += n

    end = np.array([end_id], "<u4")
    for b in batches:
        type_ = b.column(0).type
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                n = len(ids) + 1
                packer.add((key, n, 0, np.concatenate((ids, end))), n, n)
            yield from out(False)  # here, as pieces of whole sequences are views of their document's ids
    packer.finish()
    yield from out(True)
