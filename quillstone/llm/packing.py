"""Packing by minimum bin slack.

Texts become token ids followed by an end id. Whole windows are cut from long
texts; the rests are packed per batch of pieces: a subset-sum dynamic program
over bitsets finds the multiset of remaining lengths that fills a window closest
to its capacity, and backtracking tells how many pieces of each length to take.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Out, modest_batches


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` as far as any multiset within ``counts`` does.

    Bit s of a set tells whether some multiset has the sum s. A count is taken
    apart into powers of two, so that each length costs a few shifts; the sets
    before each step are kept for the way back.
    """
    mask = (1 << capacity + 1) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(part, left)
            steps.append((length, n, reach))
            reach |= reach << length * n & mask
            left, part = left - n, 2 * part
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= length * n
            taken[length] += n
    return dict(taken)


class Bins:
    """Pieces that wait for a window, by length; gives windows as lists of pieces."""

    def __init__(self, capacity: int, pool: int = 256):
        self.capacity, self.pool = capacity, pool
        self.waiting: dict[int, list] = defaultdict(list)
        self.count = 0

    def add(self, piece: tuple, length: int) -> None:
        self.waiting[length].append(piece)
        self.count += 1

    def window(self) -> list[tuple]:
        taken = best_fill({k: len(v) for k, v in self.waiting.items()}, self.capacity)
        pieces = []
        for length, n in taken.items():
            have = self.waiting[length]
            for _ in range(n):
                pieces.append(have.pop())
            if not have:
                del self.waiting[length]
        self.count -= len(pieces)
        return pieces

    def full(self) -> Iterator[list[tuple]]:
        """Windows while more than half of the pool waits, so that the program always has lengths to choose from."""
        while self.count > self.pool // 2 and sum(k * len(v) for k, v in self.waiting.items()) > 2 * self.capacity:
            yield self.window()

    def rest(self) -> Iterator[list[tuple]]:
        while self.count:
            yield self.window()


def pack(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096, end_id: int = 2, pool: int = 256, with_ids: bool = False) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids.

    Each partition packs its own rows. A window that the best multiset does not
    fill is topped up with the head of a waiting piece, which is cut; the ids
    that a partition has left at its end go to one window or to windows of powers
    of two, which need no padding. Null and empty texts are the end id alone;
    texts of any length are cut; repeated rows are packed each; of pieces of one
    length the last to wait goes first; further columns are ignored; an empty
    table gives no pieces.
    """
    modest_batches(docs.sparkSession)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillstone.llm.tokens import WordTokens

        encode = WordTokens(tokenizer_file).encode
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        bins, out = Bins(capacity, pool), None

        def emit(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            offset = 0
            for i, start, ids, tokens in pieces:
                extra = (ids.tolist(),) if with_ids else ()
                yield from out.add(i, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset, *extra)
                offset += len(ids)
            sequence += 1

        def topped(pieces: list[tuple]) -> list[tuple]:
            """The window with the head of a waiting piece in what is left of it."""
            gap = capacity - sum(len(p[2]) for p in pieces)
            longer = [k for k in bins.waiting if k > gap]
            if gap and longer:
                i, start, ids, tokens = bins.waiting[length := min(longer)].pop()
                if not bins.waiting[length]:
                    del bins.waiting[length]
                bins.count -= 1
                pieces.append((i, start, ids[:gap], tokens))
                bins.add((i, start + gap, ids[gap:], tokens), len(ids) - gap)
            return pieces

        for batch in batches:
            if out is None:
                longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
                out = Out(pa.schema([(id_column, batch.schema.field(0).type), *((x, pa.int64()) for x in longs), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]))
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    yield from emit([(i, start, ids[start : start + capacity], len(ids))])
                if len(ids) > whole:
                    bins.add((i, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)
                if bins.count >= pool:
                    for pieces in bins.full():
                        yield from emit(topped(pieces))
        for pieces in bins.rest():
            pieces = topped(pieces)
            if sum(len(p[2]) for p in pieces) == capacity:
                yield from emit(pieces)
            else:
                for part in powers(pieces):
                    yield from emit(part)
        if out is not None:
            yield out.flush()

    return docs.select(F.col(id_column), F.col(text_column).alias("body")).mapInArrow(run, schema)


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces in windows whose lengths are the powers of two that the total consists of, largest first."""
    total = sum(len(p[2]) for p in pieces)
    todo = list(reversed(pieces))
    while total:
        size = 1 << total.bit_length() - 1
        total -= size
        part = []
        while size:
            i, start, ids, tokens = todo.pop()
            part.append((i, start, ids[:size], tokens))
            if len(ids) > size:
                todo.append((i, start + size, ids[size:], tokens))
            size -= len(part[-1][2])
        yield part
