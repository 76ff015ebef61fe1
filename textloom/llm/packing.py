"""Cost-balanced packing of documents into training sequences.

The cost of a sequence is estimated as LINEAR * tokens + QUADRATIC * tokens squared of each piece (attention stays
inside a document). Ids are those of the vocabulary file's tokenizer, special strings in a text included. Whole multiples of the sequence length fill sequences of their own; what remains of each document
is assigned, longest first, to the sequence of lowest cost that has room. A remainder that no sequence has room for is
cut over the sequences with most room. Windows of WINDOW tokens are packed where they are read, so nothing is
shuffled, and the one sequence a window leaves unfilled goes on into the next: a partition pads one sequence.

Defined results: a null text counts as empty and is packed as its end token; repeated rows are packed each; ties go to
the earlier sequence and the earlier row; a text of any length is emitted piece by piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import emitted, rows, table, texts
from textloom.llm.tokens import encoder

LENGTH, END = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
WINDOW = 2 << 20
#: Sequence ids of a partition start at its number times this.
SPACE = 1 << 36


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(sizes: list[int], open_room: int, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces (item, start, size, sequence) for items below a sequence's length, and the room left in the last sequence.

    open_room: what the sequence numbered 0 still holds, 0 for none. The fewest sequences that hold all items are
    opened; all but the last are filled.
    """
    total = sum(sizes)
    opened = -(-max(0, total - open_room) // length)
    room = [open_room, *[length] * opened]
    spare = open_room + opened * length - total
    if opened:
        room[-1] -= spare  # the last sequence ends early, so that all others are filled
    elif open_room:
        room[0] -= spare
    heap = [(0.0, s) for s in range(len(room)) if room[s]]
    pieces = []

    def put(item: int, start: int, n: int, paid: float, s: int) -> None:
        pieces.append((item, start, n, s))
        room[s] -= n
        if room[s]:
            heapq.heappush(heap, (paid + cost(n), s))

    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, aside, start = sizes[item], [], 0
        while heap and room[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
        if heap:
            paid, s = heapq.heappop(heap)
            put(item, 0, n, paid, s)
        else:  # cut, over the sequences with most room
            aside.sort(key=lambda x: (-room[x[1]], x))
            while start < n:
                paid, s = aside.pop(0)
                take = min(room[s], n - start)
                put(item, start, take, paid, s)
                start += take
        for x in aside:
            heapq.heappush(heap, x)
    return pieces, spare


class Packer:
    """Packs ids in the order they come; rows() gives what is decided since the last call."""

    def __init__(self, first_sequence: int, length: int = LENGTH, window: int = WINDOW):
        self.length, self.window, self.next = length, window, first_sequence
        self.items: list[tuple] = []
        self.held = 0
        self.open = (0, 0)  # the unfilled sequence and its room

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        whole = n - n % self.length
        for at in range(0, whole, self.length):
            yield self.row(doc_id, ids, at, self.length, self.next, 0)
            self.next += 1
        if n > whole:
            self.items.append((doc_id, ids[whole:], whole, n))
            self.held += n - whole
        if self.held >= self.window:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        items, (opened, room) = self.items, self.open
        pieces, spare = assign([len(x[1]) for x in items], room, self.length)
        used = {0: self.length - room}
        count = max((p[3] for p in pieces), default=0)
        for item, start, n, s in pieces:
            doc_id, ids, before, total = items[item]
            at = used.get(s, 0)
            used[s] = at + n
            yield self.row(doc_id, ids, start, n, opened if s == 0 else self.next + s - 1, at, before, total)
        if spare and count:
            self.open = (self.next + count - 1, spare)
        else:
            self.open = (opened, spare)
        self.next += count
        self.items, self.held = [], 0

    @staticmethod
    def row(doc_id, ids, start, n, sequence, at, before=0, total=None) -> tuple:
        return doc_id, before + start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), total or len(ids), sequence, at


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row for each piece; offsets within a sequence have no gaps from 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() * SPACE, length)

        def found() -> Iterator[tuple]:
            encode = encoder(path)
            for b in batches:
                for doc_id, text in rows(b, doc_id=pa.int64(), text=pa.string()):
                    yield from packer.add(doc_id, np.append(encode(text), np.uint32(END)))
            yield from packer.flush()

        return emitted(SCHEMA, found())

    return texts(docs).mapInArrow(each, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
