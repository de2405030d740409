"""Pack documents into token windows by Karmarkar-Karp multiway differencing.

Full windows are cut from a document as they come; what is left is cut into short pieces and
collected until it fills a group of windows. Differencing merges partial partitions, the fullest
part of one with the emptiest of the other, until one partition with near-equal windows is left.
If its fullest window exceeds the capacity, the group is partitioned into one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrid.llm.tokens import encoded, encoder_of

# Fixed values of the contract.
CAPACITY = 2048
END = (1).to_bytes(4, "little")

WINDOWS = 64  # windows of a group
PIECE = 256  # longest piece that is balanced
FINE = 16  # longest piece once a group is nearly full; short pieces even out the last differences
SLACK = 12  # tokens left free per window, so that near-equal windows fit
SLICE_BYTES = 1 << 22  # of text that is encoded at once


def difference(sizes: list[int], parts: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``parts`` near-equal parts.

    A partial partition is a list of (sum, members) with the fullest first; parts without members
    are left out, and sums are taken relative to the emptiest part.
    """
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        shared = len(one) + len(two) - parts
        if shared <= 0:
            merged = one + two
        else:
            # the emptiest ``shared`` parts of one take up the fullest of two, and so on outwards
            keep = len(one) - shared
            merged = one[:keep] + two[shared:]
            merged += [(a[0] + b[0], (a[1], b[1])) for a, b in zip(one[keep:], reversed(two[:shared]), strict=True)]
        merged.sort(key=lambda part: -part[0])
        if len(merged) == parts and merged[-1][0]:
            least = merged[-1][0]
            merged = [(s - least, m) for s, m in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == parts else 0)
        heapq.heappush(heap, (-spread, number, merged))
        number += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                members.append(node)
        out.append(members)
    return out + [[] for _ in range(parts - len(out))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as hold all sizes without one above the capacity."""
    count = -(-sum(sizes) // capacity)
    while True:
        split = difference(sizes, count) if count else []
        if all(sum(sizes[i] for i in window) <= capacity for window in split):
            return [window for window in split if window]
        count += 1


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class _Packer:
    """Rows of one task. ``left`` holds pieces (doc_id, start, ids, doc_tokens) of the open group."""

    def __init__(self, number: int, capacity: int) -> None:
        self.next_id, self.capacity = number << 32, capacity
        self.left: list[tuple] = []
        self.held = 0
        self.goal = WINDOWS * (capacity - SLACK)
        self.coarse = self.goal - 2 * WINDOWS * FINE
        self.rows: list[tuple] = []

    def _row(self, doc: int, start: int, ids: bytes, total: int, offset: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))

    def add(self, doc: int, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self._row(doc, at, ids[4 * at : 4 * (at + self.capacity)], total, 0)
            self.next_id += 1
            at += self.capacity
        while at < total:
            most = PIECE if self.held < self.coarse else FINE
            n = min(most, total - at, self.goal - self.held)
            self.left.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.held += n
            at += n
            if self.held == self.goal:
                self.close()

    def close(self) -> None:
        for window in windows([len(p[2]) // 4 for p in self.left], self.capacity):
            offset = 0
            for i in sorted(window):
                doc, start, ids, total = self.left[i]
                self._row(doc, start, ids, total, offset)
                offset += len(ids) // 4
            self.next_id += 1
        self.left, self.held = [], 0

    def taken(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 7
        names = [c.split()[0] for c in _PIECES.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)
        self.rows = []
        return batch


def _pack(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, spaced=True)
        packer = _Packer(TaskContext.get().partitionId(), capacity)
        for doc, ids in encoded(batches, encoder, END, SLICE_BYTES):
            packer.add(doc, ids)
            if len(packer.rows) > 10_000:
                yield packer.taken()
        packer.close()
        yield packer.taken()

    return pack


def pack_windows(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of documents in windows of at most ``capacity`` tokens.

    ``tokenizer`` is the file of a byte-level BPE vocabulary. Every document, also a null or empty
    one, ends with id 1, and every id lies in exactly one piece. Returns ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``. Repeated rows are packed again each. An empty
    table gives no pieces.

    Texts are read where they lie and never shuffled; a task holds one group of windows. The
    windows of a task are numbered from its partition, so a task that runs again gives the same.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, capacity), _PIECES)
