"""Token ids in one wavelet matrix per shard.

A wavelet matrix keeps a sequence as one bit-plane per bit of its ids, most significant first.
After each plane the sequence is reordered, zeros before ones, so that rank on the planes leads
from a position to its id, and select leads from an id to its positions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashgrid.llm.tokens import encoded, encoder_of
from crashgrid.session import new_folder

SHARD_TOKENS = 1 << 20
END = (1).to_bytes(4, "little")

_MAGIC = b"WVM1"
_HEAD = "<4sIIQ"  # magic, bit-planes, documents, tokens
_BLOCK = 512


class WaveletMatrix:
    """A token sequence with access, rank and select.

    The file has a head, the documents' ids and lengths, and the bit-planes; all but the head is
    compressed. Counts of ones before each block are rebuilt on reading.
    """

    def __init__(self, planes: list[np.ndarray], size: int, doc_ids: np.ndarray, lengths: np.ndarray) -> None:
        self.planes, self.size, self.doc_ids, self.lengths = planes, size, doc_ids, lengths
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for bit in reversed(range(bits)):
            ones = (now >> bit) & 1 == 1
            planes.append(np.packbits(ones))
            now = np.concatenate([now[~ones], now[ones]])
        return cls(planes, len(ids), doc_ids, lengths)

    def to_bytes(self) -> bytes:
        body = self.doc_ids.astype("<i8").tobytes() + self.lengths.astype("<i8").tobytes()
        body += b"".join(p.tobytes() for p in self.planes)
        head = struct.pack(_HEAD, _MAGIC, len(self.planes), len(self.doc_ids), self.size)
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, docs, size = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[struct.calcsize(_HEAD) :]), np.uint8)
        doc_ids, lengths = body[: 8 * docs].view("<i8"), body[8 * docs : 16 * docs].view("<i8")
        each = -(-size // 8)
        planes = [body[16 * docs + i * each : 16 * docs + (i + 1) * each] for i in range(bits)]
        return cls(planes, size, doc_ids, lengths)

    def to_array(self) -> np.ndarray:
        """All ids: the reordering undone from the last plane to the first."""
        now = np.zeros(self.size, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.size).view(bool)
            zeros = self.size - int(np.count_nonzero(ones))
            before = np.empty_like(now)
            before[~ones] = now[:zeros]
            before[ones] = now[zeros:] | now.dtype.type(1 << bit)
            now = before
        return now

    def _rank1(self, level: int, at: int) -> int:
        """Ones of a plane before a position."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                full = np.zeros(-(-len(plane) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
                full[: len(plane)] = plane
                ones = np.bitwise_count(full.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        block, rest = divmod(at, _BLOCK)
        inside = self.planes[level][block * (_BLOCK // 8) : block * (_BLOCK // 8) + -(-rest // 8)]
        return int(self._ranks[level][block]) + int(np.unpackbits(inside, count=rest).sum()) if rest else int(self._ranks[level][block])

    def access(self, at: int) -> int:
        """The id at a position."""
        value = 0
        for level, plane in enumerate(self.planes):
            one = int(plane[at >> 3]) >> (7 - (at & 7)) & 1
            ones = self._rank1(level, at)
            at = self.size - self._rank1(level, self.size) + ones if one else at - ones
            value = value << 1 | one
        return value

    def _range(self, value: int, to: int) -> tuple[int, int]:
        """Where the last order holds the copies of an id among the first ``to`` positions."""
        if value < 0 or value >> len(self.planes):
            return 0, 0
        low, high = 0, to
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if value >> (len(self.planes) - 1 - level) & 1:
                zeros = self.size - self._rank1(level, self.size)
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, to: int) -> int:
        """Copies of an id before a position."""
        low, high = self._range(value, to)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, k: int) -> int:
        """Position of the k-th copy of an id, from 0."""
        low, high = self._range(value, self.size)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in reversed(range(len(self.planes))):
            zeros = self.size - self._rank1(level, self.size)
            one = value >> (len(self.planes) - 1 - level) & 1
            wanted = at - zeros if one else at
            a, b = 0, self.size
            while a < b:
                middle = (a + b) // 2
                ones = self._rank1(level, middle + 1)
                if (ones if one else middle + 1 - ones) > wanted:
                    b = middle
                else:
                    a = middle + 1
            at = a
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


_FILES = "part int, shard int, first_doc long, docs long, nameless long, tokens long, data binary"


def _write(path: str, shard_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, spaced=False)
        part, shard = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        docs: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            numbers = np.array([0 if d is None else d for d in docs], np.int64)
            data = WaveletMatrix.build(ids, numbers, lengths).to_bytes()
            nameless = sum(d is None for d in docs)  # the first ones of the shard
            values = [[part], [shard], [docs[0]], [len(docs)], [nameless], [len(ids)], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = [c.split()[0] for c in _FILES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for doc, ids in encoded(batches, encoder, END):
            docs.append(doc)
            held.append(ids)
            size += len(ids) // 4
            if size >= shard_tokens:
                yield flush()
                shard, size, held, docs = shard + 1, 0, [], []
        if docs:
            yield flush()

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the ids of all documents, in ascending ``doc_id`` order, as wavelet matrix shards.

    ``tokenizer`` is the file of a word-level BPE vocabulary that drops white space. Every
    document, also a null or empty one, ends with id 1; repeated rows are written each; rows
    without id come first and stay without. Texts are range-partitioned by id, encoded
    and written in one stage; a task holds one shard of about ``shard_tokens`` ids at a time.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, shard_tokens), _FILES).write.parquet(folder)


_READ = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, nameless, data in zip(*(batch.column(c) for c in ("part", "shard", "nameless", "data")), strict=True):
            matrix = WaveletMatrix.from_bytes(data.as_py())
            ids = memoryview(matrix.to_array().astype("<u4").tobytes())
            ends = np.cumsum(matrix.lengths)
            at = ends - matrix.lengths
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part.as_py(), np.int32)),
                    pa.array(np.full(n, shard.as_py(), np.int32)),
                    pa.array(matrix.doc_ids, mask=np.arange(n) < nameless.as_py()),
                    pa.array(at),
                    pa.array(matrix.lengths),
                    pa.array(sums, pa.int64()),
                ],
                [c.split()[0] for c in _READ.split(", ")],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder of shards: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before. Sizes are summed per shard within a range
    partition, then over the partitions, so no list of all shards meets in one task.
    """
    files = spark.read.schema(_FILES).parquet(folder)
    sizes = files.select("part", "shard", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("_all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select(
        "part", "shard", (F.col("_before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).alias("_start")
    )
    docs = files.select("part", "shard", "nameless", "data").mapInArrow(_read, _READ)
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the shards to ``folder`` (default: a fresh one in the shared folder) and read them."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer)
    return read_token_files(docs.sparkSession, folder)
