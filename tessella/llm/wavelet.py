"""Token-ID output: a wavelet matrix per shard.

``write_shards`` encodes texts, orders them by document and stores each shard's ids as one compressed
blob: bit-planes from the highest bit down, each stably partitioned by the bit above, with a rank
directory. A blob answers access, rank (counting) and select (occurrence lookup) without decoding the
rest. Blobs are rows of a Parquet table, since that reaches any store Spark can write.

Null text counts as empty; a document's ids always end with ``end_id``. Documents with equal ids keep
all their rows. Null document ids come first. An empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, buffers, rest
from .tokenizing import library_tokenizer

#: Tokens from which a shard is closed; it then ends with the document at hand.
SHARD_TOKENS = 1 << 20
#: A worker tokenises in runs of this size and remembers two generations of pieces of this size.
RUN_BYTES, CACHE_BYTES = 2 << 20, 80 << 20
MAGIC = b"TWM1"
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of ids below 2**levels."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks, self.levels = n, zeros, planes, ranks, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> "WaveletMatrix":
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = a & a.dtype.type(1 << level) != 0
            plane = np.packbits(bits)
            planes.append(plane)
            ranks.append(cls.directory(plane, len(a)))
            low, high = a.take(np.flatnonzero(~bits)), a.take(np.flatnonzero(bits))
            zeros.append(len(low))
            a = np.concatenate([low, high])
        return cls(len(ids), np.array(zeros, np.int64), planes, ranks)

    @staticmethod
    def directory(plane: np.ndarray, n: int) -> np.ndarray:
        """Ones before each block of BLOCK bits."""
        blocks = n // BLOCK + 1
        counts = np.zeros(blocks * (BLOCK // 8), np.uint8)
        counts[: len(plane)] = _ONES[plane]
        sums = counts.reshape(blocks, -1).sum(1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(sums)[:-1]]).astype(np.uint32)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        at, plane = block * (BLOCK // 8), self.planes[level]
        found = int(self.ranks[level][block]) + int(_ONES[plane[at : i >> 3]].sum())
        return found + (int(_ONES[plane[i >> 3] >> (8 - (i & 7))]) if i & 7 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            b, one = self.bit(level, i), self.ones(level, i)
            value = value << 1 | b
            i = int(self.zeros[level]) + one if b else i - one
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for level in range(self.levels):
            a, b = self.ones(level, start), self.ones(level, end)
            if value >> (self.levels - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value among the first i tokens."""
        start, end = self._range(value, i)
        return end - start

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value."""
        start, end = self._range(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            want = at - int(self.zeros[level]) if one else at
            low, high = 0, self.n
            while low < high:  # the first prefix that holds want + 1 such bits
                mid = (low + high) // 2
                ones = self.ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at

    def decode(self) -> np.ndarray:
        """All tokens, by undoing each plane's partition from the lowest up."""
        a = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            z, out = int(self.zeros[level]), np.empty_like(a)
            a[z:] |= a.dtype.type(1 << self.levels - 1 - level)
            out[np.flatnonzero(~bits)], out[np.flatnonzero(bits)] = a[:z], a[z:]
            a = out
        return a

    def to_bytes(self, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
        tables = zlib.compress(np.diff(doc_ids, prepend=np.int64(0)).astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), 1)
        head = struct.pack("<4sBQQQ", MAGIC, self.levels, self.n, len(doc_ids), len(tables))
        body = b"".join(struct.pack("<Q", int(z)) + r.astype("<u4").tobytes() + p.tobytes() for z, r, p in zip(self.zeros, self.ranks, self.planes))
        return head + tables + body

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple["WaveletMatrix", np.ndarray, np.ndarray]:
        magic, levels, n, docs, size = struct.unpack_from("<4sBQQQ", blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sBQQQ")
        tables = np.frombuffer(zlib.decompress(blob[at : at + size]), "<i8")
        at += size
        zeros, ranks, planes = [], [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", blob, at)[0])
            blocks = n // BLOCK + 1
            ranks.append(np.frombuffer(blob, "<u4", blocks, at + 8))
            at += 8 + 4 * blocks
            planes.append(np.frombuffer(blob, np.uint8, (n + 7) // 8, at))
            at += (n + 7) // 8
        return cls(n, np.array(zeros, np.int64), planes, ranks), np.cumsum(tables[:docs]), tables[docs:]


SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, before long, blob binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shards of ids in ascending document order: ``part`` and ``shard`` number them, ``before`` counts the part's earlier tokens."""

    def shards(batches):
        model, part, shard, before = library_tokenizer(tokenizer, run_bytes=RUN_BYTES, cache_bytes=CACHE_BYTES), TaskContext.get().partitionId(), 0, 0
        levels = 16
        held_ids, held_docs, held_lengths, size = [], [], [], 0

        def close():
            nonlocal shard, before, held_ids, held_docs, held_lengths, size
            ids = np.concatenate(held_ids)
            matrix = WaveletMatrix.build(ids, levels if not len(ids) or ids.max() < 1 << levels else 32)
            blob = matrix.to_bytes(np.concatenate(held_docs), np.concatenate(held_lengths))
            docs_in = sum(map(len, held_docs))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": [docs_in], "n_tokens": [size], "before": [before], "blob": pa.array([blob], pa.binary())})
            shard, before = shard + 1, before + size
            held_ids, held_docs, held_lengths, size = [], [], [], 0
            return row

        for batch in batches:
            names = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy()
            sign = np.where(batch.column(0).is_null().to_numpy(zero_copy_only=False), -1, 1)  # a null id's length is negative
            for first, ids, offs in model.encode(*buffers(batch.column(1)), end_id=end_id):
                i = 0
                while i < len(offs) - 1:  # as many documents as still fit, one at least
                    j = max(i + 1, int(np.searchsorted(offs, offs[i] + shard_tokens - size, "left")))
                    j = min(j, len(offs) - 1)
                    held_ids.append(ids[offs[i] : offs[j]])
                    held_docs.append(names[first + i : first + j])
                    held_lengths.append(np.diff(offs[i : j + 1]) * sign[first + i : first + j])
                    size += int(offs[j] - offs[i])
                    i = j
                    if size >= shard_tokens:
                        yield close()
        if held_ids:
            yield close()

    ordered = rest(docs, [id_col], text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    return ordered.mapInArrow(shards, SHARD_SCHEMA)


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document of written shards: its place among all ids and its ids as little-endian unsigned 32-bit integers."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row a written part: its running sum is over a few numbers, whatever the data.
    earlier = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))

    def documents(batches):
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                matrix, names, lengths = WaveletMatrix.from_bytes(blob.as_buffer().to_pybytes())
                raw, unnamed, lengths = matrix.decode().astype("<u4"), lengths < 0, np.abs(lengths)
                ends = np.cumsum(lengths)
                for i in range(0, len(names), 20_000):
                    j = min(i + 20_000, len(names))
                    a, b = int(ends[i] - lengths[i]), int(ends[j - 1])
                    offs = np.concatenate([[a], ends[i:j]]).astype(np.int64) - a
                    ids = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((offs * 4).astype(np.int32)), pa.py_buffer(raw[a:b])])
                    doc = pa.array(names[i:j], mask=unnamed[i:j])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(first + offs[:-1] + a), pa.array(lengths[i:j]), ids], ["doc_id", "start", "n_tokens", "ids"])

    placed = shards.join(F.broadcast(earlier), "part").select((F.col("offset") + F.col("before")).alias("first"), "blob")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards of ``docs`` in the shared folder and returns their table."""
    return Scratch(docs.sparkSession).write(write_shards(docs, tokenizer, end_id, id_col, text_col), "none")
