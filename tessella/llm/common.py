"""Helpers shared by the training-data operators: scratch tables, Arrow text buffers, digests."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_own_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent a temporary folder is used, but only for a local master: on a cluster
    a machine-local folder is not visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="tessella-"))
    return _own_scratch[0]


#: While a table is written under this setting, Spark removes the shuffle files of the query as soon as it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables that cut lineage; they survive the loss of any executor, and go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(_FREE_SHUFFLES)
        self.spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(_FREE_SHUFFLES, before)
        if self.n == 1:
            files, root = self._files(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for t in tables:
            files, path = self._files(t.scratch_path)
            files.delete(path, True)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int):
    """Slices of consecutive rows with about ``most`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def rest(df: DataFrame, taken: list[str], *used: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*taken, *used])])
