"""Vectorised text helpers shared by the operators; they run inside Spark tasks on Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Words, shingles and byte windows are
identified by 64-bit hashes with fixed constants, so every task and every run agrees.
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
MULTIPLIERS = _RNG.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), BASE, U64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits (bijective)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n+1 offsets of the texts; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Words of a run of documents: start, end (bytes), 64-bit hash; ``at``: n+1 word offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True, lower: bool = True) -> None:
        data = LOWER[data] if lower else data
        inside = ~SPACE[data]
        begins = np.concatenate([[False], inside, [False]])
        first = begins[1:-1] & ~begins[:-2]
        last = begins[1:-1] & ~begins[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offsets)
        self.hash = np.zeros(0, U64)
        if hashed and len(self.start):
            length = self.end - self.start
            heads = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(heads, length)
            values = BYTE_CODE[data[inside]] * powers(int(length.max()))[place]
            self.hash = mix(np.add.reduceat(values, heads) + length.astype(U64))


def sequence(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of word hashes that is too short for a shingle."""
    terms = np.concatenate([h * MULTIPLIERS[: len(h)], np.array([len(h)], U64)])
    return mix(np.add.reduce(terms, keepdims=True) ^ MULTIPLIERS[63])[0]


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each document; fewer words are one whole sequence."""
    h, at = words.hash, words.at
    n = len(h)
    rolled = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        rolled += h[j : n - k + 1 + j] * MULTIPLIERS[j] if n >= k else U64(0)
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(np.array([sequence(h[a:b])], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U64, copy=False).view(np.int64)


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=U64) * U64(2) + U64(1)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nonnegative numbers in order, the first place of each, and for each value its rank: np.unique by one
    plain sort of values with their places, where both fit 64 bits."""
    n = len(values)
    bits = max(n - 1, 0).bit_length()
    if not n or int(values.max()).bit_length() + bits > 64:
        return np.unique(values, return_index=True, return_inverse=True)
    both = values.astype(U64)
    both <<= U64(bits)
    both |= np.arange(n, dtype=U64)
    both.sort()
    place = (both & U64((1 << bits) - 1)).view(np.int64)
    both >>= U64(bits)
    head = np.concatenate([[True], both[1:] != both[:-1]])
    order = np.cumsum(head)
    order -= 1
    rank = np.empty(n, np.int64)
    rank[place] = order
    return both[head].view(np.int64), place[head], rank


def packed(values: np.ndarray) -> bytes:
    """A numeric array as zstd of its byte planes (high bytes of small numbers cost nothing)."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches and None results give nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; set here only where it is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.match("local", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join("/tmp", "checkpoints", str(uuid.uuid4()))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, as its result is kept elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made here: the setting is read when one is made


def stored(df: DataFrame, *partition_by: str, folder: str | None = None) -> DataFrame:
    """The same cut for a large table: written as compressed Parquet to the shared folder (a checkpoint isn't compressed)."""
    folder = folder or f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*df.columns)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder that are removed when the block ends, or before; what a block returns must be cut."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, []
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def folder(self) -> str:
        """A new folder that goes with the others."""
        self.folders.append(f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}")
        return self.folders[-1]

    def stored(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.tables.append((stored(df, *partition_by, folder=self.folder()), self.folders[-1]))
        return self.tables[-1][0]

    def drop(self, df: DataFrame) -> None:
        removed(self.spark, next(folder for table, folder in self.tables if table is df))

    def __exit__(self, *_: object) -> None:
        for folder in self.folders:
            removed(self.spark, folder)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nonnegative numbers in 7-bit groups, low group first, high bit set on all but the last: (bytes, length of each)."""
    values = values.astype(U64, copy=False)
    most, groups = int(values.max()) if len(values) else 0, 1
    size = np.ones(len(values), np.uint8)
    while most >> 7 * groups:
        size += values >= U64(1) << U64(7 * groups)
        groups += 1
    if groups == 1:
        return values.astype(np.uint8), size
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.empty(int(at[-1] + size[-1]), np.uint8)
    long = np.flatnonzero(size > 1)
    out[at] = values.astype(np.uint8) & 127
    out[at[long]] |= 128
    for k in range(1, groups):
        group = (values[long] >> U64(7 * k)).astype(np.uint8) & 127
        more = size[long] > k + 1
        out[at[long] + k] = group | (more.astype(np.uint8) << 7)
        long = long[more]
    return out, size


def from_varints(data: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(data < 128)
    if len(end) == len(data):
        return data.astype(np.int64)
    start = np.concatenate([[0], end[:-1] + 1])
    size = end - start + 1
    out = (data[start] & 127).astype(np.int64)
    long, k = np.flatnonzero(size > 1), 1
    while len(long):
        out[long] |= (data[start[long] + k] & 127).astype(np.int64) << (7 * k)
        k += 1
        long = long[size[long] > k]
    return out
