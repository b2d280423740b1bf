"""Shared helpers: narrow inputs, settled tables, word splitting and polynomial hashes over Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.session import shared_dir

#: Bytes of text that one task turns into arrays at once; a longer text is taken alone.
CHUNK = 2 << 20
U64 = np.uint64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``(doc_id, key, text)``. ``key`` hashes the text (null as null), so that rows which share an id
    stay apart, and rows repeated exactly are one document."""
    text = F.col("text").cast("string")
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that ``spark.checkpoint.dir`` names and read back: cuts the lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fan_out(df: DataFrame, mb: float) -> int:
    """Partitions for an exchange of data of the size of ``df``: ``mb`` of stored input each, the session's number at least."""
    spark = df.sparkSession
    stored = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, stored // int(mb * (1 << 20))))


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on between tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row."""
    try:
        yield from _chunks(batches, limit, column)
    finally:
        trim()


def _chunks(batches: Iterable[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the ``n + 1`` places where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words(NamedTuple):
    data: np.ndarray
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray
    first: np.ndarray  # n + 1: number of words before each text

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]: self.ends[i]].tobytes()


_BYTES = np.arange(256)
#: Byte tables: True where a byte separates words. All bytes from 0x80 belong to words.
SPACES = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
NOT_ALNUM = (_BYTES < 0x80) & ~(((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def words(texts: pa.Array, separators: np.ndarray, fold: bool) -> Words:
    """Maximal runs of non-separator bytes inside each text; ``fold`` lower-cases A-Z first."""
    data, at = flat(texts)
    if fold:
        data = LOWER[data]
    inside = ~separators[data]
    edge = at[(at > 0) & (at < len(data))]
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    before[edge] = False
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = n + n // 16
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64 and then mixed, of the spans ``codes[starts:ends]``."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(w: Words) -> np.ndarray:
    return rolling(BYTE_CODES[w.data], w.starts, w.ends)


def windows(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of all runs of ``n`` words that stay inside one text."""
    total = int(first[-1])
    starts = np.arange(max(0, total - n + 1))
    doc = np.searchsorted(first, starts, "right") - 1
    return starts[starts + n <= first[doc + 1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"{name}_{uuid.uuid4().hex[:8]}"
