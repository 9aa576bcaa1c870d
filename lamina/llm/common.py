"""What the operators share: the folder all executors see, written tables, words and their hashes.

Null texts count as empty everywhere. Words are maximal runs of characters other than
space, tab, newline, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.storage import Scratch, shared_folder, written  # noqa: F401

_U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones of any name can't clash with those an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 ...: names with dots can't go to mapInArrow."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


class Memo(dict):
    """make(key) for each key, remembered for keys of at most 64 characters or bytes that were used lately.

    renew() starts a new generation where this one has over ``limit`` keys; what the one before holds
    is taken over when it is asked for. So at most about twice as many are kept.
    """

    def __init__(self, make, limit: int):
        self.make, self.limit, self.earlier = make, limit, {}

    def __missing__(self, key):
        value = self.earlier.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def renew(self) -> None:
        if len(self) > self.limit:
            self.earlier = dict(self)
            self.clear()


class WordHashes:
    """64-bit hashes of words."""

    def __init__(self, limit: int = 200_000):
        self.known = Memo(xxhash.xxh3_64_intdigest, limit)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        self.known.renew()
        return np.fromiter(map(self.known.__getitem__, words), _U64, len(words))


_LIVE: dict = {}


def _returned() -> None:
    """Give back to the system what this process has freed, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def resident(name: str, make):
    """What a Python worker keeps from task to task: one operator's caches at a time, so that those of an earlier stage don't add to its memory."""
    if name not in _LIVE:
        if _LIVE:
            _LIVE.clear()
            _returned()
        _LIVE[name] = make()
    return _LIVE[name]


def word_hashes() -> WordHashes:
    return resident("words", WordHashes)


def words_of(text: str) -> list[bytes]:
    """bytes.split() splits at exactly the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads the bits of sums and products."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_ODD = (np.arange(1, 65, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hash of each window of n words, in order. A text of fewer words, but some, has one: all its words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    total = np.zeros(m, _U64)
    for k in range(n):
        total += mixed(hashes[k : k + m]) * _ODD[k]
    return mixed(total)


def as_bytes(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids, dtype="<u4").tobytes()


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
