"""Tables, the shared folder, and numpy kernels over Arrow text columns.

The kernels look at whole texts, but hold about ``PIECE`` bytes at a time (one longer text counts as one piece).
A null text has no words.
"""

from __future__ import annotations

import ctypes
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 18
SALTS = 64
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_join(rows: DataFrame, small: DataFrame, key: str, by: Column) -> DataFrame:
    """rows with the columns of small, which has one row a key, where one key may hold most of rows.

    Rows are dealt by the key and a hash of ``by``; of small each key goes once to each of the at most ``SALTS`` places where rows of it are.
    """
    dealt = rows.withColumn("_ff_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    places = dealt.select(key, "_ff_salt").distinct().join(small, key)
    return dealt.join(places, [key, "_ff_salt"]).drop("_ff_salt")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes segments and filters."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between stages, and one executor's workers share its limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE_FOLDED = _TABLE[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0x9E6C63D0676A9A99
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), _U)
        have[1:] = base & 0xFFFFFFFFFFFFFFFF
        have = np.multiply.accumulate(have)
        if n <= 1 << 20:
            _powers[base] = have
    return have[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], whatever stands before it."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(_STEP, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_BACK, len(values) + 1)[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of rows first..last-1. of: where each row's words begin (one more than rows); starts, ends: byte places in data."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    inside: np.ndarray

    def hashes(self, folded: bool = False) -> np.ndarray:
        return span_hash((_TABLE_FOLDED if folded else _TABLE)[self.data], self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """Row, counted from first, of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.of))

    def at(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        return b" ".join(self.data[self.starts[i] : self.ends[j - 1]].tobytes().split()) if j > i else b""


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Row ranges of about size bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def words_of(column: pa.Array, size: int = PIECE):
    """Words (runs of other than ASCII white space) of a string column, a piece at a time."""
    if len(column) == 0:
        return
    data, offsets = buffers(column)
    for i, j in pieces(offsets, size):
        own = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        inside = ~_SPACE[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[at] = True
        before = np.zeros(len(own), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(own), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Words(i, j, own, at, starts, ends, np.searchsorted(starts, at), inside)
    release()


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def shingles(hashes: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of width words within a row, and its row. A row of fewer words, but not none, is one shingle."""
    counts = np.diff(of)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - width + 1
    if n > 0:
        whole = hashes[:n].copy()
        for k in range(1, width):
            whole = whole * _U(0xD1342543DE82EF95) + hashes[k : n + k]
        ok = rows[:n] == rows[width - 1 :]
        whole, own = mix(whole[ok]), rows[:n][ok]
    else:
        whole, own = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.concatenate([whole, span_hash(hashes, of[short], of[short + 1])])
        own = np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        whole, own = whole[order], own[order]
    return whole, own


def int_column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
