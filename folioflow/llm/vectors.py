"""Whole-number vectors: scaling, packing, exact inner products and the best of them; shared by the two vector searches.

A vector that is null, or that holds a null or a non-finite component, takes no part, nor does a row without an id. Of rows
that share an id the one with the smallest vector takes part. Vectors of unequal length are multiplied over the components
that both have. Components and products beyond the range of a long stay at its ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = -(2**63) + 1, 2**63 - 1


def takes_part(c: Column) -> Column:
    return c.isNotNull() & ~F.coalesce(F.exists(c.cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def rows_of(df: DataFrame, id_column: str, vector: str, *more: str) -> DataFrame:
    """id, x (array of double) and the columns more, one row an id."""
    c = F.col(vector).cast("array<double>")
    rows = df.where(F.col(id_column).isNotNull() & takes_part(F.col(vector))).select(F.col(id_column).cast("bigint").alias("id"), F.struct(c.alias("x"), *more).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")


def matrices(column: pa.Array, scale: float):
    """(places, whole numbers floor(scale * x)) for each length of vector in an Arrow column of lists."""
    offsets = np.asarray(column.offsets)
    flat, lengths = np.asarray(column.values.cast(pa.float64())), np.diff(offsets)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore"):
            x = np.floor(flat[offsets[at][:, None] + np.arange(d)] * scale)
        yield at, narrow(np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    most = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def pack(x: np.ndarray) -> dict:
    return {"code": x.dtype.str, "width": x.shape[1], "xs": np.ascontiguousarray(x).tobytes()}


PACKED = "code string, width int, xs binary"


def unpack(row: dict, name: str = "xs") -> np.ndarray:
    x = np.frombuffer(row[name], row["code"])
    return x.reshape(-1, row["width"]) if row["width"] else x.reshape(len(row["ids"]) // 8, 0)


class Exact:
    """Inner products of one matrix with others, in the smallest kind of number whose sums stay exact."""

    def __init__(self, x: np.ndarray):
        self.x, self.as_kind = x, {}
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))

    def of(self, kind) -> np.ndarray:
        if kind not in self.as_kind:
            self.as_kind[kind] = self.x.astype(kind)
        return self.as_kind[kind]

    def kind(self, other: Exact):
        """By Cauchy and Schwarz no partial sum exceeds the product of the norms."""
        most = self.norm * other.norm * 1.000001
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object

    def times(self, other: Exact, mine=slice(None), its=slice(None)) -> np.ndarray:
        kind, d = self.kind(other), min(self.x.shape[1], other.x.shape[1])
        got = self.of(kind)[mine, :d] @ other.of(kind)[its, :d].T
        return np.clip(got, LOW + 1, HIGH - 1).astype(np.int64) if kind is object else got.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, in no order; ties to the earlier column, so ids ascend."""
    m = scores.shape[1]
    if m <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    if max(-int(scores[scores > LOW].min(initial=0)), int(scores.max(initial=0))) < (1 << 62) // m:
        key = np.where(scores > LOW, scores * m - np.arange(m), LOW)
        at = np.argpartition(key, m - k, axis=1)[:, m - k :]
    else:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, at, 1), ids[at]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of both, row by row, by score down and id up."""
    scores, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def nothing(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The state of n queries that have found nothing."""
    return np.full((n, k), LOW, np.int64), np.full((n, k), HIGH, np.int64)
