"""Stores of schemas and routing profiles: keys without case, an ordered list, and updates that fit the version they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASELESS = "UTF8_LCASE"


def caseless(key: Column) -> Column:
    """A key that compares without case in joins, groups and orders."""
    return F.collate(key, CASELESS)


def listed(stored: DataFrame, key: str) -> DataFrame:
    """Stored rows in the order of their keys, case aside; spellings of one key (there is one at most) by their bytes."""
    return stored.orderBy(caseless(F.col(key)), key)


def found(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key with the stored row of any spelling: asked (the key as wanted) and the stored columns, null where there is none."""
    w = wanted.select(F.col(key).alias("asked"))
    return w.join(stored, caseless(F.col("asked")) == caseless(F.col(key)), "left")


def put(stored: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The store after changes, and what became of each: created, updated, deleted, exists, conflict, missing or repeated.

    stored: key, version, and more; changes: key, expected (the version it was made from; null: a new key), seq, deleted, and the columns of
    stored but version. A change is taken if the key has the expected version; of several changes of one key, whatever its spelling, the first
    by seq counts and others are told as repeated. An update keeps the stored spelling of its key.
    """
    rest = [c for c in stored.columns if c not in (key, "version")]
    first = F.row_number().over(Window.partitionBy(caseless(F.col(key))).orderBy("seq"))
    c = changes.withColumn("_nth", first).select(F.col(key).alias("_k"), "expected", "seq", "deleted", "_nth", *[F.col(n).alias(f"_{n}") for n in rest])
    j = c.join(stored, caseless(F.col("_k")) == caseless(F.col(key)), "left")
    there = F.col(key).isNotNull()
    outcome = (
        F.when(F.col("_nth") > 1, "repeated").when(F.col("expected").isNull() & there, "exists").when(F.col("expected").isNull() & F.col("deleted"), "missing").when(F.col("expected").isNull(), "created")
        .when(~there, "missing").when(F.col("version") != F.col("expected"), "conflict").when(F.col("deleted"), "deleted").otherwise("updated")
    )
    told = j.withColumn("outcome", outcome)
    taken = told.where(F.col("outcome").isin("created", "updated", "deleted"))
    gone = taken.where("outcome <> 'created'").select(F.col(key).alias("_gone"))
    kept = stored.join(gone, caseless(F.col(key)) == caseless(F.col("_gone")), "left_anti")
    new = taken.where("outcome <> 'deleted'").select(F.coalesce(key, "_k").alias(key), (F.coalesce("version", F.lit(0)) + 1).cast(stored.schema["version"].dataType).alias("version"), *[F.col(f"_{n}").alias(n) for n in rest])
    return kept.unionByName(new), told.select("seq", F.col("_k").alias(key), "outcome")
