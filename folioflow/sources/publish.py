"""Results that appear as a whole: parts are written beside the old ones, checked, and then one manifest row makes them the current ones.

A driver that is lost anywhere before the manifest is written leaves the old result as it was; what it has written stays unread until
``clean``. The manifest is a file that the committer moves to its place, so readers see either all of a publication or nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, version string, part string, n_rows bigint, digest decimal(38,0), columns array<string>"


def _sum(df: DataFrame):
    """A digest of rows that does not depend on their order or their partitions."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """All publications of target, one row a part; none if it has none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).json(f"{target}/_manifest")
    except AnalysisException:  # nothing is published yet
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, target: str) -> DataFrame:
    """Parts of the last publication; of two with one number the one whose version sorts last."""
    every = manifest(spark, target)
    last = every.agg(F.max(F.struct("number", "version")).alias("x")).select("x.*")
    return every.join(last, ["number", "version"])  # last is one row


def verify(part: str, written: dict, read: dict) -> None:
    """Refuse a part that reads otherwise than it was written."""
    if written != read:
        raise ValueError(f"{part} was written as {written} and reads as {read}")


def publish(spark: SparkSession, target: str, parts: dict[str, DataFrame], by: dict[str, str] | None = None) -> str:
    """Write, verify, switch; the version that is current then. by: the column that a part is partitioned by (one folder a value)."""
    held = current(spark, target).select("number").first()
    version, rows = uuid.uuid4().hex, []
    for name, df in parts.items():
        seen = Observation(f"{name}-{version}")
        out, at = df.observe(seen, F.count(F.lit(1)).alias("n"), _sum(df).alias("digest")), f"{target}/{version}/{name}"
        writer = out.repartition(by[name]).write.partitionBy(by[name]) if by and name in by else out.write
        writer.parquet(at)
        back = spark.read.schema(df.schema).parquet(at)
        read = back.agg(F.count(F.lit(1)).alias("n"), _sum(df).alias("digest")).first().asDict()
        verify(name, seen.get, read)
        rows.append(((held["number"] if held else 0) + 1, version, name, read["n"], read["digest"], df.columns))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{target}/_manifest")
    return version


def read(spark: SparkSession, target: str, part: str) -> DataFrame:
    """A part of the last publication."""
    row = current(spark, target).where(F.col("part") == part).first()
    if row is None:
        raise KeyError(f"{target} has no {part}")
    return spark.read.parquet(f"{target}/{row['version']}/{part}").select(*row["columns"])


def statuses(spark: SparkSession, target: str) -> DataFrame:
    """One row a publication: number, version, parts, rows, whether it is the current one."""
    last = current(spark, target).select("version", F.lit(True).alias("_last")).distinct()
    per = manifest(spark, target).groupBy("number", "version").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_rows").alias("n_rows"))
    return per.join(last, "version", "left").select("number", "version", "parts", "n_rows", F.coalesce("_last", F.lit(False)).alias("is_current"))
