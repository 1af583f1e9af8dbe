"""Validators as violation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """key and rule of each row that breaks a rule (false or null) - one pass, no union of scans."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def _implies(a: Column, b: Column) -> Column:
    return ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def _between(c: str, low: float, high: float) -> Column:
    """Null, or within the bounds."""
    return F.col(c).isNull() | F.col(c).between(low, high)


def record_rules(kind: str) -> dict[str, Column]:
    """V2, V5: rules of a kind of record by name, for ``violations``.

    segment: start_page, end_page; range: start, end (inclusive, from 1); span: start, end (half open); replacement: action, replacement_text,
    confidence; directive: render_as, heading_level, list_depth.
    """
    col = F.col
    return {
        "segment": lambda: {"start_page is at least 1": col("start_page") >= 1, "start_page is not after end_page": col("start_page") <= col("end_page")},
        "range": lambda: {"start is at least 1": col("start") >= 1, "end is not before start": col("end") >= col("start")},
        "span": lambda: {"start is not negative": col("start") >= 0, "start is before end": col("start") < col("end")},
        "replacement": lambda: {"replace has a text": _implies(col("action") == "replace", col("replacement_text").isNotNull()), "only replace has a text": _implies(~col("action").eqNullSafe("replace"), col("replacement_text").isNull()), "confidence is a share": _between("confidence", 0, 1)},
        "directive": lambda: {"heading_level is of a heading": _implies(col("heading_level").isNotNull(), col("render_as") == "heading"), "list_depth is of a list item": _implies(col("list_depth").isNotNull(), col("render_as") == "list_item"), "heading_level is 1 to 6": _between("heading_level", 1, 6), "list_depth is 0 to 6": _between("list_depth", 0, 6)},
    }[kind]()


def duplicates(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    """V4, V6: keys that occur more than once; text without case."""
    kinds = dict(df.dtypes)
    keys = [(F.lower(k) if kinds[k] == "string" else F.col(k)).alias(k) for k in key]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("rule", F.lit(rule))


def native_document(elements: DataFrame, spans: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """V3: doc_id, id and rule: repeated ids, spans outside the text, units that are not there."""
    keyed = lambda df, rule: df.select("doc_id", F.col("id").cast("string").alias("id"), F.lit(rule).alias("rule"))
    repeated = elements.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    outside = spans.join(texts.select("doc_id", F.length("base_text").alias("size")), "doc_id", "left").where("size IS NULL OR start < 0 OR end <= start OR end > size")
    orphan = elements.join(units.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_anti")
    return reduce(DataFrame.unionByName, [keyed(repeated, "repeated id"), keyed(outside, "span outside text"), keyed(orphan, "unknown unit")])


def exact_gold(annotations: DataFrame) -> DataFrame:
    """V6: gold spans whose text is not the exact substring."""
    return annotations.where(~F.coalesce(F.substring(F.col("reference_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("text"), F.lit(False)))


def corpus_links(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """Manifest documents and annotations that do not agree one to one on id and version."""
    j = manifest.withColumn("m", F.lit(True)).join(annotations.select("doc_id", F.col("version").alias("v"), F.lit(True).alias("a")), "doc_id", "full")
    rule = F.when(F.col("a").isNull(), "no annotation").when(F.col("m").isNull(), "not in manifest").when(F.col("v") != F.col("version"), "version differs")
    return j.select("doc_id", rule.alias("rule")).where("rule IS NOT NULL")


def routes(pages: DataFrame, asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pages without a route and routes that a page's type does not allow."""
    j = pages.join(asked, ["doc_id", "page"], "left")
    ok = allowed.select("page_type", "route", F.lit(True).alias("ok"))
    return j.join(ok, ["page_type", "route"], "left").select("doc_id", "page", F.when(F.col("route").isNull(), "missing route").when(F.col("ok").isNull(), "route not allowed").alias("rule")).where("rule IS NOT NULL")
