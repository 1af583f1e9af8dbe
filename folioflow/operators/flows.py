"""End-to-end flows from the other operators."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import formats
from . import blocks, models

NATIVE = ("docx", "pptx", "xlsx", "csv", "html", "markdown", "epub", "odt", "odp", "ods")


def ingest(files: DataFrame, max_bytes: int, recognise: Callable[[], Callable[[dict], dict]] | None = None) -> dict[str, DataFrame]:
    """One route a file. Native formats are scanned into elements; pictures and PDFs go to an injected recogniser (none: an error row); refused files are error rows.

    Gives elements (path, element_order, unit_id, type, text, anchor, start, end), texts (path, base_text) and errors (path, error).
    """
    checked = formats.validated(files, max_bytes)
    refused = checked.where("error IS NOT NULL").select("path", "error")
    good = checked.where("error IS NULL")
    scanned = formats.scan(good.where(F.col("format").isin(*NATIVE)).select("path", "content"))
    native = blocks.native_document(scanned)
    rest = good.where(~F.col("format").isin(*NATIVE)).select("path", "content", "format")
    if recognise is None:
        read, failed = None, rest.select("path", F.lit("no recogniser").alias("error"))
    else:
        called = models.call(rest, recognise, "text string")
        failed = called.where("error IS NOT NULL").select("path", "error")
        read = called.where("error IS NULL").select("path", F.lit(1).alias("element_order"), F.lit("page-1").alias("unit_id"), F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("anchor"), F.lit(0).cast("bigint").alias("start"), F.length("text").cast("bigint").alias("end"))
    elements = native if read is None else ordered_union(native, read)
    errors = refused.unionByName(scanned.where("error IS NOT NULL").select("path", "error")).unionByName(failed)
    return {"elements": elements, "texts": blocks.base_text(elements), "errors": errors}


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Elements (or usage and trace rows) of several branches by name; columns that a branch lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def source(page: Column, bbox: Column, start: Column, end: Column) -> Column:
    """where a value stands, with only what is known."""
    return F.to_json(F.struct(page.alias("page"), bbox.alias("bbox"), start.alias("start"), end.alias("end")))


def extract(draft: DataFrame, evidence: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Values whose evidence resolves, after one repair round; what stays unresolved is null with its issue.

    draft, repaired: doc_id, pointer, value; evidence: doc_id, pointer, kind (of joins.resolve_evidence, for drafts and repairs alike).
    """
    bad = evidence.groupBy("doc_id", "pointer").agg(F.bool_or(F.col("kind") == "unknown").alias("bad"))
    j = draft.join(bad, ["doc_id", "pointer"], "left").withColumn("issue", F.when(F.col("bad").isNull() & F.col("value").isNotNull(), "no evidence").when(F.col("bad"), "unknown evidence"))
    if repaired is not None:
        j = j.join(repaired.select("doc_id", "pointer", F.col("value").alias("_r")), ["doc_id", "pointer"], "left")
        fixed = F.col("issue").isNotNull() & F.col("_r").isNotNull()
        j = j.withColumn("value", F.when(fixed, F.col("_r")).otherwise(F.col("value"))).withColumn("issue", F.when(~fixed, F.col("issue"))).drop("_r")
    return j.select("doc_id", "pointer", F.when(F.col("issue").isNull(), F.col("value")).alias("value"), "issue")


def corpus_run(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each manifest document: its result, its error, or a placeholder saying that its source is missing."""
    j = manifest.join(results.withColumn("_there", F.lit(True)), "doc_id", "left")
    return j.withColumn("error", F.when(F.col("_there").isNull(), "source is unavailable").otherwise(F.col("error"))).drop("_there")


def recovery_rank() -> Column:
    """Order of recovery candidates: unresolved form controls first, then severity, confidence, page, order, id."""
    return F.struct(F.when(F.array_contains("reasons", "unresolved_form_controls"), 0).otherwise(1).alias("a"), "severity", "confidence", "page", "reading_order", "target_id")


def recovery_log(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates in rank order, numbered."""
    from .windows import numbering

    return numbering(candidates.withColumn("rank", recovery_rank()), by, ["rank"], "number").drop("rank")


def segment_payload(segments: DataFrame, extracted: DataFrame, by: list[str]) -> DataFrame:
    """Each segment as JSON with its extraction where there is one; absent parts are left out."""
    e = extracted.select(*by, "segment_id", F.struct(*[c for c in extracted.columns if c not in (*by, "segment_id")]).alias("extraction"))
    j = segments.join(e, [*by, "segment_id"], "left")
    return j.select(*by, "segment_id", F.to_json(F.struct(*[c for c in segments.columns if c not in by], "extraction")).alias("json"))


def combined_envelope(parts: dict[str, DataFrame], by: str, version: str) -> DataFrame:
    """K4: one JSON a document with an array for each part (usage, trace, elements), ordered by seq."""
    out = None
    for name, df in parts.items():
        rest = [c for c in df.columns if c not in (by, "seq")]
        one = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias(name))
        out = one if out is None else out.join(one, by, "full")
    return out.select(by, F.to_json(F.struct(F.lit(version).alias("schema_version"), *parts)).alias("json"))


def inside(root: str, path: str) -> str:
    """Path below root, refused if it is absolute or climbs out."""
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts:
        raise ValueError(f"{path} is not inside {root}")
    return str(PurePosixPath(root) / p)


def alternate_engine(primary: Column) -> Column:
    """The engine that checks the other one."""
    return F.when(primary == "layout", "text").otherwise("layout")
