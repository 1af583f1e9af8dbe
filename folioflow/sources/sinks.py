"""Rendering, envelopes, partitioned writes and control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PAGE_BREAK


def body(kind: Column, text: Column, level: Column, marker: Column, state: Column) -> Column:
    """K2: Markdown of a simple block by its type."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.coalesce(marker, F.lit("-")), F.lit(" "), text))
        .when(kind == "checkbox", F.concat(F.when(state == "checked", "- [x] ").when(state == "unchecked", "- [ ] ").otherwise("- [?] "), text))
        .otherwise(text)
    )


def table_markdown(cells: DataFrame, by: list[str]) -> DataFrame:
    """K2: one Markdown table a group from cells (row, col, text); bars are escaped, the first row is the head."""
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    width = F.max("col").over(Window.partitionBy(*by)) + 1
    rows = cells.withColumn("w", width).groupBy(*by, "row", "w").agg(F.map_from_entries(F.collect_list(F.struct("col", said.alias("said")))).alias("m"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), " | "), F.lit(" |"))
    lines = rows.select(*by, "row", "w", line.alias("line")).groupBy(*by, "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("l"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("w")))
    return lines.select(*by, F.array_join(F.concat(F.slice("l", 1, 1), F.array(rule), F.slice("l", 2, F.size("l"))), "\n").alias("markdown"))


def markdown(blocks: DataFrame, by: list[str], page: str, order: str, text: str) -> DataFrame:
    """K1: each document's text: blocks joined by blank lines, pages by the break mark."""
    paged = blocks.where(F.length(text) > 0).groupBy(*by, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("page_text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "page_text"))), lambda x: x["page_text"]), f"\n\n{PAGE_BREAK}\n\n")
    return paged.groupBy(*by).agg(joined.alias("markdown"))


def emitted_spans(blocks: DataFrame, by: list[str], page: str, order: str, text: str) -> DataFrame:
    """K1, K6: where each block's text stands in ``markdown``; offsets are running sums, so nothing is searched."""
    w = Window.partitionBy(*by).orderBy(page, order)
    b = blocks.where(F.length(text) > 0)
    gap = F.when(F.lag(page).over(w).isNull(), 0).when(F.lag(page).over(w) == F.col(page), 2).otherwise(4 + len(PAGE_BREAK))
    b = b.withColumn("_gap", gap)
    start = F.sum(F.col("_gap") + F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length(text)
    return b.withColumn("start", start).withColumn("end", start + F.length(text)).drop("_gap")


def envelope(documents: DataFrame, elements: DataFrame, by: str, version: str) -> DataFrame:
    """K3-K5: one JSON a document with its version and elements in order (page, seq)."""
    fields = [c for c in elements.columns if c != by]
    e = elements.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page", "seq", *[c for c in fields if c not in ("page", "seq")]))).alias("elements"))
    own = [c for c in documents.columns if c != by]
    j = documents.join(e, by, "left")
    return j.select(by, F.to_json(F.struct(F.lit(version).alias("schema_version"), F.col(by), *own, F.coalesce("elements", F.array().cast(e.schema["elements"].dataType)).alias("elements"))).alias("json"))


def safe_preview(markdown_text: Column) -> Column:
    """Tags escaped but for bare table and figure tags."""
    allowed = r"</?(?:table|thead|tbody|tr|th|td|caption|figure|figcaption)>"
    kept = F.regexp_replace(markdown_text, rf"(?i)({allowed})", "\u0001$1\u0002")
    parts = F.regexp_replace(F.replace(kept, F.lit("&"), F.lit("&amp;")), "\u0001<([^>]*)>\u0002", "\u0001$1\u0002")
    return F.translate(F.replace(F.replace(parts, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\u0001\u0002", "<>")


def write_archive(df: DataFrame, path: str, by: str, fmt: str = "json") -> None:
    """One folder a document (or segment, or category), written by Spark's committer."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """Latest row of each key; keys compare without case. The map side keeps one row a key."""
    both = current.unionByName(changes)
    folded = [F.lower(k).alias(f"_k{i}") if dict(both.dtypes)[k] == "string" else F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    rest = F.struct(*both.columns)
    return both.groupBy(*folded).agg(F.max_by(rest, version).alias("x")).select("x.*")


def sync(stored: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows of wanted keys, and wanted rows that are new; what is not wanted goes."""
    kept = stored.join(wanted.select(*key), key, "left_semi")
    return kept.unionByName(wanted.join(stored.select(*key), key, "left_anti").select(*stored.columns))


def restore(stored: DataFrame, version: int) -> DataFrame:
    """A restored state: another version or an unfinished run is pending again, a hash that disagrees is failed."""
    status = F.when(F.sha2("content", 256) != F.col("sha256"), "failed").when((F.col("version") != version) | F.col("status").isin("running", "queued"), "pending").otherwise(F.col("status"))
    return stored.withColumn("status", status).withColumn("result", F.when(F.col("version") == version, F.col("result")))


def annotations(elements: DataFrame, pages: DataFrame, reading_order: bool = True) -> DataFrame:
    """K7 without the drawing: group, label and box in the page's units. elements: doc_id, page, type, reading_order, x0..y1; pages: doc_id, page, width, height."""
    kind = F.col("type")
    group = (
        F.when(kind.isin("heading", "title"), "heading").when(kind.isin("table", "form_field", "checkbox"), "table").when(kind.isin("figure", "image", "chart"), "figure")
        .when(kind == "formula", "formula").when(kind.isin("seal", "signature"), "seal").otherwise("text")
    )
    g = F.col("group")
    name = (
        F.when(g == "heading", "Title").when(g == "table", F.when(kind.isin("form_field", "checkbox"), "Form").otherwise("Table")).when(g == "figure", "Figure")
        .when(g == "formula", "Formula").when(g == "seal", F.when(kind == "seal", "Seal").otherwise("Signature")).otherwise("Text")
    )
    order = F.col("reading_order").cast("string")
    label = F.when(g.isin("text", "heading"), order).otherwise(F.concat(name, F.lit(" "), order)) if reading_order else name
    boxes = elements.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    scaled = {c: F.col(c) * F.col("width" if c[0] == "x" else "height") for c in ("x0", "y0", "x1", "y1")}
    return boxes.withColumn("group", group).withColumn("label", label).withColumns(scaled).drop("width", "height")


def search_index(documents: DataFrame) -> DataFrame:
    """One JSON line a document with title, path, headings and text."""
    return documents.select("path", F.to_json(F.struct("title", "path", "headings", "summary")).alias("json"))


def manifests_match(a: DataFrame, b: DataFrame) -> bool:
    """K16."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
