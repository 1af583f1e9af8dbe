"""Numbering, running offsets, islands, nesting and contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbering(df: DataFrame, by: list[str], order: list, into: str = "n") -> DataFrame:
    """1-based position within each group."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def running_offsets(df: DataFrame, by: list[str], order: list, text: str) -> DataFrame:
    """Start and end of each text in the join of the non-empty texts with one separator; null for empty ones."""
    size = F.coalesce(F.length(text), F.lit(0))
    before = F.coalesce(F.sum(F.when(size > 0, size + 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start", F.when(size > 0, before)).withColumn("end", F.when(size > 0, before + size))


def occurrences(df: DataFrame, name: str, identity: list[str], order: list) -> DataFrame:
    """Names repeated (ignoring case) are numbered; equal identities get a numbered id."""
    key = F.lower(F.col(name))
    same_name, same = Window.partitionBy(key), Window.partitionBy(*identity)
    df = df.withColumn("name_count", F.count(F.lit(1)).over(same_name)).withColumn("name_no", F.row_number().over(same_name.orderBy(*order)))
    df = df.withColumn("copy_no", F.row_number().over(same.orderBy(*order)))
    return df.withColumn("display_name", F.when(F.col("name_count") > 1, F.concat(F.col(name), F.lit(" ("), F.col("name_no"), F.lit(")"))).otherwise(F.col(name)))


def contiguity(segments: DataFrame, by: list[str], n_pages: str) -> DataFrame:
    """Whether segments (start_page, end_page) cover 1..n_pages exactly once, group by group."""
    w = Window.partitionBy(*by).orderBy("start_page", "end_page")
    step = segments.withColumn("ok", (F.col("start_page") == F.coalesce(F.lag("end_page").over(w) + 1, F.lit(1))) & (F.col("start_page") <= F.col("end_page")))
    return step.groupBy(*by).agg(F.bool_and("ok").alias("contiguous"), (F.max("end_page") == F.max(n_pages)).alias("reaches_end"), F.count(F.lit(1)).alias("n_segments"))


def islands(df: DataFrame, by: list[str], order: list, same: Column) -> DataFrame:
    """Island number; a row joins the island before it where ``same`` (may use F.lag over the given order) holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def merge_segments(segments: DataFrame, by: list[str]) -> DataFrame:
    """Neighbours of one category join across a context boundary (at_boundary): least confidence, evidence in order without repeats, review forced."""
    w = Window.partitionBy(*by).orderBy("start_page")
    same = F.col("at_boundary") & (F.lag("end_page").over(w) + 1 == F.col("start_page")) & (F.lag("category").over(w) == F.col("category"))
    runs = islands(segments, by, ["start_page"], same)
    return runs.groupBy(*by, "island").agg(
        F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.first("category").alias("category"), F.min("confidence").alias("confidence"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_page", "evidence"))), lambda x: x["evidence"]))).alias("evidence"), (F.count(F.lit(1)) > 1).alias("needs_review"),
    )


def clip_predictions(predictions: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Page ranges cut to the target window (first_page, last_page); evidence (array of struct id, page) outside goes; all evidence lost means confidence 0."""
    start, end = F.greatest("start_page", "first_page"), F.least("end_page", "last_page")
    kept = F.filter("evidence", lambda e: (e["page"] >= start) & (e["page"] <= end))
    return predictions.withColumn("kept", kept).where(start <= end).withColumn(confidence, F.when(F.size("kept") == 0, 0.0).otherwise(F.col(confidence))).withColumn("evidence", F.col("kept")).drop("kept").withColumn("start_page", start).withColumn("end_page", F.least("end_page", "last_page"))


def heading_parents(headings: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """The nearest earlier row of a smaller level. One running maximum a level, so the window is read once and no pairs are made. Levels are 1 to 6."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(order))).over(w) for k in range(1, 7)]
    df = headings
    for k, c in enumerate(last, 1):
        df = df.withColumn(f"_l{k}", c)
    smaller = [F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, 6)]
    return df.withColumn("parent", F.greatest(*smaller)).drop(*[f"_l{k}" for k in range(1, 7)])


def section_paths(blocks: DataFrame, by: list[str], order: str, level: str, text: str) -> DataFrame:
    """Section path of each block. A heading of level n cuts the path to n-1 entries by depth, then adds itself after its own path is taken.

    A fold over each document's sorted headings; non-headings (null level) take the path that stands.
    """
    state = "struct<path:array<string>,out:array<struct<o:bigint,path:array<string>>>>"

    def step(acc: Column, x: Column) -> Column:
        cut = F.when(x["l"].isNotNull(), F.slice(acc["path"], 1, F.least(F.size(acc["path"]), F.greatest(x["l"] - 1, F.lit(0))))).otherwise(acc["path"])
        after = F.when(x["l"].isNotNull(), F.array_append(cut, x["t"])).otherwise(cut)
        return F.struct(after.alias("path"), F.array_append(acc["out"], F.struct(x["o"].alias("o"), cut.alias("path"))).alias("out")).cast(state)

    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(level).cast("int").alias("l"), F.col(text).alias("t"))))
    folded = blocks.groupBy(*by).agg(F.aggregate(rows, F.struct(F.array().alias("path"), F.array().alias("out")).cast(state), step, lambda a: a["out"]).alias("x"))
    return folded.select(*by, F.explode("x").alias("x")).select(*by, F.col("x.o").alias(order), F.col("x.path").alias("section_path"))


def drop_repeated_first_line(blocks: DataFrame, by: list[str], order: list, text: str, is_heading: str) -> DataFrame:
    """A block's first line goes when it repeats the heading before it (case and a final colon aside)."""
    w = Window.partitionBy(*by).orderBy(*order)
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), ":$", ""))
    heading = F.when(F.lag(is_heading).over(w), plain(F.lag(text).over(w)))
    first = plain(F.substring_index(F.col(text), "\n", 1))
    rest = F.ltrim(F.when(F.instr(F.col(text), "\n") > 0, F.expr(f"substring({text}, instr({text}, '\\n') + 1)")).otherwise(""))
    return blocks.withColumn("_h", heading).withColumn(text, F.when((F.col("_h") != "") & (F.col("_h") == first), rest).otherwise(F.col(text))).drop("_h")


def suppress_repeats(lines: DataFrame, by: list[str], order: list, key: Column) -> DataFrame:
    """Rows equal to the one before go."""
    return lines.withColumn("_k", key).withColumn("_p", F.lag("_k").over(Window.partitionBy(*by).orderBy(*order))).where(~F.col("_k").eqNullSafe(F.col("_p"))).drop("_k", "_p")


def span_context(df: DataFrame, text: str, start: str, end: str, width: int = 32) -> DataFrame:
    """Up to ``width`` characters on either side of a span."""
    s, e = F.col(start), F.col(end)
    before = F.substring(F.col(text), F.greatest(s - width, F.lit(0)) + 1, F.least(s, F.lit(width)))
    return df.withColumn("before", before).withColumn("after", F.substring(F.col(text), e + 1, F.lit(width)))


def rebase_spans(edits: DataFrame, by: list[str]) -> DataFrame:
    """Start and end after earlier replacements in the same text; edits: start, end, new_length, not overlapping."""
    w = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("new_length") - (F.col("end") - F.col("start"))).over(w), F.lit(0))
    return edits.withColumn("new_start", F.col("start") + shift).withColumn("new_end", F.col("start") + shift + F.col("new_length"))


def batches(df: DataFrame, order: list, size: int, by: list[str]) -> DataFrame:
    """Batch number of fixed size."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def overlapped_windows(contexts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each context starts again with the last page of the one before."""
    return contexts.withColumn("read_from", F.coalesce(F.lag("last_page").over(Window.partitionBy(*by).orderBy(order)), F.col("first_page")))


def dense_form_order(regions: DataFrame, by: list[str]) -> DataFrame:
    """Reading order of a dense form. regions: id and box x0, y0, x1, y1.

    Tall narrow regions at the left edge are margins and come late. The header band ends at the first vertical gap of 0.02 after four
    regions; inside it, columns are runs of regions whose x gaps are at most 0.01. Then the main part by rows, margins, and what stands below 0.92.
    """
    tall = (F.col("x1") <= 0.2) & (F.col("y1") - F.col("y0") >= 0.08) & (F.col("y1") - F.col("y0") > 2 * (F.col("x1") - F.col("x0")))
    part = Window.partitionBy(*by, "margin")
    line = part.orderBy("y0", "x0", "id")
    df = regions.withColumn("margin", tall)
    bottom = F.max("y1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("gap", ~F.col("margin") & (F.row_number().over(line) > 4) & (F.col("y0") - bottom >= 0.02))
    df = df.withColumn("header", ~F.col("margin") & F.max("gap").over(part) & ~F.max("gap").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*by, "header").orderBy("x0", "y0", "id")
    right = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("column", F.when(F.col("header"), F.sum(F.when(F.col("x0") > F.coalesce(right, F.lit(-1.0)) + 0.01, 1).otherwise(0)).over(across)).otherwise(0))
    band = F.when(F.col("header"), 0).when(F.col("margin"), 2).when(F.col("y0") >= 0.92, 3).otherwise(1)
    order = F.row_number().over(Window.partitionBy(*by).orderBy(band, "column", F.bround("y0", 2), "x0", "y0", "id"))
    return df.select(*by, "id", order.alias("position"))
