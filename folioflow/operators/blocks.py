"""Block trees, predicates, quality, retrieval and assembly of native documents (P1-P3, P6, P7, P11-P14, P19-P21, P23, P25, P27-P30, A4, A12, A15, A19-A21, F7, F27, J21, L5, L6, L13-L15, S18, S19).

Blocks are adjacency rows: doc_id, page, block_id, parent_id, reading_order, type, text, status, confidence and what each operator names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from . import joins, windows

# fixed values
VERIFY_BELOW = 0.85
COMPLEX = ("table", "form_field", "checkbox")
VISUAL = ("figure", "image", "chart")
DEGRADED = ("ambiguous", "degraded", "handwritten", "illegible", "obscured")
LARGE_VISUAL, INTERIOR, UNCOVERED = 0.15, (0.1, 0.1, 0.9, 0.9), 0.30
COVERAGE = 0.9


CHUNK_ROWS = 1 << 16


def _whole_groups(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.Table]:
    """Tables of about CHUNK_ROWS rows that never cut a group of equal values in column ``group``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            t = pa.Table.from_batches(held)
            last = pc.index(pc.equal(t[group], t[group][t.num_rows - 1]), True).as_py()
            if last:
                yield t.slice(0, last)
            held = t.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _walked(groups: np.ndarray, ids: np.ndarray, parents: np.ndarray, numbers: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """rows, depth, position and number of the rows that a root reaches, level by level. groups: codes; ids, parents: codes of one
    numbering, parents -1 without one; rows stand in sibling order."""
    n, wide = len(ids), int(max(ids.max(initial=-1), parents.max(initial=-1))) + 1
    keys = groups * wide + ids
    order = np.argsort(keys, kind="stable")
    asked = groups * wide + parents
    at = order[np.minimum(np.searchsorted(keys[order], asked), n - 1)]
    parent = np.where(parents < 0, -1, np.where(keys[at] == asked, at, -2))
    # children of a row, and the roots of a group, stand together
    owner = np.where(parent == -1, n + groups, np.where(parent == -2, -1, parent))
    by_owner = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[by_owner], np.arange(n + (int(groups[-1]) + 1 if n else 0) + 1))
    nth = np.empty(n, np.int64)
    nth[by_owner] = np.arange(n) - np.searchsorted(owner[by_owner], owner[by_owner]) + 1
    depth, size, levels, front = np.full(n, -1), np.ones(n, np.int64), [], np.arange(n, len(first) - 1)
    while len(front):
        counts = first[front + 1] - first[front]
        front = by_owner[np.repeat(first[front] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        if len(front):
            depth[front] = len(levels)
            levels.append(front)
    for rows in levels[:0:-1]:
        np.add.at(size, parent[rows], size[rows])
    position, number = np.zeros(n, np.int64), [None] * n
    for k, rows in enumerate(levels):
        before = np.cumsum(size[rows]) - size[rows]
        start = before[np.maximum.accumulate(np.where(nth[rows] == 1, np.arange(len(rows)), 0))]
        position[rows] = before - start + 1 + (position[parent[rows]] if k else 0)
        for r in rows.tolist() if numbers else ():
            number[r] = f"{number[parent[r]]}.{nth[r]}" if k else str(nth[r])
    found = np.flatnonzero(depth >= 0)
    return found, depth[found], position[found], [number[r] for r in found.tolist()]


def preorder(blocks: DataFrame, by: list[str], order: str = "reading_order", numbers: bool = True) -> DataFrame:
    """Depth, dotted section number and position of each block in a depth-first walk, siblings by order (then block_id).

    Rows whose parent is missing, and rows on a cycle, hang on no root and do not appear. A block_id stands for one block of its
    group. One shuffle by group; many groups are walked together, level by level, so neither rows nor levels have a limit.
    Numbers of a chain of n levels take n * n characters; without them (numbers=False, they are null) a row costs the same at any depth.
    """
    m = len(by)

    def run(batches):
        for t in _whole_groups(batches, m + 2):
            both = pa.chunked_array([*t[m].chunks, *t[m + 1].chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = t[m + 2].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found, depth, position, number = _walked(groups, both[: t.num_rows], both[t.num_rows :], numbers)
            kept = t.take(pa.array(found)).combine_chunks()
            yield from pa.table([*[kept[i] for i in range(m + 1)], pa.array(depth.astype(np.int32)), pa.array(number, pa.string()), pa.array(position.astype(np.int32))], names=[*by, "block_id", "depth", "number", "position"]).to_batches()

    kinds = dict(blocks.dtypes)
    group = F.to_json(F.struct(*by))
    rows = blocks.select(*by, "block_id", F.col("parent_id").cast(kinds["block_id"]).alias("parent_id"), group.alias("_ff_group"), F.col(order).alias("_ff_order"))
    rows = rows.repartition("_ff_group").sortWithinPartitions("_ff_group", "_ff_order", "block_id")
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in [*by, "block_id"]]) + ", depth int, number string, position int")


def active(blocks: DataFrame) -> DataFrame:
    """Without rejected blocks."""
    return blocks.where(~F.col("status").eqNullSafe("rejected"))


def elements(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Public elements: numbered from 1 in each page's walk."""
    return preorder(blocks, by, numbers=False).select(*by, "block_id", F.col("position").alias("element_order"), "depth")


def semantic_text(*parts: Column) -> Column:
    """The parts with white space squashed, joined by a space; empty ones go."""
    return F.concat_ws(" ", *[F.nullif(text.squash(p), F.lit("")) for p in parts])


def page_texts(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Evaluation text of each page: non-empty texts of active blocks in order, one a line."""
    said = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("reading_order", "block_id", F.trim("text").alias("t")))))
    return active(blocks).groupBy(*by).agg(F.array_join(F.transform(said, lambda x: x["t"]), "\n").alias("page_text"))


def subset_pages(c: Column, pages: Column) -> Column:
    """The named pages (1-based) of a text with page breaks."""
    return F.array_join(F.transform(pages, lambda i: F.get(text.pages(c), i - 1)), text.PAGE_BREAK)


def needs_verification() -> Column:
    """An unknown confidence does not ask for it."""
    return F.coalesce(F.col("confidence") < VERIFY_BELOW, F.lit(False)) | F.col("status").eqNullSafe("needs_review")


def incomplete(cells: Column, label: Column, option: Column) -> Column:
    """A table without cells or with an empty one, a form field without label, a checkbox without group or option."""
    empty = F.coalesce(F.size(cells) <= 0, F.lit(True)) | F.exists(cells, lambda c: F.trim(c) == "")
    return F.when(F.col("type") == "table", empty).when(F.col("type") == "form_field", F.coalesce(F.trim(label) == "", F.lit(True))).when(F.col("type") == "checkbox", F.coalesce(option == "", F.lit(True))).otherwise(False)


def repair_risks(bad_structure: Column, box: Column, warnings: Column) -> Column:
    """Risks of structured blocks; others have none."""
    degraded = F.exists(warnings, lambda w: F.lower(w).rlike("|".join(DEGRADED)))
    found = F.array_compact(F.array(F.when(F.col("status") == "rejected", "rejected"), F.when(bad_structure, "structure"), F.when(F.col("confidence") < VERIFY_BELOW, "confidence"), F.when(geometry.clipped(box), "geometry"), F.when(degraded, "degraded")))
    return F.when(F.col("type").isin(*COMPLEX), found).otherwise(F.array().cast("array<string>"))


def requires_repair(risks: Column) -> Column:
    return F.arrays_overlap(risks, F.array(*map(F.lit, ("rejected", "structure", "geometry", "degraded"))))


def repair_order(blocks: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Blocks at risk first, then doubtful literals; then least confident (unknown last), then reading order. blocks: risks, doubtful."""
    c = blocks.where((F.size("risks") > 0) | F.col("doubtful")).withColumn("priority", F.when(F.size("risks") > 0, 1).otherwise(2))
    c = windows.numbering(c, by, ["priority", F.col("confidence").asc_nulls_last(), "reading_order", "block_id"], "rank")
    return c if limit is None else c.where(F.col("rank") <= limit)


def crop_batches(requests: DataFrame, by: list[str], size: int = 8, most: int = 8) -> DataFrame:
    """The first requests by priority and confidence (unknown last), in batches."""
    c = windows.numbering(requests, by, ["priority", F.col("confidence").asc_nulls_last(), "reading_order", "block_id"], "rank")
    return c.where(F.col("rank") <= most).withColumn("batch", F.floor((F.col("rank") - 1) / size))


def literal_candidates(spans: DataFrame, threshold: float = VERIFY_BELOW) -> DataFrame:
    """Spans under the threshold; a span's confidence is its own, else its owner's, else its block's; unknown ones are passed over."""
    return spans.withColumn("known", F.coalesce("span_confidence", "owner_confidence", "block_confidence")).where(F.col("known") < threshold)


def scan_probes(boxes: DataFrame, covered: DataFrame, by: list[str]) -> DataFrame:
    """Large pictures without text, and the page's interior where too little of it is covered. boxes: type, text, box; covered: share of the interior that blocks cover."""
    b = F.col("box")
    visual = active(boxes).where(F.col("type").isin(*VISUAL) & (F.trim(F.coalesce("text", F.lit(""))) == "") & (geometry.area(b) >= LARGE_VISUAL)).select(*by, F.lit("visual").alias("reason"), "box").distinct()
    inside = F.named_struct(*[x for n, v in zip(("x0", "y0", "x1", "y1"), INTERIOR) for x in (F.lit(n), F.lit(v))])
    return visual.unionByName(covered.where(F.col("covered") <= 1 - UNCOVERED).select(*by, F.lit("interior").alias("reason"), inside.alias("box")))


def aggregated_confidence(own: Column, parts: Column) -> Column:
    """The least known confidence of a block and its parts."""
    return F.least(own, F.array_min(F.array_compact(parts)))


def table_quality(cells: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the filled share and the rectangular share; under two rows or columns 0.25."""
    rows, cols = F.max("row") + 1, F.max("col") + 1
    full = F.avg((F.trim("text") != "").cast("double"))
    return cells.groupBy(*by).agg(F.when((rows < 2) | (cols < 2), 0.25).otherwise((full + F.count_distinct("row", "col") / (rows * cols)) / 2).alias("table_quality"))


def page_quality(blocks: DataFrame, by: list[str], threshold: float = COVERAGE) -> DataFrame:
    """Mean coverage and the reasons for review of each page. blocks: status, coverage, bad_structure, box."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    checks = {"rejected_content": F.col("status") == "rejected", "block_needs_review": F.col("status") == "needs_review", "incomplete_structure": F.col("bad_structure"), "semantic_coverage_loss": F.col("coverage") < threshold, "geometry_loss": F.col("box").isNull()}
    return blocks.groupBy(*by).agg(F.round(F.avg("coverage"), 6).alias("semantic_coverage"), F.array_compact(F.array(*[F.when(any_of(c), name) for name, c in checks.items()])).alias("reasons"))


def page_accuracy(pages: DataFrame, by: list[str]) -> DataFrame:
    """Word accuracy over pages: distances and sizes are summed, then divided. pages: candidate, reference (texts)."""
    p = pages.withColumn("c", text.semantic_words(F.col("candidate"))).withColumn("r", text.semantic_words(F.col("reference"))).withColumn("d", text.token_distance("c", "r"))
    s = p.groupBy(*by).agg(F.sum("d").alias("d"), F.sum(F.size("c")).alias("nc"), F.sum(F.size("r")).alias("nr"), F.count(F.lit(1)).alias("page_count"))
    return s.select(*by, text.accuracy(F.col("d"), F.col("nc"), F.col("nr")).alias("word_accuracy"), F.when(F.col("nr") > 0, F.col("d") / F.col("nr")).otherwise((F.col("nc") > 0).cast("double")).alias("word_error_rate"), "page_count")


def hallucination(documents: DataFrame, key: str) -> DataFrame:
    """Inserted words, forbidden literals that appear, false accepts. documents: candidate, reference, forbidden, rejected, accepted."""
    d = documents.withColumn("c", text.semantic_words(F.col("candidate"))).withColumn("i", text.token_insertions("c", text.semantic_words(F.col("reference"))))
    said = text.normal_folded(F.col("candidate"))
    hit = text.bound(said, lambda s: F.size(F.filter("forbidden", lambda x: F.contains(s, text.normal_folded(x)))))
    rejected = F.array_distinct("rejected")
    false = F.size(F.array_intersect(rejected, F.col("accepted")))
    return d.select(key, F.col("i").alias("word_insertions"), F.when(F.size("c") > 0, F.col("i") / F.size("c")).otherwise(0.0).alias("hallucination_rate"), hit.alias("forbidden_literal_count"), false.alias("false_accept_count"), F.when(F.size(rejected) > 0, false / F.size(rejected)).otherwise(0.0).alias("false_accept_rate"))


def forbidden_hits(documents: DataFrame, literals: DataFrame, key: str) -> DataFrame:
    """Key and how many literals each text holds, by A15's normal form (composed, squashed, folded). documents: key, text; literals: text, each row counts.

    The words of a literal between its outer ones stand as whole words in a text that holds it, so the longest of them is the join key;
    a literal without one (fewer than three words) is keyed by its first three characters. What meets by key is compared as a whole.
    """
    plain = text.normal_folded
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    lits = literals.where("text IS NOT NULL").select(plain(F.col("text")).alias("lit")).groupBy("lit").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.split("lit", " ", -1))
    lits = lits.select("lit", "n", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("size"), x.alias("word"))))["word"].alias("word"))
    said = documents.select(key, plain(F.col("text")).alias("said"))

    def near(keys: Column, lits: DataFrame) -> DataFrame:
        return said.select(F.col(key).alias("_k"), F.explode_outer(F.array_distinct(keys)).alias("key")).join(lits, "key").select("_k", "lit", "n").distinct()

    chars = F.regexp_extract_all("said", F.lit("(?s)."), F.lit(0))
    runs = lambda c, m: F.when(F.size(c) >= m, F.transform(F.sequence(F.lit(1), F.size(c) - m + 1), lambda i: F.array_join(F.slice(c, i, m), ""))).otherwise(F.array().cast("array<string>"))
    pairs = near(F.split("said", " ", -1), lits.where("word IS NOT NULL").select(F.col("word").alias("key"), "lit", "n"))
    short = lits.where("word IS NULL").select(F.substring("lit", 1, 3).alias("key"), "lit", "n")
    if not short.isEmpty():  # asked of the literals alone; else every text would be cut into runs for nothing
        pairs = pairs.unionByName(near(text.bound(chars, lambda c: F.concat(F.array(F.lit("")), c, runs(c, 2), runs(c, 3))), short))
    hits = said.join(pairs, F.col(key).eqNullSafe(F.col("_k")) & F.contains("said", "lit")).select(key, "n")
    return hits.unionByName(documents.select(key, F.lit(0).cast("bigint").alias("n"))).groupBy(key).agg(F.sum("n").alias("forbidden"))


def run_telemetry(trace: DataFrame, by: list[str]) -> DataFrame:
    """A4: call and pixel counters of a run's trace: image_scope, image_count, image_pixels, source_page_pixels, action, target_ids."""
    image, crop = F.col("image_count") > 0, F.col("image_scope") == "crop_batch"
    repair = ~F.col("action").isin("page_draft", "page_plan") & (F.size("target_ids") > 0)
    ratio = F.when(image & (F.col("source_page_pixels") > 0), F.col("image_pixels") / F.col("source_page_pixels"))
    return trace.groupBy(*by).agg(
        F.count_if(image & (F.col("image_scope") == "full_page")).alias("full_page_calls"), F.count_if(image & crop).alias("crop_calls"), F.sum(F.when(image, F.col("image_pixels")).otherwise(0)).alias("image_pixels"), F.sum(F.when(image & crop, F.col("image_pixels")).otherwise(0)).alias("crop_pixels"),
        F.coalesce(F.sum(ratio), F.lit(0.0)).alias("full_page_equivalents"), F.count_if(repair).alias("repair_calls"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(repair, F.col("target_ids")))))).alias("repaired_targets"),
    )


def retrieve(elements: DataFrame, question: str, by: list[str], k: int = 40, budget: int = 48_000) -> DataFrame:
    """The k best elements by shared terms, likeness and being a heading, with their neighbours, in order, up to a size. elements: idx, type, text."""
    terms = sorted(set(re.findall(r"[\w-]{2,}", question.casefold())))
    said = text.casefold(F.col("text"))
    overlap = sum((F.contains(said, F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = overlap * 10 + text.ratio(F.lit(question.casefold()), F.substring(said, 1, 500)) + F.when(F.col("type").isin("heading", "title"), 0.25).otherwise(0.0)
    best = windows.numbering(elements.withColumn("score", score), by, [F.col("score").desc(), F.col("idx").desc()], "rank").where(F.col("rank") <= k)
    near = joins.neighbour_expansion(best, elements, by, "idx")
    size = F.sum(F.length("text") * 2 + 64).over(Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used", size).where(F.col("used") <= budget)


def citations(cited: DataFrame, elements: DataFrame, by: list[str]) -> DataFrame:
    """Cited elements that are known, with page and text."""
    return cited.join(elements.select(*by, "element_id", "page", "text"), [*by, "element_id"])


def history_tail(history: Column, most: int = 16) -> Column:
    """L14."""
    n = F.least(F.lit(most), F.size(history))
    return F.when(n > 0, F.slice(history, F.size(history) - n + 1, n)).otherwise(history)


def toc(sections: DataFrame, by: list[str]) -> DataFrame:
    """Distinct sections (element, folded title, page) ordered by page and element order, unknown orders last, each with its parent."""
    first = sections.groupBy(*by, "element_id", F.lower("title").alias("folded"), "page").agg(F.min_by(F.struct("title", "level", "order"), "seq").alias("x")).select(*by, "element_id", "page", "x.*")
    ordered = windows.numbering(first, by, ["page", F.col("order").asc_nulls_last(), "element_id"], "n")
    return windows.heading_parents(ordered, by, "n", "level")


def form_priority() -> Column:
    """Forms by how much they ask for recovery; null means no. Columns: type, options, text."""
    return F.when(~F.col("type").isin("table", "form"), F.lit(None).cast("int")).when(F.col("options") >= 2, 0).when(F.col("type") == "form", 1).when(F.col("text").rlike(r"(?i)<table\b") & (F.regexp_count("text", F.lit(":")) >= 4), 2)


def recovery_content(regions: DataFrame, by: list[str]) -> DataFrame:
    """P25: the longest table if there is one (the first of equals), else all texts by line."""
    full = text.squash(F.col("content")) != ""
    table = F.max_by("content", F.when((F.lower("label") == "table") & full, F.struct(F.length("content"), -F.col("idx"))))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(full, F.struct("idx", "content")))), lambda x: x["content"]), "\n")
    return regions.groupBy(*by).agg(F.coalesce(table, rest).alias("content"))


def candidate_tables(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Tables that are not rejected with their place among the page's tables, from 0."""
    return windows.numbering(active(blocks).where("type = 'table'"), by, ["reading_order", "block_id"], "n").withColumn("ordinal", F.col("n") - 1).drop("n")


def reference_basis(requested: Column, annotated: Column, explicit: Column, synthetic: Column) -> Column:
    """P28."""
    return F.coalesce(requested, F.when(~explicit, annotated), F.when(~explicit & synthetic, "synthetic_exact"), F.lit("generated"))


def route_key(c: Column) -> Column:
    """``page:route`` pairs of a composite key as a map, null unless every pair reads."""
    parts = F.split(c, ",")
    ok = F.forall(parts, lambda p: p.rlike(r"^\s*\d+\s*:\s*\w+\s*$"))
    return F.when(ok, F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).cast("int"), F.trim(F.substring_index(p, ":", -1))))))


def marked_text(spans: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """Texts with an element mark before each emitted span."""
    edits = spans.select(*by, F.col("start"), F.col("start").alias("end"), F.concat(F.lit("<!-- element:"), F.col("element_id"), F.lit(" -->")).alias("new"))
    return joins.apply_replacements(texts, edits, by)


def residual_lines(lines: DataFrame, structure: DataFrame, by: list[str]) -> DataFrame:
    """Lines that the structure does not already say, counting repeats. lines: pos, line; structure: line."""
    key = lambda c: F.array_join(F.transform(F.split(F.regexp_replace(c, r"^[ |]+|[ |]+$", ""), r"\|"), lambda p: text.squash(p)), "|")
    own = lines.withColumn("key", key(F.col("line"))).withColumn("nth", F.row_number().over(Window.partitionBy(*by, "key").orderBy("pos")))
    held = structure.groupBy(*by, key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("held"))
    return own.join(held, [*by, "key"], "left").where((F.col("nth") > F.coalesce("held", F.lit(0))) & (F.trim("line") != "")).select(*by, "pos", F.trim("line").alias("line"))


def redundant(candidate: Column, existing: Column) -> Column:
    """whether a recovery says, in order, only what its neighbours say."""
    return text.ordered_subsequence(text.recovery_tokens(candidate), text.recovery_tokens(existing))


def conflicts(candidate: Column, neighbours: Column) -> Column:
    """new critical literals in a text that also repeats a neighbour (array of texts) in order."""
    fresh = F.size(F.array_except(text.critical_values(candidate), text.critical_values(F.array_join(neighbours, " ")))) > 0
    return fresh & F.exists(neighbours, lambda n: text.ordered_subsequence(text.recovery_tokens(n), text.recovery_tokens(candidate)))


def native_document(records: DataFrame, by: str = "path") -> DataFrame:
    """Scan records as numbered elements with offsets in the document's text (non-empty texts joined by a line end)."""
    r = records.where("kind = 'record'").withColumn("unit_no", F.regexp_extract("unit_id", r"(\d+)$", 1).cast("int"))
    n = windows.numbering(r, [by], ["unit_no", "seq"], "element_order")
    return windows.running_offsets(n, [by], ["element_order"], "text").select(by, "element_order", "unit_id", "type", "text", "anchor", "start", "end")


def base_text(native: DataFrame, by: str = "path") -> DataFrame:
    """The text that native elements' offsets refer to."""
    said = F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("element_order", "text"))))
    return native.groupBy(by).agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("base_text"))


def scan_quality(histogram: Column, edge_variance: Column, blank: float = 0.005, sharp: float = 100.0, contrast: int = 40) -> Column:
    """Blank, blurred and flat pages from a grey histogram (256 counts) and an edge variance, which a pixel reader supplies."""
    step = lambda a, x: a + x

    def levels(h: Column, total: Column) -> Column:
        """How far the counts up to a grey lie below 5 and 95 per cent of all."""
        more = lambda i, s, q: F.when(s < total * q, i + 1).otherwise(i)
        return F.aggregate(h, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("j")), lambda a, x: F.struct((a["s"] + x).alias("s"), more(a["i"], a["s"] + x, 0.95).alias("i"), more(a["j"], a["s"] + x, 0.05).alias("j")), lambda a: a["i"] - a["j"])

    def problems(h: Column, dark: Column, total: Column) -> Column:
        return F.array_compact(F.array(F.when(dark / total <= blank, "blank"), F.when(edge_variance < sharp, "blur"), F.when(levels(h, total) < contrast, "low contrast")))

    # the histogram and its sums are made once a page, not once a level of grey
    return text.bound(histogram, lambda h: text.bound(F.aggregate(F.slice(h, 1, 245), F.lit(0.0), step), lambda dark: text.bound(F.aggregate(F.slice(h, 246, 11), dark, step), lambda total: problems(h, dark, total))))
