"""Regions and blocks: normalising, both directions between them, fragments, scorecards and stored results
(P4, P9, P16, P17, F9, F22, F24, F28, F30, V7, V8, V15, V17, V20, A16, C11).

Regions are structs of columns, so all of it is column expressions or joins; tables of HTML are cut into cells a batch of tables at a time.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry, text
from . import folds, joins

# fixed values: detector labels by region type, and the marks of a form
TABLE_LABELS = ("table",)
FORMULA_LABELS = ("display_formula", "inline_formula", "formula")
VISUAL_LABELS = ("image", "chart", "figure")
ROTATED_LABELS = ("vertical_text", "rotated_text")
TEXT_LABELS = ("text", "title", "doc_title", "paragraph_title", "paragraph", "header", "footer", "caption", "figure_title", "list", "reference", "reference_content", "abstract", "content", "vision_footnote", "footnote", "seal", "formula_number")
FORM_MARKS = "[☐☑□✓]"
SECURITY_NAMES = ("security", "threat-model", "threat_model")


def region_type(label: Column, content: Column) -> Column:
    """Type by label; a text with two colons or a box mark is a form."""
    l = F.lower(label)
    form = (F.length(content) - F.length(F.replace(content, F.lit(":"), F.lit(""))) >= 2) | content.rlike(FORM_MARKS)
    known = {"table": TABLE_LABELS, "formula": FORMULA_LABELS, "figure": VISUAL_LABELS, "rotated_text": ROTATED_LABELS}
    kind = reduce(lambda w, kv: w.when(l.isin(*kv[1]), kv[0]), known.items(), F)
    return kind.when(l.isin(*TEXT_LABELS), F.when(form, "form").otherwise("text")).otherwise("unknown")


def region_rotation(label: Column, polygon: Column, width: Column, height: Column) -> Column:
    """Degrees of the polygon's first edge on the rendered page; without one, 90 for labels of rotated text."""
    a, b = F.get(polygon, F.lit(0)), F.get(polygon, F.lit(1))
    edge = F.degrees(F.atan2((b["y"] - a["y"]) * height, (b["x"] - a["x"]) * width))
    return F.when(F.size(polygon) >= 2, edge).when(F.lower(label).isin(*ROTATED_LABELS), 90.0).otherwise(0.0)


def normalised_regions(raw: DataFrame, skew: float = 1.0) -> DataFrame:
    """Raw regions (label, content, polygon, x0..y1 in the unit square or per mille, width, height) with type, rotation, complexity and an ordered box in the unit square."""
    box = geometry.ordered_unit_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    out = raw.withColumn("type", region_type(F.col("label"), F.coalesce("content", F.lit("")))).withColumn("rotation", region_rotation(F.col("label"), F.col("polygon"), F.col("width"), F.col("height")))
    kind = F.col("type")
    complexity = F.when(kind.isin("table", "form", "formula"), "structured").when(kind == "figure", "visual").when(F.abs("rotation") >= skew, "rotated").otherwise("simple_text")
    return out.withColumn("complexity", complexity).withColumn("box", box)


def blocks_of_regions(regions: DataFrame) -> DataFrame:
    """Drafts (page, idx, type, text, box, confidence, part_confidences, invalid_spans) as blocks: cleaned text, least known confidence, a form's label and value, and why a block needs review."""
    said = F.coalesce(text.clean_text(F.col("text")), F.lit(""))
    bad_box = F.col("box").isNotNull() & ~geometry.valid(F.col("box"))
    reason = F.when(bad_box, "invalid box").when(F.col("invalid_spans"), "invalid confidence evidence")
    label, has_value = F.trim(F.substring_index("text", ":", 1)), F.contains("text", F.lit(":"))
    form = F.col("type") == "form_field"
    return (
        regions.withColumn("text", said).withColumn("block_id", F.concat(F.lit("p"), F.col("page"), F.lit("-b"), F.col("idx") + 1))
        .withColumn("confidence", F.least("confidence", F.array_min(F.array_compact("part_confidences"))))
        .withColumn("form_label", F.when(form, F.when(label == "", "Field").otherwise(label))).withColumn("form_value", F.when(form & has_value, F.trim(F.expr("substring(text, instr(text, ':') + 1)"))))
        .withColumn("status", F.when(reason.isNotNull(), "needs_review").otherwise("pending")).withColumn("reason", reason)
        .withColumn("box", F.when(~bad_box, F.col("box"))).drop("idx", "part_confidences", "invalid_spans")
    )


def regions_of_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as drafts again: page, idx, type, text, box, confidence; what only blocks have goes."""
    idx = F.regexp_extract("block_id", r"-b(\d+)$", 1).cast("int") - 1
    return blocks.select("page", idx.alias("idx"), "type", "text", "box", "confidence")


def model_context(blocks: DataFrame, by: str) -> DataFrame:
    """The compact layout a model is given: one JSON a document, blocks (block_id, type, page, reading_order, text, atoms) by page and order."""
    one = F.struct("page", "reading_order", F.col("block_id").alias("id"), "type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("atoms", F.array().cast("array<struct<id:string,text:string>>")).alias("atoms"))
    return blocks.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("layout"))


# fixed value: a label that stands twice before a dash
REPEATED_LABEL = r"(?i)^([^\n–—]{1,80}?)(\s+[–—-]\s+)\1\2"


def _bare(c: Column) -> Column:
    """A text without white space at its start."""
    return F.regexp_replace(c, rf"(?U)\A{text.WHITE}+", "")


def _quoted(c: Column) -> Column:
    """A literal as a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def without_marker(body: Column, kind: Column, marker: Column) -> Column:
    """a label said twice before a dash is said once; a list item does not begin with its own marker, which may be several words."""
    once = F.regexp_replace(body, REPEATED_LABEL, "$1$2")
    m = F.regexp_replace(_bare(marker), rf"(?U){text.WHITE}+\z", "")
    one = F.concat(F.lit("(?iuU)\\A"), _quoted(m), F.lit(rf"(?={text.WHITE}|\z){text.WHITE}*"))
    left = F.regexp_replace(once, F.concat(one, F.lit("(?:"), F.substr(one, F.lit(9)), F.lit(")*")), F.lit(""))
    return F.when((kind == "list_item") & F.coalesce(m != "", F.lit(False)), left).otherwise(once)


def has_marker(body: Column, marker: Column) -> Column:
    """whether the text begins with the marker as a word, case and white space before it aside."""
    return F.regexp_like(_bare(body), F.concat(F.lit("(?iuU)\\A"), _quoted(marker), F.lit(rf"(?={text.WHITE}|\z)")))


def checkbox_mark(state: Column) -> Column:
    """F28."""
    return F.when(state == "checked", "[x]").when(state == "unchecked", "[ ]").otherwise("[?]")


def checkbox_text(option: Column, body: Column) -> Column:
    """the option, with the text behind it where that says more."""
    o, b = F.coalesce(option, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when((o != "") & (b != "") & (o != b), F.concat(o, F.lit(": "), b)).when(o != "", o).otherwise(b)


# what Python's str.splitlines() splits at
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def lines(c: Column) -> Column:
    """The lines of a text; one end of line at its end opens no other line."""
    said = F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END)
    return F.when(F.length(c) > 0, said).otherwise(F.array().cast("array<string>"))


def line_key(c: Column) -> Column:
    """a line without bars and blanks around it, white space squashed between its bars."""
    return F.array_join(F.transform(F.split(F.regexp_replace(c, r"^[ |]+|[ |]+$", ""), r"\|"), lambda p: text.squash(p)), "|")


def residual(body: Column, represented: Column) -> Column:
    """the stripped lines of a text that a bag of line keys does not say, counting repeats, in order. represented: map of key to count."""
    def kept(own: Column, keys: Column, held: Column) -> Column:
        again = lambda k, i: F.size(F.filter(F.slice(keys, 1, i + 1), lambda x: x == k))
        new = F.filter(F.transform(own, lambda l, i: F.when(again(F.get(keys, i), i) > F.coalesce(F.try_element_at(held, F.get(keys, i)), F.lit(0)), l)), lambda l: l.isNotNull())
        return F.filter(F.transform(new, lambda l: F.regexp_replace(_bare(l), rf"(?U){text.WHITE}+\z", "")), lambda l: l != "")

    return text.bound(represented, lambda held: text.bound(lines(body), lambda own: text.bound(F.transform(own, line_key), lambda keys: kept(own, keys, held))))


def _bag(keys: Column) -> Column:
    """A map of each key to its number."""
    return text.bound(keys, lambda ks: F.map_from_entries(F.transform(F.array_distinct(ks), lambda k: F.struct(k, F.size(F.filter(ks, lambda x: x == k))))))


def _most(*bags: Column) -> Column:
    """The union of bags: of each key its largest number."""
    return text.bound(F.array(*bags), lambda bs: F.map_from_entries(F.transform(F.array_distinct(F.flatten(F.transform(bs, lambda b: F.map_keys(b)))), lambda k: F.struct(k, F.array_max(F.transform(bs, lambda b: F.coalesce(F.try_element_at(b, k), F.lit(0))))))))


@lru_cache(1 << 12)
def _key(line: str) -> str:
    """``line_key`` of a text."""
    return "|".join([" ".join(p.split()) for p in line.strip(" |").split("|")])


def table_lines(cells: list[tuple]) -> dict[str, int]:
    """line keys that a table says, with their numbers: lines of its cells, cells of several lines in one, and rows; of each its largest
    number. cells: row, column, text, the text in one line."""
    by_cell, flat, rows = Counter(), Counter(), {}
    for _, _, said, _ in cells:
        full = [l for l in (said or "").splitlines() if l and not l.isspace()]
        by_cell.update(map(_key, full))
        if len(full) > 1:
            flat[_key(" ".join(full))] += 1
    for row, _, _, line in sorted(cells, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or 0, c[3])):
        rows.setdefault(row, []).append(line)
    return by_cell | flat | Counter([_key(" | ".join(said)) if row is not None else "" for row, said in rows.items()])


@F.arrow_udf(T.ArrayType(T.StringType()))
def table_fragments(body: pa.Array, cells: pa.Array) -> pa.Array:
    """F30 of tables: the texts of the cells, each in one line, and the stripped lines of the body that ``table_lines`` does not say, counting
    repeats, in order. One pass over cells and lines. cells: array of row, col, text."""
    row, col, said = [f.to_pylist() for f in (cells.flatten().flatten() if len(cells) else [pa.array([])] * 3)]
    sizes, at, out = pc.fill_null(pc.list_value_length(cells), 0).to_pylist(), 0, []
    for text_, size in zip(body.to_pylist(), sizes):
        own = slice(at, at + size)
        at += size
        lines_ = [" ".join((t or "").replace("\r", " ").splitlines()) for t in said[own]]
        held, left = table_lines(list(zip(row[own], col[own], said[own], lines_))), []
        for line in (text_ or "").splitlines():
            key = _key(line)
            n = held.get(key, 0)
            if n:
                held[key] = n - 1
            elif kept := line.strip():
                left.append(kept)
        out.append(lines_ + left)
    return pa.array(out, pa.list_(pa.string()))


def form_lines(form: Column) -> Column:
    """line keys that a form field says: its parts, and its label with its value or hint."""
    label = F.regexp_replace(F.regexp_replace(form["label"], rf"(?U){text.WHITE}+\z", ""), r":\z", "")
    parts = F.flatten(F.transform(F.array_compact(F.array(form["label"], form["value"], form["hint"])), lambda c: F.transform(F.filter(lines(c), lambda l: text.squash(l) != ""), line_key)))
    with_ = lambda c: F.when(F.length(c) > 0, F.array(line_key(F.concat(form["label"], F.lit(" "), c)), line_key(F.concat(label, F.lit(": "), c)))).otherwise(F.array().cast("array<string>"))
    both = F.concat(F.array(line_key(F.concat(label, F.lit(":")))), with_(form["value"]), with_(form["hint"]))
    return _most(_bag(parts), _bag(both))


def fragments(kind: Column, body: Column, cells: Column, form: Column, checkbox: Column, visual: Column, marker: Column) -> Column:
    """the distinct non-empty pieces a block says, in order; of tables and forms also the lines of the text that they leave out.
    cells: array of row, col, text; form: struct label, value, hint; checkbox: struct state, group, option; visual: array of texts."""
    label = F.regexp_replace(F.regexp_replace(form["label"], rf"(?U){text.WHITE}+\z", ""), r":\z", "")
    said = (
        F.when((kind == "table") & (F.size(cells) > 0), table_fragments(F.when(kind == "table", body), F.when(kind == "table", F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["text"].alias("text"))))))
        .when((kind == "form_field") & form.isNotNull(), F.concat(F.array(label, form["value"], form["hint"]), residual(body, form_lines(form))))
        .when(kind == "checkbox", F.array(checkbox_mark(checkbox["state"]), checkbox["group"], checkbox["option"], body))
        .when(kind.isin("figure", "image", "chart"), F.concat(F.array(body), F.coalesce(visual, F.array().cast("array<string>"))))
        .when(kind == "list_item", F.array(body, F.coalesce(F.nullif(marker, F.lit("")), F.lit("-")))).otherwise(F.array(body))
    )
    return F.array_distinct(F.filter(said, lambda x: F.coalesce(x, F.lit("")) != ""))


def unresolved_severity(states: Column) -> Column:
    """0 for four or more options without a state, 1 for two or three, 2 for one, null for none."""
    n = F.size(F.filter(states, lambda s: s.isNull()))
    return F.when(n >= 4, 0).when(n >= 2, 1).when(n == 1, 2)


# closed rows and cells of HTML: what they hold is read from mark to mark and never given back, so that each is read once
HTML_ROW = re.compile(r"(?ais)<tr(?u:\b)[^>]*+>((?:[^<]++|<(?!tr(?u:\b)|/tr\s*>))*+)</tr\s*>")
HTML_CELL = re.compile(r"(?ais)<(td|th)(?u:\b)([^>]*+)>((?:[^<]++|<(?!t[dh](?u:\b)|/t[dh]\s*>))*+)</t[dh]\s*>")
_SPANS = [re.compile(rf"(?ai)(?:^|\s){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)") for name in ("rowspan", "colspan")]
_NUMBER = re.compile(r"[\"']? *\+?([0-9]{1,18}) *[\"']?")
_COMMENT, _BREAK, _TAG = re.compile(r"(?s)<!--.*?-->"), re.compile(r"(?ai)<br(?u:\b)[^>]*>"), re.compile(r"(?s)</?[a-zA-Z][^>]*>")


@lru_cache(1 << 12)
def _spans(attributes: str) -> tuple[int, int]:
    """Rows and columns of a cell: whole numbers of ASCII digits above 0, else 1."""
    given = [p.search(attributes) for p in _SPANS]
    numbers = [g and _NUMBER.fullmatch(g[1]) for g in given]
    return tuple(max(int(n[1]), 1) if n else 1 for n in numbers)


def _cell_text(body: str) -> str:
    """What a cell says: no comments and tags, entities resolved, white space squashed."""
    if "<" in body:
        body = _TAG.sub("", _BREAK.sub("\n", _COMMENT.sub("", body)))
    return " ".join((html.unescape(body) if "&" in body else body).split())


_CELL = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("row_span", pa.int64()), ("col_span", pa.int64()), ("header", pa.bool_()), ("text", pa.string())])


def _cut(tables: DataFrame, key: str, column: str, at: str) -> DataFrame:
    """The cells of closed rows of each row's table; ``at`` is seq, the cell's number in its row, or column, its first one on the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(keys: pa.Array, owners: list[int], cells: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int64())), *[pa.array(c, f.type) for c, f in zip(zip(*cells), _CELL)]], names=[key, *names])

        for batch in batches:
            owners, cells = [], []
            for i, said in enumerate(batch.column(1).to_pylist()):
                grid = folds.Grid()
                for row, r in enumerate(HTML_ROW.finditer(said or "")):
                    for seq, c in enumerate(HTML_CELL.finditer(r[1])):
                        kind, attributes, body = c.groups()
                        down, across = _spans(attributes)
                        owners.append(i)
                        cells.append((row, seq if at == "seq" else grid.place(row, down, across), down, across, kind in ("th", "TH", "Th", "tH"), _cell_text(body)))
                    if len(cells) >= 1 << 14:
                        yield batch_of(batch.column(0), owners, cells)
                        owners, cells = [], []
            if cells:
                yield batch_of(batch.column(0), owners, cells)

    names = [at if n == "at" else n for n in _CELL.names]
    return tables.select(key, column).mapInArrow(run, f"`{key}` {dict(tables.dtypes)[key]}, row bigint, {at} bigint, row_span bigint, col_span bigint, header boolean, text string")


def html_cells(tables: DataFrame, key: str, column: str) -> DataFrame:
    """key, row, seq, row_span, col_span, header, text of the cells of closed rows; a row or cell that is never closed has none."""
    return _cut(tables, key, column, "seq").withColumn("seq", F.col("seq").cast("int"))


def html_grid(tables: DataFrame, key: str, column: str) -> DataFrame:
    """Cells of HTML tables on their grid: key, row, column, row_span, col_span, header, text. Each row of ``tables`` is a table of its own,
    and its cells are placed as they are cut, so none is shuffled."""
    return _cut(tables, key, column, "column")


def missing_boxes(drafts: DataFrame, by: list[str]) -> DataFrame:
    """V8: boxes that a provider left out, of regions and of their cells and atoms (arrays of structs with box)."""
    lost = lambda c: F.size(F.filter(c, lambda x: x["box"].isNull()))
    n = F.col("box").isNull().cast("int") + F.coalesce(lost("cells"), F.lit(0)) + F.coalesce(lost("atoms"), F.lit(0))
    return drafts.groupBy(*by).agg(F.sum(n).alias("n_missing"))


RESULT = "kind string, document string, markdown string, input_tokens bigint, output_tokens bigint, base_markdown string"


def stored_result(kind: Column, document: Column, markdown: Column, input_tokens: Column, output_tokens: Column, base_markdown: Column) -> Column:
    """A result as JSON; only legacy ones have a base text."""
    base = F.when(kind != "native-v5", base_markdown)
    return F.to_json(F.struct(kind.alias("kind"), document.alias("document"), markdown.alias("markdown"), input_tokens.alias("input_tokens"), output_tokens.alias("output_tokens"), base.alias("base_markdown")))


def read_result(stored: Column) -> Column:
    """The struct of a stored result by its kind: counters of native ones default to 0, a legacy one's base text to none."""
    r = F.from_json(stored, RESULT)
    native = r["kind"] == "native-v5"
    count = lambda c: F.when(native, F.coalesce(r[c], F.lit(0))).otherwise(r[c]).alias(c)
    return F.struct(r["kind"].alias("kind"), r["document"].alias("document"), r["markdown"].alias("markdown"), count("input_tokens"), count("output_tokens"), F.when(~native, F.coalesce(r["base_markdown"], F.lit(""))).alias("base_markdown"))


def profile_categories(rows: DataFrame) -> DataFrame:
    """Drafted rows (key, description, extract, schema_name) as categories; rows that say nothing go."""
    plain = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("key", "description", "schema_name")}
    extract = F.coalesce("extract", F.lit(False))
    said = reduce(lambda a, b: a | b, [c != "" for c in plain.values()]) | extract
    return rows.where(said).withColumns({"key": plain["key"], "description": plain["description"], "schema_name": F.nullif(plain["schema_name"], F.lit("")), "extract": extract})


def refreshed_articles(articles: DataFrame, snapshot: str) -> DataFrame:
    """Articles (path, text) with their first snapshot line set, their second-level headings and whether their name marks them as security documents."""
    line = r"(?m)^snapshot:[ \t]*.*$"
    found = F.regexp_instr("text", F.lit(line))
    updated = F.when(found > 0, F.concat(F.substring(F.col("text"), F.lit(1), found - 1), F.lit(f"snapshot: {snapshot}"), F.substring(F.col("text"), found + F.length(F.regexp_extract("text", line, 0)), F.length("text")))).otherwise(F.col("text"))
    name = F.lower(F.substring_index("path", "/", -1))
    return articles.select("path", updated.alias("text"), F.regexp_extract_all("text", F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1)).alias("headings"), reduce(lambda a, b: a | b, [F.contains(name, F.lit(m)) for m in SECURITY_NAMES]).alias("is_security"))


def scorecard(documents: DataFrame, metrics: dict[str, DataFrame], by: str) -> DataFrame:
    """One row a document with a struct for each metric frame and, where it has no row, why: its frame had nothing for the document."""
    out = documents
    for name, frame in metrics.items():
        parts = [c for c in frame.columns if c != by]
        out = out.join(frame.select(by, F.struct(*parts).alias(name)), by, "left")
    return out.withColumn("unavailable", F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in metrics])))


def processed_page(blocks: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """C11: a page's blocks through its keyed updates: a group whose decisions do not answer its requests one to one keeps its blocks for review, others take their decisions; then duplicates go.

    blocks: id, type, text, status, evidence_ref, reading_order, fingerprint, x0..y1, confidence; decisions: id, evidence_ref, action, confidence, text."""
    asked = blocks.where(F.col("status") == "needs_review")
    gate = joins.decision_gate(asked.select(*by, "id", "evidence_ref"), decisions.select(*by, "id", "evidence_ref"), by).select(*by, "accepted")
    decided = joins.apply_decisions(blocks, decisions.join(gate.where("accepted"), by, "left_semi").select(*by, "id", "action", "confidence", "text"), by)
    ready = decided.withColumn("rejected", F.col("status") == "rejected").withColumn("verified", F.col("status").isin("verified", "corrected"))
    return folds.block_dedup(ready, by).drop("rejected", "verified")


@dataclass(frozen=True)
class Thresholds:
    """V7: analysis settings; ratios lie in 0..1, sizes are not negative, counts are positive. ``of`` reads overrides from an environment."""

    blank_foreground_ratio: float = 0.005
    table_form_area_ratio: float = 0.15
    visual_area_ratio: float = 0.5
    skew_degrees: float = 1.0
    min_edge_variance: float = 100.0
    min_contrast_range: float = 40.0
    min_short_edge_pixels: int = 1
    complex_region_count: int = 1

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            good = 0 <= v <= 1 if f.name.endswith("_ratio") else v > 0 if isinstance(f.default, int) else v >= 0
            if not good:
                raise ValueError(f"{f.name} is out of range: {v}")

    @classmethod
    def of(cls, environment: dict[str, str], prefix: str = "FOLIOFLOW_") -> Thresholds:
        return cls(**{f.name: type(f.default)(environment[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in environment})
