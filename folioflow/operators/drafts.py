"""Drafts of a page as blocks and back, with cells, atoms and the doubtful spans of both.

A draft row holds its parts as arrays of structs, so all of it is one projection: texts lose the removed code points, spans move
to where their text stands then, and what cannot be placed makes the block need review.

drafts: by, page, idx, type, text, box, reading_order, confidence, heading_level, list_marker, cells (row, col, text, row_span, col_span,
header, box, confidence, spans), form (label, value, hint), checkbox (state, group, option), caption, description, chart_type, chart
(label, value, series), atoms (kind, text, box, confidence, spans); spans: start, end, text, confidence, source, box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = f"struct<start:int,end:int,text:string,confidence:double,source:string,box:{BOX}>"
CELL = f"struct<row:int,col:int,text:string,row_span:int,col_span:int,header:boolean,box:{BOX},confidence:double,spans:array<{SPAN}>>"
ATOM = f"struct<kind:string,text:string,box:{BOX},confidence:double,spans:array<{SPAN}>>"
DRAFT = (
    f"page int, idx int, type string, text string, box {BOX}, reading_order int, confidence double, heading_level int, list_marker string, cells array<{CELL}>, form struct<label:string,value:string,hint:string>, "
    f"checkbox struct<state:string,group:string,option:string>, caption string, description string, chart_type string, chart array<struct<label:string,value:string,series:string>>, atoms array<{ATOM}>"
)
BAD_BOX, BAD_SPANS = "invalid box", "invalid confidence evidence"


def _good_box(box: Column) -> Column:
    """The box, null where it is none."""
    return F.when(geometry.valid(box), box)


def _tail(c: Column, start: Column, end: Column) -> Column:
    return F.substring(c, start + 1, end - start)


def placed_spans(said: Column, spans: Column, confidence: Column, box: Column, source: str = "provider") -> Column:
    """struct of spans (in the cleaned text, by place) and bad (whether one was dropped).

    Dropped are spans outside the text, that begin before the end of the last one kept, that hold a removed code point, or whose own
    text is another one. A span without a confidence, source or box takes its owner's.
    """
    n = F.length(said)
    inside = F.filter(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")), lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n))
    ordered = F.array_sort(inside, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))
    at = lambda offset: text.clean_offset(said, offset)

    def put(s: Column) -> Column:
        """A span at its new place, null if its text is not what stands there."""
        raw = _tail(said, s["start"], s["end"])
        plain = text.clean_text(raw)
        good = (F.length(plain) == F.length(raw)) & (s["text"].isNull() | (text.clean_text(s["text"]) == plain))
        moved = F.struct(at(s["start"]).alias("start"), at(s["end"]).alias("end"), plain.alias("text"), F.coalesce(s["confidence"], confidence).alias("confidence"), F.coalesce(F.nullif(s["source"], F.lit("")), F.lit(source)).alias("source"), F.coalesce(s["box"], box).alias("box"))
        return F.when(good, moved.cast(SPAN))

    state = f"struct<last:int,kept:array<{SPAN}>>"

    def step(acc: Column, s: Column) -> Column:
        new = F.when(s["start"] >= acc["last"], put(s))
        return text.bound(new, lambda x: F.when(x.isNull(), acc).otherwise(F.struct(s["end"].alias("last"), F.array_append(acc["kept"], x).alias("kept")).cast(state)))

    kept = F.aggregate(ordered, F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{SPAN}>").alias("kept")).cast(state), step, lambda acc: acc["kept"])
    return text.bound(kept, lambda k: F.struct(k.alias("spans"), (F.size(k) < F.coalesce(F.size(spans), F.lit(0))).alias("bad")))


def _part(p: Column, fields: tuple[str, ...], block_confidence: Column) -> Column:
    """A cell or atom with cleaned text, placed spans, a box or none, and bad."""
    box, said = _good_box(p["box"]), F.coalesce(p["text"], F.lit(""))
    own = {f: p[f] for f in fields} | {"text": text.clean_text(said), "box": box}
    return text.bound(placed_spans(said, p["spans"], F.coalesce(p["confidence"], block_confidence), box), lambda s: F.struct(*[own[f].alias(f) for f in fields], s["spans"].alias("spans"), s["bad"].alias("bad")))


CELL_FIELDS = ("row", "col", "text", "row_span", "col_span", "header", "box", "confidence")
ATOM_FIELDS = ("kind", "text", "box", "confidence")


def _without_bad(parts: Column, kind: str, fields: tuple[str, ...]) -> Column:
    return F.transform(parts, lambda p: F.struct(*[p[f].alias(f) for f in fields], p["spans"].alias("spans")).cast(kind))


def to_blocks(drafts: DataFrame) -> DataFrame:
    """Drafts as blocks: block_id, status (needs_review or pending) and reason beside what the draft holds."""
    clean = text.clean_text
    bad_box = F.col("box").isNotNull() & ~F.coalesce(geometry.valid(F.col("box")), F.lit(False))
    table, form = F.col("type") == "table", F.col("type") == "form_field"
    said = F.coalesce(clean(F.col("text")), F.lit(""))
    label = F.trim(F.substring_index(said, ":", 1))
    guessed = F.struct(F.when(label == "", "Field").otherwise(label).alias("label"), F.when(F.contains(said, F.lit(":")), F.trim(F.substr(said, F.instr(said, ":") + 1))).alias("value"), F.lit(None).cast("string").alias("hint"))
    given = F.struct(F.coalesce(clean(F.col("form.label")), F.lit("")).alias("label"), clean(F.col("form.value")).alias("value"), clean(F.col("form.hint")).alias("hint"))
    known = F.array_compact(F.concat(F.array("confidence"), *[F.coalesce(F.transform(c, lambda p: p["confidence"]), F.array().cast("array<double>")) for c in ("cells", "atoms")]))
    out = drafts.withColumn("_cells", F.when(table, F.transform(F.coalesce("cells", F.array().cast(f"array<{CELL}>")), lambda c: _part(c, CELL_FIELDS, F.col("confidence")))))
    out = out.withColumn("_atoms", F.transform(F.coalesce("atoms", F.array().cast(f"array<{ATOM}>")), lambda a: _part(a, ATOM_FIELDS, F.col("confidence"))))
    bad = F.coalesce(F.exists("_cells", lambda c: c["bad"]), F.lit(False)) | F.exists("_atoms", lambda a: a["bad"])
    reason = F.when(bad_box, BAD_BOX).when(bad, BAD_SPANS)
    chart = F.transform("chart", lambda p: F.struct(F.coalesce(clean(p["label"]), F.lit("")).alias("label"), F.coalesce(clean(p["value"]), F.lit("")).alias("value"), clean(p["series"]).alias("series")))
    return out.withColumns(
        {
            "block_id": F.concat(F.lit("p"), "page", F.lit("-b"), F.col("idx") + 1), "text": said, "box": F.when(~bad_box, F.col("box")), "confidence": F.array_min(known),
            "form": F.when(form, F.when(F.col("form").isNotNull(), given).otherwise(guessed)), "caption": clean(F.col("caption")), "description": clean(F.col("description")), "chart_type": clean(F.col("chart_type")), "chart": chart,
            "cells": _without_bad(F.col("_cells"), CELL, CELL_FIELDS), "atoms": _without_bad(F.col("_atoms"), ATOM, ATOM_FIELDS), "reason": reason, "status": F.when(reason.isNotNull(), "needs_review").otherwise("pending"),
        }
    ).drop("_cells", "_atoms", "idx")


def to_drafts(blocks: DataFrame) -> DataFrame:
    """Blocks as drafts again, whole; a block without cells has none. What only blocks have (id, status, reason) goes."""
    idx = F.regexp_extract("block_id", r"-b(\d+)$", 1).cast("int") - 1
    return blocks.withColumn("idx", idx).withColumn("cells", F.coalesce("cells", F.array().cast(f"array<{CELL}>"))).drop("block_id", "status", "reason")


def span_targets(blocks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row a doubtful span of a block's atoms and cells: target_id, owner_kind, owner_index, start, end, text, before, after, confidence."""
    def owners(parts: str, kind: str) -> Column:
        owned = lambda p, i: F.transform(p["spans"], lambda s, n: F.struct(F.lit(kind).alias("owner_kind"), i.alias("owner_index"), n.alias("span_index"), p["text"].alias("owner"), s.alias("s"), F.coalesce(s["confidence"], p["confidence"]).alias("c")))
        return F.flatten(F.transform(F.coalesce(F.col(parts), F.array().cast(blocks.schema[parts].dataType)), owned))

    each = blocks.select(*[c for c in blocks.columns if c not in ("cells", "atoms")], F.explode(F.concat(owners("cells", "table_cell"), owners("atoms", "atom"))).alias("t"))
    s, owner = F.col("t.s"), F.col("t.owner")
    known = F.coalesce("t.c", "confidence")
    around = lambda a, b: F.substring(owner, F.greatest(a, F.lit(0)) + 1, F.greatest(b - F.greatest(a, F.lit(0)), F.lit(0)))
    return each.where(known < threshold).select(
        "page", "block_id", F.concat_ws(":", "block_id", "t.owner_kind", "t.owner_index", "t.span_index").alias("target_id"), F.col("t.owner_kind").alias("owner_kind"), F.col("t.owner_index").alias("owner_index"),
        s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), around(s["start"] - 32, s["start"]).alias("before"), around(s["end"], s["end"] + 32).alias("after"), known.alias("confidence"),
    )
