"""Evidence, interval, spatial and matching joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry

BIN = 4096


def resolve_evidence(evidence: DataFrame, atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each cited id as an atom, else a block, else unknown. evidence: doc_id, pointer, ids; atoms, blocks: doc_id, id, text."""
    cited = evidence.select("doc_id", "pointer", F.posexplode("ids").alias("pos", "id"))
    a = atoms.select("doc_id", "id", F.col("text").alias("atom_text")).withColumn("is_atom", F.lit(True))
    b = blocks.select("doc_id", "id", F.col("text").alias("block_text")).withColumn("is_block", F.lit(True))
    j = cited.join(a, ["doc_id", "id"], "left").join(b, ["doc_id", "id"], "left")
    kind = F.when(F.col("is_atom"), "atom").when(F.col("is_block"), "block").otherwise("unknown")
    return j.select("doc_id", "pointer", "pos", "id", kind.alias("kind"), F.when(F.col("is_atom"), F.col("atom_text")).otherwise(F.col("block_text")).alias("text"))


def occurrence_match(left: DataFrame, right: DataFrame, key: list[str], order_left: list, order_right: list) -> DataFrame:
    """The n-th row of a key on one side takes the n-th of that key on the other; leftovers of either side show as nulls."""
    number = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return left.withColumn("nth", number(order_left)).join(right.withColumn("nth", number(order_right)), [*key, "nth"], "full")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """Pairs of half-open intervals (start, end and start2, end2) of one group that overlap.

    Each interval is put into the bins it touches and the join is by group and bin, so it is an equi-join; a pair is kept in the bin where
    the later of the two begins, which makes it appear once without a distinct.
    """
    cut = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bin_size))))
    j = cut(left, "start", "end").join(cut(right, "start2", "end2"), [*by, "_bin"])
    first = F.floor(F.greatest("start", "start2") / bin_size)
    return j.where((F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")) & (F.col("_bin") == first)).drop("_bin")


def merged_intervals(spans: DataFrame, by: list[str]) -> DataFrame:
    """Maximal runs of touching or overlapping intervals; one without a start is a run of its own, behind the others.

    Both windows read one sort, so that the order of equal intervals does not matter.
    """
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def covered(values: DataFrame, spans: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """Whether spans cover each value (id, start, end, text) but for white space. The gaps are looked at, not the characters: a value is
    covered if the parts of its text that no merged span holds are blank."""
    islands = merged_intervals(spans, by).select(*by, F.col("start").alias("start2"), F.col("end").alias("end2"))
    hit = overlap_join(values.select(*by, "id", "start", "end"), islands, by, bin_size).groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct("start2", "end2"))).alias("held"))
    j = values.join(hit, [*by, "id"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<start2:bigint,end2:bigint>>")))
    state = "struct<at:bigint,rest:string>"
    piece = lambda a, b: F.substring(F.col("text"), (a - F.col("start") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end2"]).alias("at"), F.concat(acc["rest"], piece(acc["at"], F.greatest(s["start2"], acc["at"]))).alias("rest")).cast(state)
    rest = F.aggregate("held", F.struct(F.col("start").cast("bigint").alias("at"), F.lit("").alias("rest")).cast(state), step, lambda acc: F.concat(acc["rest"], piece(acc["at"], F.col("end"))))
    return j.select(*by, "id", (F.regexp_replace(rest, r"\s", "") == "").alias("covered"))


def spatial_neighbours(boxes: DataFrame, by: list[str], cells: int = 8) -> DataFrame:
    """Pairs of different boxes of one page that intersect (id, other, overlap area).

    Boxes are put into the grid cells they touch; a pair counts in the cell of its intersection's corner. A page's boxes are few, and no page meets another.
    """
    grid = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("gx", F.explode(F.sequence(grid("x0"), grid("x1")))).withColumn("gy", F.explode(F.sequence(grid("y0"), grid("y1"))))

    a = spread(boxes.select(*by, "id", "x0", "y0", "x1", "y1"))
    b = spread(boxes.select(*by, F.col("id").alias("other"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")]).withColumnsRenamed({f"o{c}": c for c in ("x0", "y0", "x1", "y1")}))
    b = b.withColumnsRenamed({c: f"o{c}" for c in ("x0", "y0", "x1", "y1")})
    j = a.join(b, [*by, "gx", "gy"]).where(F.col("id") != F.col("other"))
    inter = F.greatest(F.least("x1", "ox1") - F.greatest("x0", "ox0"), F.lit(0.0)) * F.greatest(F.least("y1", "oy1") - F.greatest("y0", "oy0"), F.lit(0.0))
    corner = lambda p, q: F.least(F.floor(F.greatest(p, q) * cells), F.lit(cells - 1))
    return j.where((inter > 0) & (F.col("gx") == corner("x0", "ox0")) & (F.col("gy") == corner("y0", "oy0"))).select(*by, "id", "other", inter.alias("overlap"))


def key_differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only."""
    l, r = left.select(*key).distinct(), right.select(*key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("unused")))


def neighbour_expansion(selected: DataFrame, elements: DataFrame, by: list[str], index: str, reach: int = 1) -> DataFrame:
    """The selected elements with those within ``reach`` places."""
    wide = selected.select(*by, F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index)).distinct()
    return elements.join(wide, [*by, index], "left_semi")


def pages_of_segments(segments: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Pages inside each segment's range, as an equi-join on the exploded range."""
    wide = segments.withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    return wide.join(pages, [*by, "page"])


def decision_gate(requests: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """A group's decisions are accepted only if each request has exactly one decision with its evidence and nothing else is decided.
    requests: id, evidence_ref; decisions: id, evidence_ref."""
    d = decisions.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n"), F.min("evidence_ref").alias("given"))
    j = requests.withColumn("asked", F.lit(True)).join(d, [*by, "id"], "full")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(~F.col("given").eqNullSafe(F.col("evidence_ref")), "wrong evidence")
    j = j.withColumn("issue", issue)
    return j.groupBy(*by).agg(F.count("issue").alias("n_issues"), F.array_sort(F.collect_set("issue")).alias("issues")).withColumn("accepted", F.col("n_issues") == 0)


def apply_decisions(blocks: DataFrame, decisions: DataFrame, by: list[str], sure: float = 0.85) -> DataFrame:
    """Accept verifies, a sure correction replaces the text, reject rejects, anything else asks for review; undecided blocks stay."""
    j = blocks.join(decisions.select(*by, "id", "action", F.col("confidence").alias("_c"), F.col("text").alias("_t")), [*by, "id"], "left")
    corrected = (F.col("action") == "correct") & (F.col("_c") >= sure)
    state = F.when(F.col("action").isNull(), F.col("status")).when(F.col("action") == "accept", "verified").when(corrected, "corrected").when(F.col("action") == "reject", "rejected").otherwise("needs_review")
    return j.withColumn("text", F.when(F.coalesce(corrected, F.lit(False)), F.col("_t")).otherwise(F.col("text"))).withColumn("status", state).drop("action", "_c", "_t")


def apply_replacements(texts: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
    """Replacements (start, end, new) put into each text from right to left, so offsets stay true."""
    e = edits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "end", "new")), asc=False).alias("edits"))
    cut = lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["start"].cast("int")), x["new"], F.substring(acc, (x["end"] + 1).cast("int"), F.length(acc)))
    j = texts.join(e, by, "left")
    return j.withColumn("text", F.when(F.col("edits").isNotNull(), F.aggregate("edits", F.col("text"), cut)).otherwise(F.col("text"))).drop("edits")


def merge_fields(candidates: DataFrame, by: list[str]) -> DataFrame:
    """For each field the best confidence rank, then earliest page, then context; a conflict if the best rank has several values."""
    best = F.max("rank").over(Window.partitionBy(*by))
    c = candidates.withColumn("_best", best)
    chosen = F.min_by(F.struct("value", "page"), F.struct(-F.col("rank"), F.col("page"), F.col("context")))
    return c.groupBy(*by).agg(chosen.alias("x"), (F.count_distinct(F.when(F.col("rank") == F.col("_best"), F.col("value"))) > 1).alias("conflict")).select(*by, F.col("x.value").alias("value"), F.col("x.page").alias("page"), "conflict")


def field_confidence(fields: DataFrame) -> DataFrame:
    """High if the value stands in the cited text, medium if only cited, not_found if null or uncited. fields: value, cited (array of texts)."""
    inside = F.exists("cited", lambda t: F.contains(F.lower(t), F.lower(F.col("value"))))
    return fields.withColumn("confidence", F.when(F.col("value").isNull() | (F.size("cited") <= 0), "not_found").when(inside, "high").otherwise("medium"))


def ground_candidates(candidates: DataFrame, fields: DataFrame, texts: DataFrame, spans: DataFrame, bin_size: int = BIN) -> DataFrame:
    """the first reason to refuse an extraction, or none. candidates: doc_id, id, class, text, start, end; fields: class, pointer, kind;
    texts: doc_id, base_text; spans: doc_id, start, end (anchored source spans)."""
    ok = covered(candidates.where("start >= 0 AND end > start").select("doc_id", "id", "start", "end", "text"), spans, ["doc_id"], bin_size)
    j = candidates.join(fields, "class", "left").join(texts, "doc_id", "left").join(ok, ["doc_id", "id"], "left")
    exact = F.substring(F.col("base_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("text")
    literal = F.when(F.col("kind") == "integer", F.col("text").rlike(r"^[+-]?\d+$")).when(F.col("kind") == "number", F.col("text").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")).when(F.col("kind") == "boolean", F.lower("text").isin("true", "false")).otherwise(True)
    reason = (
        F.when(F.col("pointer").isNull(), "unknown class").when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("base_text")), "bad interval")
        .when(~exact, "text mismatch").when(~F.coalesce("covered", F.lit(False)), "no source span").when(~literal, "bad literal")
    )
    return j.select("doc_id", "id", "class", "pointer", "text", "start", "end", reason.alias("reason"))


def first_value(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The first grounded value by place, and whether others were passed over."""
    w = Window.partitionBy(*by)
    return candidates.withColumn("rn", F.row_number().over(w.orderBy("start", "end"))).withColumn("ignored", F.count(F.lit(1)).over(w) - 1).where("rn = 1").drop("rn")


def array_items(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Items by group index (or alone), groups numbered from 0 by their earliest start."""
    w = Window.partitionBy(*by)
    alone = F.concat(F.lit("s"), F.row_number().over(w.orderBy("start", "end")))
    c = candidates.withColumn("g", F.coalesce(F.concat(F.lit("g"), F.col("group_index")), alone))
    groups = c.groupBy(*by, "g").agg(F.min("start").alias("first_start"))
    return c.join(groups.withColumn("item", F.row_number().over(w.orderBy("first_start", "g")) - 1), [*by, "g"]).drop("g", "first_start")


def best_match(pairs: DataFrame, by: list[str], similarity: str, index: str) -> DataFrame:
    """The most similar partner; of equals the first."""
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(similarity).desc(), index))).where("rn = 1").drop("rn")


def capped_topk(candidates: DataFrame, page: list[str], rank: list, cap: Column | int, k: int, by: list[str]) -> DataFrame:
    """L2-L4: in rank order at most ``cap`` a page and ``k`` in all; the greedy loop equals the two window filters, and Spark limits groups before shuffling."""
    c = candidates.withColumn("in_page", F.row_number().over(Window.partitionBy(*page).orderBy(*rank))).where(F.col("in_page") <= cap)
    return c.withColumn("in_all", F.row_number().over(Window.partitionBy(*by).orderBy(*rank))).where(F.col("in_all") <= k)


def centre_weighted_mean(cells: DataFrame, regions: DataFrame, by: list[str], grid: int = 8) -> DataFrame:
    """Length-weighted mean confidence of the cells whose centre lies in each region. cells: x0..y1, confidence, text; regions: id, rx0..ry1.

    Regions go to the grid cells of the unit square that they touch and a centre to its own, so the join is by page and grid cell."""
    place = lambda c: F.greatest(F.least(F.floor(c * grid), F.lit(grid - 1)), F.lit(0))
    span = lambda a, b: F.explode(F.sequence(place(F.col(a)), F.greatest(place(F.col(a)), place(F.col(b)))))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    centres = cells.select(*by, cx.alias("_cx"), cy.alias("_cy"), "confidence", F.length("text").alias("_weight")).withColumn("_gx", place(F.col("_cx"))).withColumn("_gy", place(F.col("_cy")))
    wide = regions.withColumn("_gx", span("rx0", "rx1")).withColumn("_gy", span("ry0", "ry1"))
    j = wide.join(centres, [*by, "_gx", "_gy"]).where(F.col("_cx").between(F.col("rx0"), F.col("rx1")) & F.col("_cy").between(F.col("ry0"), F.col("ry1")))
    return j.groupBy(*by, "id").agg(F.round(F.sum(F.col("confidence") * F.col("_weight")) / F.nullif(F.sum("_weight"), F.lit(0)), 8).alias("confidence"))


def claimed_anchors(blocks: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Each anchor text goes to the first block, in page and reading order, that contains it.

    A word between the outer ones of an anchor stands whole in a block that contains it, so the longest of them is the join key; an anchor
    of fewer words is keyed by its first three characters, one of fewer characters by its document. Blocks are cut into characters only
    where their document has such anchors.
    """
    words = lambda c: F.split(c, r"\s+")
    inner = F.filter(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    a = anchors.withColumn("_w", words(F.col("anchor_text"))).withColumn("_key", F.when(longest.isNotNull(), F.concat(F.lit("w"), longest)).when(F.length("anchor_text") >= 3, F.concat(F.lit("g"), F.substring("anchor_text", 1, 3))).otherwise("t")).drop("_w")
    kinds = a.groupBy(*by).agg(F.bool_or(F.startswith("_key", F.lit("g"))).alias("_grams"), F.bool_or(F.col("_key") == "t").alias("_tiny"))
    none = F.array().cast("array<string>")
    text = F.col("text")
    grams = F.when(F.col("_grams") & (F.length(text) >= 3), F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.concat(F.lit("g"), F.substring(text, i, F.lit(3))))).otherwise(none)
    keys = F.concat(F.transform(words(text), lambda w: F.concat(F.lit("w"), w)), grams, F.when(F.col("_tiny"), F.array(F.lit("t"))).otherwise(none))
    b = blocks.join(kinds, by).withColumn("_key", F.explode(F.array_distinct(keys))).drop("_grams", "_tiny")
    j = b.join(a, [*by, "_key"]).where(F.contains(F.col("text"), F.col("anchor_text")))
    return j.groupBy(*by, "anchor_id").agg(F.min_by("block_id", F.struct("page", "reading_order")).alias("block_id"))


def same_sequence(plan: DataFrame, elements: DataFrame, by: list[str]) -> DataFrame:
    """Whether a plan names all elements of a group once and in their order. Compared position by position, so no arrays are gathered."""
    j = plan.select(*by, "pos", F.col("id").alias("planned")).join(elements.select(*by, "pos", "id"), [*by, "pos"], "full")
    return j.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("planned") == F.col("id"), F.lit(False))).alias("valid"))


def rounded_box_join(blocks: DataFrame, statuses: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Statuses put onto blocks by box rounded to six digits."""
    key = lambda df: df.withColumn("_box", F.array(*[F.bround(c, digits) for c in ("x0", "y0", "x1", "y1")]))
    return key(blocks).join(key(statuses).drop("x0", "y0", "x1", "y1"), [*by, "_box"], "left").drop("_box")


def with_fallback(links: DataFrame, names: DataFrame, target: str) -> DataFrame:
    """A link's article by full path, else by stem."""
    by_path = names.select(F.col("path").alias(target), F.col("path").alias("_p"))
    by_stem = names.groupBy(F.col("stem").alias(target)).agg(F.min("path").alias("_s"))
    return links.join(by_path, target, "left").join(by_stem, target, "left").withColumn("article", F.coalesce("_p", "_s")).drop("_p", "_s")


def iou_recall(candidate: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Mean IoU of gold boxes with the candidate of the same id (none: 0) and the share of at least a half. Boxes are structs."""
    j = gold.select(*by, "id", F.col("box").alias("g")).join(candidate.select(*by, "id", F.col("box").alias("c")), [*by, "id"], "left")
    return j.withColumn("iou", geometry.iou(F.col("c"), F.col("g"))).groupBy(*by).agg(F.avg("iou").alias("mean_iou"), F.avg((F.col("iou") >= 0.5).cast("double")).alias("recall_at_half"))
