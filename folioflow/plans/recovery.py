"""Queries of form recovery, page states and draft blocks. Line items play options of forms, orders pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import drafts, forms, rounds
from .registry import Tables, query

LABELS = ("Office", "Participating", "Home health", "Nonparticipating", "Hospice", "Office")
MARKS = {1: ("☒", ""), 2: ("☐", ""), 3: ("", "[x] ")}  # a mark in a cell of its own, or before the label


PLACED_SQL = "lines AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l_linenumber) FROM lineitem)"


def _lines(t: Tables):
    """Line items numbered within their order; the table's own numbers repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.withColumn("l_linenumber", F.row_number().over(order))


def _options(t: Tables):
    """One row an option: document, page, form, place, label, and the states of three readings by number."""
    l = _lines(t)
    part = (F.col("l_partkey") + F.col("l_linenumber")) % 4
    return l.select(
        "l_orderkey", F.floor(F.col("l_orderkey") / 8).alias("doc_id"), (F.col("l_orderkey") % 8).alias("page"), F.when(F.col("l_linenumber") <= 4, "a").otherwise("b").alias("region_id"), F.col("l_linenumber").alias("n"),
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("label"), (F.col("l_partkey") % 3).alias("own"), part.alias("one"),
        F.when(F.col("l_quantity").cast("int") % 5 == 0, (part + 1) % 4).otherwise(part).alias("two"), (F.col("l_partkey") % 5 % 3).alias("fine"),
    )


def _html(state, label, apart: bool):
    """A row of a form: with marks apart or before the label."""
    mark = lambda i: F.coalesce(F.create_map(*[v for k, m in MARKS.items() for v in (F.lit(k), F.lit(m[i]))])[state.cast("int")], F.lit(""))
    if apart:
        return F.concat(F.lit("<tr><td>"), mark(0), F.lit("</td><td class='o'>"), mark(1), label, F.lit(":</td><td>note</td></tr>"))
    return F.concat(F.lit("<tr><td>"), F.when(state == 1, "[x] ").when(state == 2, "[ ] ").otherwise(""), F.lit("<b>"), label, F.lit("</b></td><td>Reason:</td><td></td></tr>"))


def _texts(options, name, **columns):
    """One row a form with its text in each reading; columns: name of a reading to its states and whether their marks stand apart. Rows of a form are written before they meet."""
    rows = [_html(F.col(c), F.col("label"), apart).alias(c) for c, apart in columns.items()]
    forms_ = options.select("l_orderkey", "doc_id", "page", "region_id", "n", *rows).groupBy("l_orderkey", "region_id").agg(F.first("doc_id").alias("doc_id"), F.first("page").alias("page"), F.array_sort(F.collect_list(F.struct("n", *columns))).alias("r"))  # an order is a page
    whole = lambda c: F.concat(F.lit("<table><TR><th>"), name, F.lit("</th></TR>"), F.array_join(F.col("r")[c], "\n"), F.lit("</table>")).alias(c)
    return forms_.select("doc_id", "page", "region_id", *map(whole, columns))


def _named():
    """Both forms of some pages have one name."""
    return F.when((F.col("page") == 3) & (F.col("doc_id") % 3 == 0), F.lit("Form")).otherwise(F.concat(F.lit("Form "), "region_id"))


STATE = "CASE {0} WHEN 1 THEN 'checked' WHEN 2 THEN 'unchecked' WHEN 3 THEN 'checked' END"
EITHER = "coalesce({0}, CASE WHEN label = 'participating' AND max(CASE WHEN label = 'nonparticipating' THEN {0} END) OVER w = 'checked' OR label = 'nonparticipating' AND max(CASE WHEN label = 'participating' THEN {0} END) OVER w = 'checked' THEN 'unchecked' END)"
FORM_SQL = f"""{PLACED_SQL}, o AS (SELECT l_orderkey // 8 AS doc_id, l_orderkey % 8 AS page, CASE WHEN l_linenumber <= 4 THEN 'a' ELSE 'b' END AS region_id, l_linenumber AS n, (['office', 'participating', 'home health', 'nonparticipating', 'hospice', 'office'])[l_suppkey % 6 + 1] AS label,
  l_partkey % 3 AS own, (l_partkey + l_linenumber) % 4 AS one, CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 5 = 0 THEN ((l_partkey + l_linenumber) % 4 + 1) % 4 ELSE (l_partkey + l_linenumber) % 4 END AS two, l_partkey % 5 % 3 AS fine FROM lines),
s AS (SELECT doc_id, page, region_id, n, label, {STATE.format("own")} AS own, {STATE.format("one")} AS one, {STATE.format("two")} AS two, {STATE.format("fine")} AS fine, row_number() OVER (PARTITION BY doc_id, page, region_id, label ORDER BY n) - 1 AS occ FROM o),
e AS (SELECT *, {EITHER.format("own")} AS own_e, {EITHER.format("one")} AS one_e, {EITHER.format("two")} AS two_e FROM s WINDOW w AS (PARTITION BY doc_id, page, region_id, occ)),
c AS (SELECT *, CASE WHEN own IS NULL AND one_e = two_e THEN one_e END AS agreed, one_e IS DISTINCT FROM two_e AS apart FROM e),
f AS (SELECT doc_id, page, region_id, count(*) AS n, count(*) FILTER (WHERE own_e IS NULL) AS open, count(agreed) AS got, bool_or(apart) AS apart FROM c GROUP BY ALL),
a AS (SELECT *, page = 3 AND doc_id % 3 = 0 AS twin FROM f WHERE n >= 2 AND open > 0),
k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS rank, count(*) OVER (PARTITION BY doc_id, page, CASE WHEN twin THEN 'form' ELSE region_id END) AS same FROM a),
st AS (SELECT doc_id, page, region_id, CASE WHEN rank > 3 THEN 'deferred' WHEN same > 1 THEN 'ambiguous' WHEN page = 5 THEN 'unavailable' WHEN twin AND (SELECT count(*) FROM f g WHERE g.doc_id = k.doc_id AND g.page = k.page) > 1 OR page = 6 AND region_id = 'b' THEN 'unaligned' WHEN got > 0 THEN 'resolved' WHEN apart THEN 'disagreed' ELSE 'unchanged' END AS status, got FROM k),
final AS (SELECT c.*, coalesce(status, 'complete') AS status, CASE WHEN status = 'resolved' THEN got ELSE 0 END AS n_resolved, CASE WHEN status = 'resolved' THEN coalesce(own, agreed) ELSE own END AS now FROM c LEFT JOIN st USING (doc_id, page, region_id))"""


def _inputs(t: Tables):
    """Pages without their second reading, with a form of another name, and with two forms of one name are among them."""
    options = _options(t)
    other = F.when((F.col("page") == 6) & (F.col("region_id") == "b"), F.replace("two", F.lit("Form b"), F.lit("Another"))).otherwise(F.col("two"))
    both = F.array(F.struct(F.lit(1).alias("reading"), F.col("one").alias("content")), F.struct(F.lit(2).alias("reading"), other.alias("content")))
    readings = _texts(options, _named(), one=True, two=True).select("doc_id", "page", F.inline(both)).where("page <> 5 OR reading = 1")
    return _texts(options, _named(), own=False).select("doc_id", "page", "region_id", F.lit("table").alias("type"), F.col("own").alias("text")), readings


@query(f"""WITH {FORM_SQL} SELECT doc_id, page, region_id, any_value(status) AS status, CAST(any_value(n_resolved) AS BIGINT) AS n_resolved, string_agg(label || '=' || coalesce(now, '?'), ',' ORDER BY n) AS states FROM final GROUP BY doc_id, page, region_id""")
def form_recovery(t: Tables):
    """States are read back from the completed texts."""
    regions, readings = _inputs(t)
    done = forms.recover_forms(regions, readings, ["doc_id"], 3)
    states = F.explode(F.filter(F.array(forms.said_options("text")), lambda s: s != ""))
    return done.select("doc_id", "page", "region_id", "status", F.col("n_resolved").cast("bigint").alias("n_resolved"), states.alias("states"))


@query(f"""WITH {PLACED_SQL}, s AS (SELECT l_orderkey, l_linenumber AS n, (['office', 'participating', 'home health', 'nonparticipating', 'hospice', 'office'])[l_suppkey % 6 + 1] AS label, CASE l_partkey % 3 WHEN 1 THEN 'checked' WHEN 2 THEN 'unchecked' END AS own, CASE l_partkey % 5 % 3 WHEN 1 THEN 'checked' WHEN 2 THEN 'unchecked' END AS fine, l_suppkey % 2 = 0 AS blank, l_returnflag AS said FROM lines),
m AS (SELECT *, own <> fine AS conflict, CASE WHEN own <> fine THEN NULL ELSE coalesce(fine, own) END AS now, blank AND said <> 'N' AS filled FROM s)
SELECT l_orderkey, CASE WHEN bool_or(coalesce(conflict, false)) THEN 'conflict' WHEN bool_or(now IS NULL) AND (bool_or(now IS NOT NULL) OR bool_or(filled)) THEN 'partial' WHEN bool_or(now IS NULL) THEN 'ambiguous' ELSE 'resolved' END AS merge_status, count(now) + count(*) FILTER (WHERE filled) AS n_merged,
  string_agg(label || '=' || coalesce(now, '?') || ' ' || CASE WHEN filled THEN said || ' & <' || n || '>' ELSE '' END, ',' ORDER BY n) AS states FROM m GROUP BY l_orderkey""")
def merged_forms(t: Tables):
    """A fine reading fills blank cells beside the same label; of every second line that label differs."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_suppkey") % 6 + 1).cast("int"))
    mark = lambda s: F.when(s == 1, "[x] ").when(s == 2, "☐ ").otherwise("")
    row = lambda s, left, said: F.concat(F.lit("<tr><td>"), mark(s), label, F.lit("</td><td>"), left, F.lit("</td><TD rowspan=1>"), said, F.lit("</TD></tr>"))
    said = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", F.lit(" &amp; &lt;"), F.col("l_linenumber"), F.lit("&gt;")))
    other = row(F.col("l_partkey") % 5 % 3, F.when(F.col("l_suppkey") % 2 == 0, "REASON:").otherwise("Cause:"), said)
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", row(F.col("l_partkey") % 3, F.lit("Reason:"), F.lit(" ")).alias("own"), other.alias("other"))))
    whole = _lines(t).groupBy("l_orderkey").agg(lines.alias("l")).select("l_orderkey", F.array_join(F.transform("l", lambda x: x["own"]), "").alias("text"), F.array_join(F.transform("l", lambda x: x["other"]), "").alias("recovered"))
    done = forms.merge_forms(whole, ["l_orderkey"])
    state = lambda c: F.when(c["label"].isNotNull(), F.concat(c["label"], F.lit("="), F.coalesce(c["state"], F.lit("?")))).otherwise(c["said"])
    of_line = lambda cells, k: F.transform(F.filter(cells, lambda c: c["cell"] % 3 == k), state)
    told = text.bound(forms.cells_of(F.col("text")), lambda cells: F.array_join(F.zip_with(of_line(cells, 0), of_line(cells, 2), lambda a, b: F.concat(a, F.lit(" "), b)), ","))
    return done.select("l_orderkey", "merge_status", F.col("n_merged").cast("bigint").alias("n_merged"), told.alias("states"))


def _actions(k):
    return F.element_at(F.array(*map(F.lit, ("accept", "correct", "reject", "inspect", "correct", "unclear"))), (k % 6 + 1).cast("int"))


def _rounds(t: Tables):
    """Conversations as pages, turns as blocks; answers to every version that a block might have, some missing, some twice, some pages without a turn."""
    turn = F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "figure", "list_item", "paragraph"))), (turn % 4 + 1).cast("int"))
    words = F.concat("text", F.when((F.col("conv_id") + turn) % 3 == 0, " Id2 AB1").when(turn % 5 == 2, " ##").otherwise(""))
    blocks = rounds.start(t.conversations.select("conv_id", F.concat(F.lit("t"), turn).alias("id"), kind.alias("type"), words.alias("text"), F.lit("pending").alias("status"), F.when((turn + F.col("conv_id")) % 4 != 0, (turn + F.col("conv_id")) % 10 / 10.0).cast("double").alias("confidence"), (turn % 5 != 1).alias("has_box"), turn.cast("bigint").alias("reading_order")))
    pages = t.conversations.select("conv_id").distinct().crossJoin(t.spark.range(1, 4).select(F.col("id").cast("int").alias("round")))  # a page has three rounds
    turns = pages.where((F.col("conv_id") + F.col("round")) % 9 != 0)
    each = t.conversations.select("conv_id", "turn", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("round"))
    k = F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("round")
    each = each.where(k % 8 != 0).withColumn("times", F.when(k % 11 == 0, 2).otherwise(1)).withColumn("version", F.explode(F.sequence(F.lit(0), F.col("round") - F.lit(1)))).withColumn("x", F.explode(F.sequence(F.lit(1), "times")))
    answers = each.select("conv_id", "round", F.concat(F.lit("t"), "turn").alias("id"), "version", _actions(k).alias("action"), (F.lit(0.8) + k % 3 / 10.0).cast("double").alias("confidence"), F.when(k % 5 != 0, F.concat(F.lit("fixed "), "round")).alias("text"))
    return blocks, turns, answers


def _round_sql(r: int) -> str:
    """One round from s{r-1} to s{r}: what is asked, the answers, and the new state."""
    alive, wants = "status <> 'rejected'", "(status = 'inspect' OR regexp_matches(text, '##|(?i:\\b(id|no|number)2\\s+[A-Z0-9][A-Z0-9_-]{2,}\\b)'))"
    ask = {1: f"{alive} AND coalesce(confidence < 0.85, false) OR status = 'needs_review'", 2: f"{alive} AND has_box AND (type = 'figure' OR {wants} AND rk <= 1)", 3: "status = 'needs_review' AND has_box"}[r]
    over = "status = 'inspect' AND NOT (has_box AND (type = 'figure' OR rk <= 1))" if r == 2 else "false"
    rank = f"row_number() OVER (PARTITION BY conv_id, {alive} AND has_box AND type <> 'figure' AND {wants} ORDER BY CASE WHEN status = 'inspect' THEN 0 ELSE 1 END, confidence NULLS LAST, turn) AS rk"
    says = "action = 'accept' OR sure"
    stays = "CASE WHEN status = 'inspect' OR 3 = %d THEN 'needs_review' ELSE status END" % r
    more = f" WHEN action = 'correct' AND ac >= 0.85 THEN {stays}" + (" WHEN action = 'inspect' AND has_box THEN 'inspect'" if r == 1 else "")
    return f"""q{r} AS (SELECT *, {rank} FROM s{r - 1}),
j{r} AS (SELECT q.*, ({ask}) AS ask, ({over}) AS past, (conv_id + {r}) % 9 <> 0 AND q.round = {r - 1} AS now, CASE WHEN (conv_id * 7 + turn * 3 + {r}) % 8 = 0 THEN 0 WHEN (conv_id * 7 + turn * 3 + {r}) % 11 = 0 THEN 2 ELSE 1 END AS n,
  (['accept', 'correct', 'reject', 'inspect', 'correct', 'unclear'])[(conv_id * 7 + turn * 3 + {r}) % 6 + 1] AS action, (0.8::DOUBLE + ((conv_id * 7 + turn * 3 + {r}) % 3) / 10) AS ac, CASE WHEN (conv_id * 7 + turn * 3 + {r}) % 5 <> 0 THEN 'fixed {r}' END AS new_text FROM q{r} q),
k{r} AS (SELECT *, now AND (ask OR past) AS change, n = 1 AND NOT past AND action = 'correct' AND ac >= 0.85 AND coalesce(new_text <> text AND trim(new_text) <> '', false) AS sure FROM j{r}),
s{r} AS (SELECT conv_id, turn, type, CASE WHEN change AND sure THEN new_text ELSE text END AS text, CASE WHEN NOT change THEN status WHEN past OR n <> 1 THEN 'needs_review' WHEN {says} THEN 'verified'{more} ELSE 'needs_review' END AS status, CASE WHEN change AND sure THEN ac ELSE confidence END AS confidence, has_box,
  CASE WHEN now THEN {r} ELSE round END AS round, version + CASE WHEN change THEN 1 ELSE 0 END AS version, CASE WHEN NOT change THEN reason WHEN past THEN 'crop limit' WHEN n = 0 THEN 'no answer' WHEN n > 1 THEN 'several answers' WHEN {says} THEN NULL WHEN action = 'correct' AND ac >= 0.85 THEN 'nothing to correct' WHEN action = 'correct' THEN 'unsure correction' {"" if r == 3 else "WHEN action = 'reject' THEN 'rejected by inspection'"} {"WHEN action = 'inspect' THEN CASE WHEN has_box THEN NULL ELSE 'no box' END" if r == 1 else ""} ELSE 'inconclusive' END AS reason,
  recovered OR change AND sure AS recovered FROM k{r})"""


ROUNDS_SQL = f"""s0 AS (SELECT conv_id, turn, (['paragraph', 'figure', 'list_item', 'paragraph'])[turn % 4 + 1] AS type, text || CASE WHEN (conv_id + turn) % 3 = 0 THEN ' Id2 AB1' WHEN turn % 5 = 2 THEN ' ##' ELSE '' END AS text, 'pending' AS status,
  CASE WHEN (turn + conv_id) % 4 <> 0 THEN ((turn + conv_id) % 10) / 10 END AS confidence, turn % 5 <> 1 AS has_box, 0 AS round, 0 AS version, CAST(NULL AS VARCHAR) AS reason, false AS recovered FROM conversations), {", ".join(map(_round_sql, (1, 2, 3)))}"""


@query(f"""WITH {ROUNDS_SQL} SELECT conv_id, 't' || turn AS id, text, status, confidence, CAST(round AS INTEGER) AS round, CAST(version AS INTEGER) AS version, reason, recovered FROM s3""")
def page_rounds(t: Tables):
    blocks, turns, answers = _rounds(t)
    done = rounds.run(blocks, turns, answers, ["conv_id"], most=1)
    return done.select("conv_id", "id", "text", "status", "confidence", "round", "version", "reason", "recovered")


def _drafts(t: Tables):
    """Turns as drafts of tables and paragraphs; a cell's spans are given out of order, one of them overlaps, one may be empty, out of range or of another text."""
    turn, said = F.col("turn"), F.concat(F.lit("a\u00adb: "), "text", F.lit("\u200b"))
    span = lambda a, b, text=None, c=None: F.struct(F.lit(a).alias("start") if isinstance(a, int) else a.alias("start"), (F.lit(b) if isinstance(b, int) else b).alias("end"), (F.lit(None).cast("string") if text is None else text).alias("text"), F.lit(c).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source"), F.lit(None).cast(drafts.BOX).alias("box"))
    spans = F.array(span(4, F.when(turn % 5 == 4, 400).otherwise(6).cast("int")), span(3, (3 + turn % 4).cast("int"), F.when(F.col("role") == "user", "zzz"), 0.25), span(0, 3), span(0, 1, F.lit("a")))
    box = lambda right: F.struct(F.lit(0.1).alias("x0"), F.lit(0.1).alias("y0"), right.cast("double").alias("x1"), F.lit(0.2).alias("y1"))
    cell = F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), said.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(False).alias("header"), box(F.lit(0.3)).alias("box"), F.when(turn % 3 != 0, turn / 10).cast("double").alias("confidence"), spans.alias("spans"))
    atom = F.struct(F.lit("word").alias("kind"), F.lit("x\ufeffy").alias("text"), box(F.lit(2)).alias("box"), F.lit(0.75).alias("confidence"), F.array(span(0, 1)).alias("spans"))
    table = F.col("role") != "system"
    none = lambda kind: F.lit(None).cast(kind)
    return t.conversations.select(
        F.col("conv_id").cast("int").alias("page"), turn.cast("int").alias("idx"), F.when(table, "table").otherwise("form_field").alias("type"), said.alias("text"), box(F.when(turn % 6 == 1, 1.5).otherwise(0.5)).alias("box"), turn.cast("int").alias("reading_order"), F.lit(0.8).alias("confidence"),
        none("int").alias("heading_level"), none("string").alias("list_marker"), F.array(cell).cast(f"array<{drafts.CELL}>").alias("cells"), none("struct<label:string,value:string,hint:string>").alias("form"), none("struct<state:string,group:string,option:string>").alias("checkbox"),
        F.concat(F.lit("\u00adcap "), "role").alias("caption"), none("string").alias("description"), none("string").alias("chart_type"), none("array<struct<label:string,value:string,series:string>>").alias("chart"), F.array(atom).cast(f"array<{drafts.ATOM}>").alias("atoms"),
    )


DRAFTS_SQL = """d AS (SELECT conv_id, turn, role, 'a' || chr(173) || 'b: ' || text || chr(8203) AS said, role <> 'system' AS tab FROM conversations),
e AS (SELECT *, length(said) AS n, replace(replace(said, chr(173), ''), chr(8203), '') AS plain, turn % 4 > 0 AND 3 + turn % 4 <= length(said) AND role <> 'user' AS third FROM d),
f AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 400 ELSE 6 END AS stop4, CASE WHEN third THEN 3 + turn % 4 ELSE 1 END AS last FROM e),
g AS (SELECT *, stop4 <= n AND 4 >= last AND length(substr(said, 5, stop4 - 4)) = length(replace(replace(substr(said, 5, stop4 - 4), chr(173), ''), chr(8203), '')) AS fourth FROM f)"""


@query(f"""WITH {DRAFTS_SQL} SELECT 'p' || conv_id || '-b' || (turn + 1) AS block_id, plain AS text, CASE WHEN tab THEN '0-1 a ' || coalesce(CASE WHEN turn % 3 <> 0 THEN turn / 10 END, 0.8) || CASE WHEN third THEN ';2-' || (2 + turn % 4) || ' ' || substr(plain, 3, turn % 4) || ' 0.25' ELSE '' END
  || CASE WHEN fourth THEN ';3-' || (stop4 - 1) || ' ' || substr(plain, 4, stop4 - 4) || ' ' || coalesce(CASE WHEN turn % 3 <> 0 THEN turn / 10 END, 0.8) ELSE '' END END AS spans,
  CASE WHEN tab THEN NULL ELSE 'ab=' || trim(substr(plain, 4)) END AS form, least(0.75::DOUBLE, CASE WHEN turn % 3 <> 0 THEN turn / 10 END) AS confidence, CASE WHEN turn % 6 = 1 THEN 'invalid box' WHEN tab THEN 'invalid confidence evidence' END AS reason, 'cap ' || role AS caption, true AS again FROM g""")
def span_blocks(t: Tables):
    """There, back and there again: cells, atoms, texts and forms stay what they are."""
    first = drafts.to_blocks(_drafts(t))
    second = drafts.to_blocks(drafts.to_drafts(first))
    whole = lambda b: F.to_json(F.struct("type", "text", "cells", "atoms", "form", "box", "caption", "reading_order", "confidence"))
    again = second.select("block_id", whole(second).alias("_again"))
    spans = F.array_join(F.flatten(F.transform("cells", lambda c: F.transform(c["spans"], lambda s: F.concat(s["start"], F.lit("-"), s["end"], F.lit(" "), s["text"], F.lit(" "), s["confidence"])))), ";")
    b = first.withColumn("_own", whole(first)).join(again, "block_id")
    return b.select("block_id", "text", F.when(F.col("type") == "table", spans).alias("spans"), F.when(F.col("form").isNotNull(), F.concat("form.label", F.lit("="), F.coalesce("form.value", F.lit("")))).alias("form"), "confidence", "reason", "caption", (F.col("_own") == F.col("_again")).alias("again"))
