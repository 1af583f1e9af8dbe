"""Queries of flow, sink, citation and text operators. ``customer`` and ``orders`` play documents and blocks, ``conversations`` and ``pages`` give whole texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pointers, text
from ..operators import blocks, flows, folds, joins, regions, validate, windows
from ..sources import formats, sinks
from .registry import Tables, query


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS content, CASE WHEN c_custkey % 3 = 0 THEN 'source is unavailable' WHEN c_custkey % 5 = 0 THEN 'timeout' END AS error FROM customer""")
def corpus_runs(t: Tables):
    k = F.col("c_custkey")
    results = t.customer.where(k % 3 != 0).select(k.alias("doc_id"), F.col("c_name").alias("content"), F.when(k % 5 == 0, "timeout").alias("error"))
    return flows.corpus_run(t.customer.select(k.alias("doc_id")), results)


@query("""SELECT o_custkey, o_orderkey AS target_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 <> 0, o_orderkey % 3, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 10 END NULLS FIRST, o_orderkey % 5, o_orderkey % 11, o_orderkey) AS INTEGER) AS number FROM orders""")
def recovery_logs(t: Tables):
    k = F.col("o_orderkey")
    reasons = F.when(k % 4 == 0, F.array(F.lit("blur"), F.lit("unresolved_form_controls"))).otherwise(F.array(F.lit("blur")))
    c = t.orders.select("o_custkey", k.alias("target_id"), reasons.alias("reasons"), (k % 3).alias("severity"), F.when(k % 7 != 0, k % 10 / 10).alias("confidence"), (k % 5).alias("page"), (k % 11).alias("reading_order"))
    return flows.recovery_log(c, ["o_custkey"]).select("o_custkey", "target_id", "number")


@query("""SELECT user_id, event_id AS seq, event_type AS kind, NULL::BIGINT AS page FROM events UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, o_orderkey % 9 FROM orders""")
def branch_union(t: Tables):
    usage = t.events.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    elements = t.orders.select((F.col("o_orderkey") % 9).alias("page"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("kind"))
    return flows.ordered_union(usage, elements)


@query("""SELECT o_custkey, o_orderkey AS segment_id, '{"segment_id":' || o_orderkey || ',"category":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"extraction":{"amount":' || (o_orderkey % 100) || '}' ELSE '' END || '}' AS json FROM orders""")
def segment_payloads(t: Tables):
    k = F.col("o_orderkey")
    s = t.orders.select("o_custkey", k.alias("segment_id"), F.col("o_orderstatus").alias("category"))
    extracted = t.orders.where(k % 2 == 0).select("o_custkey", k.alias("segment_id"), (k % 100).alias("amount"))
    return flows.segment_payload(s, extracted, ["o_custkey"])


@query("""SELECT conv_id, '{"schema_version":"4.6.0","turns":[' || string_agg('{"seq":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' ||
  coalesce(',"trace":[' || string_agg('{"seq":' || turn || coalesce(',"size":' || length(text), '') || '}', ',' ORDER BY turn) FILTER (turn % 2 = 1) || ']', '') || '}' AS json FROM conversations GROUP BY 1""")
def combined_envelopes(t: Tables):
    c = t.conversations
    parts = {"turns": c.select("conv_id", F.col("turn").alias("seq"), "role"), "trace": c.where("turn % 2 = 1").select("conv_id", F.col("turn").alias("seq"), F.length("text").alias("size"))}
    return flows.combined_envelope(parts, "conv_id", "4.6.0")


@query("""SELECT conv_id, turn FROM conversations WHERE NOT coalesce(substring(text, CAST(turn % 2 + 1 AS INTEGER), 3) = CASE WHEN conv_id % 2 = 0 THEN text[1:3] ELSE 'the' END, false)""")
def inexact_gold(t: Tables):
    said = F.when(F.col("conv_id") % 2 == 0, F.substring("text", 1, 3)).otherwise("the")
    gold = t.conversations.select("conv_id", "turn", F.col("text").alias("reference_text"), (F.col("turn") % 2).alias("start"), (F.col("turn") % 2 + 3).alias("end"), said.alias("text"))
    return validate.exact_gold(gold).select("conv_id", "turn")


@query("""WITH p AS (SELECT o_orderkey, ['/data', 'data', '/database', '/a/data'][1 + o_orderkey % 4] || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/' || o_orderpriority END AS x FROM orders), q AS (SELECT o_orderkey, CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END AS y FROM p)
SELECT o_orderkey, CASE WHEN y = '/data' OR starts_with(y, '/data/') THEN y[6:] ELSE y END AS pointer FROM q""")
def canonical_pointers(t: Tables):
    k = F.col("o_orderkey")
    head = F.get(F.array(*map(F.lit, ("/data", "data", "/database", "/a/data"))), (k % 4).cast("int"))
    return t.orders.select("o_orderkey", pointers.canonical_pointer(F.concat(head, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/"), "o_orderpriority")))).alias("pointer"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS title, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ': x' END AS segment FROM customer""")
def front_matters(t: Tables):
    k = F.col("c_custkey")
    said = F.concat(F.when(k % 3 == 0, " ").otherwise(""), F.lit("---\ntitle: draft\n# no\nsegment:  "), "c_mktsegment", F.lit(": x \ntitle:"), "c_name", F.lit("\n---\ntitle: body\n---\n"))
    front = t.customer.select("c_custkey", text.front_matter(said).alias("m"))
    return front.select("c_custkey", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("segment")).alias("segment"))


@query("""SELECT c_custkey, c_name || chr(10) || c_mktsegment || ' b &  ' || c_custkey || ' ' AS said FROM customer""")
def plain_markdown(t: Tables):
    said = F.concat(F.lit("## "), "c_name", F.lit("\n1. ["), "c_mktsegment", F.lit("](x) **b** &amp; <i>"), F.col("c_custkey").cast("string"), F.lit("</i>"))
    return t.customer.select("c_custkey", text.markdown_plain(said).alias("said"))


@query("""SELECT conv_id, turn, CAST(length(regexp_replace((chr(65279) || replace(text, ' ', chr(173)))[1:20 * (turn + 1)], '[' || chr(173) || chr(8203) || chr(65279) || ']', '', 'g')) AS INTEGER) AS at FROM conversations""")
def clean_offsets(t: Tables):
    said = F.concat(F.lit("﻿"), F.replace("text", F.lit(" "), F.lit("­")))
    return t.conversations.select("conv_id", "turn", text.clean_offset(said, ((F.col("turn") + 1) * 20).cast("int")).alias("at"))


@query("""SELECT o_orderkey, o_orderkey % 4 <> 1 AS number, o_orderkey % 4 <> 1 AND o_orderkey % 4 <> 3 AS answer FROM orders""")
def cited_scalars(t: Tables):
    k = F.col("o_orderkey")
    said = F.get(F.array(*[F.concat(F.lit(a), (k + 1).cast("string"), F.lit(b)) for a, b in (("Paid: yes\nTotal: $", ".00"), ("Paid: no\nTotal: (", ")"), ("| Paid | Yes. |\n+", " EUR"), ("yesterday ", ""))]), (k % 4).cast("int"))
    return t.orders.select("o_orderkey", text.cites_number(said, k + 1).alias("number"), text.cites_boolean(said, True).alias("answer"))


@query("""SELECT conv_id, turn, coalesce(contains(lower(text), lower(role)), false) AS cited FROM conversations""")
def cited_strings(t: Tables):
    return t.conversations.select("conv_id", "turn", F.coalesce(text.cites_string(F.col("text"), F.upper("role")), F.lit(False)).alias("cited"))


@query(f"""SELECT c_custkey, c_custkey || '{text.PAGE_BREAK}' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS said FROM customer""")
def named_pages(t: Tables):
    k = F.col("c_custkey")
    said = F.array_join(F.array("c_name", "c_mktsegment", k.cast("string")), text.PAGE_BREAK)
    return t.customer.select("c_custkey", blocks.subset_pages(said, F.array(F.lit(3), (k % 2 + 1).cast("int"), F.lit(4))).alias("said"))


@query("""WITH p AS (SELECT o_custkey, CAST(o_orderkey * 7 % 1000 AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS r FROM orders), s AS (SELECT o_custkey, sum(levenshtein(c, r)) AS d, sum(length(r)) AS n, count(*) AS page_count FROM p GROUP BY 1)
SELECT o_custkey, round(greatest(0.0, 1 - d / n), 6)::DOUBLE AS word_accuracy, round(d / n, 6)::DOUBLE AS word_error_rate, page_count FROM s""")
def pages_accuracy(t: Tables):
    """Each digit is a word of its own, so word distances are those of characters."""
    k = F.col("o_orderkey")
    digits = lambda c: F.array_join(F.split(c.cast("string"), ""), " ")
    p = t.orders.select("o_custkey", digits(k * 7 % 1000).alias("candidate"), digits(k).alias("reference"))
    return blocks.page_accuracy(p, ["o_custkey"]).select("o_custkey", F.round("word_accuracy", 6).alias("word_accuracy"), F.round("word_error_rate", 6).alias("word_error_rate"), "page_count")


@query("""SELECT c_custkey, c_custkey % 3 AS word_insertions, round(c_custkey % 3 / (2 + c_custkey % 3), 6) AS hallucination_rate, CAST(CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS forbidden_literal_count, CAST(c_custkey % 2 AS INTEGER) AS false_accept_count, c_custkey % 2 / 2 AS false_accept_rate FROM customer""")
def hallucinations(t: Tables):
    k = F.col("c_custkey")
    extra = F.array_join(F.slice(F.array(F.lit(""), F.lit("Foo"), F.lit("bar")), 1, (k % 3 + 1).cast("int")), " ")
    reference = F.concat("c_mktsegment", F.lit(" said"))
    d = t.customer.select("c_custkey", F.concat(reference, extra).alias("candidate"), reference.alias("reference"), F.array(F.lit("FOO"), F.lit("none")).alias("forbidden"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("rejected"), F.array(F.when(k % 2 == 1, "a").otherwise("c")).alias("accepted"))
    return blocks.hallucination(d, "c_custkey").withColumn("hallucination_rate", F.round("hallucination_rate", 6))


@query("""SELECT o_custkey, round(count(DISTINCT o_orderkey % 10) / 10, 6) AS covered FROM orders GROUP BY 1""")
def covered_shares(t: Tables):
    k = F.col("o_orderkey") % 10
    strips = t.orders.select("o_custkey", (k / 10).alias("x0"), F.lit(0.0).alias("y0"), ((k + 1) / 10).alias("x1"), F.lit(1.0).alias("y1"))
    region = t.orders.select("o_custkey").distinct().select("o_custkey", F.lit(0.0).alias("rx0"), F.lit(0.25).alias("ry0"), F.lit(1.0).alias("rx1"), F.lit(0.5).alias("ry1"))
    return folds.covered_fraction(strips, region, ["o_custkey"]).select("o_custkey", F.round("covered", 6).alias("covered"))


PLACED_SQL = """WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS r, l_partkey, l_suppkey FROM lineitem),
c AS (SELECT k, r, ([1, 2, 3, 10000000])[l_partkey % 4 + 1] AS down, 1 + l_suppkey % 2 AS across FROM l),
g AS (SELECT k, -1::BIGINT AS r, []::STRUCT(c BIGINT, e BIGINT)[] AS held, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS down, 0::BIGINT AS across FROM c WHERE r = 0
  UNION ALL SELECT k, r, list_concat(held, CASE WHEN down > 1 THEN list_transform(range(a, a + across), lambda x: {'c': x, 'e': r + down}) ELSE [] END), a, b, down, across FROM (
    SELECT *, list_min(list_filter(range(a + across, a + across + len(held) + 1), lambda x: NOT list_contains(list_transform(held, lambda h: h.c), x))) AS b FROM (
      SELECT k, r, down, across, held, list_min(list_filter(range(0, len(held) + 1), lambda x: NOT list_contains(list_transform(held, lambda h: h.c), x))) AS a FROM (
        SELECT c.k, c.r, c.down, c.across, list_filter(g.held, lambda h: h.e > c.r) AS held FROM g JOIN c ON c.k = g.k AND c.r = g.r + 1) q1) q2) q3)
SELECT k AS l_orderkey, r AS "row", "column", row_span, col_span, text FROM (SELECT k, r, a AS "column", down AS row_span, across AS col_span, 'a' AS text FROM g WHERE r >= 0 UNION ALL SELECT k, r, b, 1, 1, 'b' FROM g WHERE r >= 0) q"""


def _rows(t: Tables):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.withColumn("row", F.row_number().over(order) - 1)


@query(PLACED_SQL)
def placed_cells(t: Tables):
    """Two cells a row; the first reaches one to ten million rows down, so later rows find their columns taken."""
    down = F.element_at(F.array(*map(F.lit, (1, 2, 3, 10_000_000))), (F.col("l_partkey") % 4 + 1).cast("int"))
    cell = lambda seq, down, across, text: F.struct(F.lit(seq).alias("seq"), down.alias("row_span"), across.alias("col_span"), F.lit(text).alias("text"))
    both = _rows(t).select("l_orderkey", "row", F.inline(F.array(cell(0, down.cast("bigint"), (F.col("l_suppkey") % 2 + 1).cast("bigint"), "a"), cell(1, F.lit(1).cast("bigint"), F.lit(1).cast("bigint"), "b"))))
    return folds.place_cells(both, ["l_orderkey"])


@query(PLACED_SQL.replace("AS text FROM g", "AS text, true AS header FROM g").replace("'b' FROM g", "'b & <' || r || '>', false FROM g").replace("col_span, text FROM (", "col_span, header, text FROM (").replace("'a' AS text", "'a' || r AS text"))
def html_grids(t: Tables):
    """The same tables as HTML, with attributes in several forms, entities and a row that is never closed."""
    down = F.element_at(F.array(*map(F.lit, ("rowspan='1.5'", 'rowspan="2"', "ROWSPAN = 3", "rowspan='10000000'"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    across = F.when(F.col("l_suppkey") % 2 == 0, 'colspan="²"').otherwise("class=x colspan=+2")
    row = F.concat(F.lit("<TR class='r'><th "), down, F.lit(" "), across, F.lit(">a<b>"), "row", F.lit("</b></th><td>lost<td rowspan=0 data-colspan=9>b<br/>&amp; &lt;"), "row", F.lit("&gt;</td>\n</tr>"))
    tables = _rows(t).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("h")))), lambda x: x["h"]), "").alias("h"))
    return regions.html_grid(tables.select("l_orderkey", F.concat(F.lit("<table><tr><td>open</td>"), "h", F.lit("<tr><td>never closed</td></table>")).alias("h")), "l_orderkey", "h").select("l_orderkey", "row", "column", "row_span", "col_span", "header", "text")


@query("""SELECT page_id, regexp_replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;(/?(?:table|thead|tbody|tr|th|td|caption|figure|figcaption))&gt;', '<\\1>', 'gi') AS preview FROM pages""")
def safe_previews(t: Tables):
    return t.pages.select("page_id", sinks.safe_preview(F.col("html")).alias("preview"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, '{"title":"' || c_name || '","path":"' || c_custkey || '","headings":["' || c_name || '","Two"],"summary":"' || c_mktsegment || ' said"}' AS json FROM customer""")
def search_indexes(t: Tables):
    """Markdown documents as lines of the search index."""
    said = F.concat(F.lit("---\nkind: x\n---\n# "), "c_name", F.lit("\n\n"), "c_mktsegment", F.lit(" said\n\n## Two \nmore"))
    return sinks.search_index(formats.markdown_documents(t.customer.select(F.col("c_custkey").cast("string").alias("path"), said.alias("text"))))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 2 <> 1 OR c_custkey % 3 = 0 THEN 'pending' ELSE 'done' END AS status, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS result FROM customer""")
def restored_states(t: Tables):
    k = F.col("c_custkey")
    stored = t.customer.select("c_custkey", F.col("c_name").cast("binary").alias("content"), F.when(k % 7 == 0, "bad").otherwise(F.sha2("c_name", 256)).alias("sha256"), (k % 2).alias("version"), F.when(k % 3 == 0, "running").otherwise("done").alias("status"), F.col("c_mktsegment").alias("result"))
    return sinks.restore(stored, 1).select("c_custkey", "status", "result")


@query("""SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (length(text) > 0), '') AS base_text FROM conversations GROUP BY 1""")
def base_texts(t: Tables):
    return blocks.base_text(t.conversations.select("conv_id", F.col("turn").alias("element_order"), "text"), "conv_id")


@query("""SELECT o_orderkey, '{' || CASE WHEN o_orderkey % 2 = 0 THEN '"page":' || (o_orderkey % 9) || ',' ELSE '' END || '"bbox":[0.1,0.2,0.5,0.75]' || CASE WHEN o_orderkey % 3 <> 0 THEN ',"start":' || o_orderkey || ',"end":' || (o_orderkey + 5) ELSE '' END || '}' AS source FROM orders""")
def value_sources(t: Tables):
    k = F.col("o_orderkey")
    known = lambda c: F.when(k % 3 != 0, c)
    return t.orders.select("o_orderkey", flows.source(F.when(k % 2 == 0, k % 9), F.array(*map(F.lit, (0.1, 0.2, 0.5, 0.75))), known(k), known(k + 5)).alias("source"))


@query("""SELECT role AS unit_kind, conv_id AS path, count(*) AS n_units FROM conversations GROUP BY 1, 2""")
def unit_numbers(t: Tables):
    units = t.conversations.select(F.col("conv_id").alias("path"), F.explode(F.array(F.lit("unit"), F.lit("record"))).alias("kind"), F.col("role").alias("unit_kind"))
    return formats.unit_counts(units)


@query("""WITH r AS (SELECT o_custkey AS page, o_orderkey AS id, (o_orderkey % 3) * 0.25 AS x0, 0.01 * (o_orderkey % 97) AS y0 FROM orders), s AS (SELECT *, x0 + 0.2 AS x1, y0 + 0.005 AS y1 FROM r), o AS (SELECT *, row_number() OVER w AS n, max(y1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM s WINDOW w AS (PARTITION BY page ORDER BY y0, x0, id)),
g AS (SELECT *, n > 4 AND y0 - bottom >= 0.02 AS gap FROM o), h AS (SELECT *, bool_or(gap) OVER (PARTITION BY page) AND NOT bool_or(gap) OVER (PARTITION BY page ORDER BY n ROWS UNBOUNDED PRECEDING) AS header FROM g),
c AS (SELECT *, max(x1) OVER (PARTITION BY page, header ORDER BY x0, y0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "right" FROM h), d AS (SELECT *, CASE WHEN header THEN sum(CASE WHEN x0 > coalesce("right", -1.0) + 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY page, header ORDER BY x0, y0, id) ELSE 0 END AS col FROM c)
SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY CASE WHEN header THEN 0 WHEN y0 >= 0.92 THEN 3 ELSE 1 END, col, y0, x0, id) AS INTEGER) AS position FROM d""")
def dense_forms(t: Tables):
    """Regions of one height and no margins. Places are whole hundredths as decimals, so both engines see the same gaps."""
    k = F.col("o_orderkey")
    x0, y0 = (k % 3 * F.expr("0.25BD")).cast("decimal(8,4)"), (k % 97 * F.expr("0.01BD")).cast("decimal(8,4)")
    r = t.orders.select(F.col("o_custkey").alias("page"), k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.expr("0.2BD")).alias("x1"), (y0 + F.expr("0.005BD")).alias("y1"))
    return windows.dense_form_order(r, ["page"])


@query("""SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3""")
def ranged_records(t: Tables):
    return formats.in_range(t.conversations, "turn", 1, 3).select("conv_id", "turn", "role")


@query("""WITH e AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders), m AS (SELECT o_custkey, string_agg(chr(CAST(97 + o_orderkey % 26 AS INTEGER)) || CASE WHEN o_orderkey % 2 = 0 THEN 'XYZ' ELSE '' END || '.', '' ORDER BY seq) AS said FROM e GROUP BY 1) SELECT * FROM m""")
def replaced_texts(t: Tables):
    """Each order gives two characters of a customer's text; of even ones the empty place between them takes three more."""
    e = windows.numbering(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "seq")
    letter = F.char(F.col("o_orderkey") % 26 + 97)
    texts = e.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", letter.alias("c")))), lambda x: F.concat(x["c"], F.lit("."))), "").alias("text"))
    at = (F.col("seq") * 2 - 1).cast("bigint")
    edits = e.where("o_orderkey % 2 = 0").select("o_custkey", at.alias("start"), at.alias("end"), F.lit("XYZ").alias("new"))
    return joins.apply_replacements(texts, edits, ["o_custkey"]).select("o_custkey", F.col("text").alias("said"))
