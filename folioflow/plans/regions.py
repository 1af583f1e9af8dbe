"""Queries of region, block, decision and validity operators. ``conversations`` plays blocks, ``orders`` keyed rows, ``embeddings`` boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import blocks, flows, joins, models, regions, validate, windows
from .registry import Tables, query
from .textual import BOX_SQL, _boxes

LABEL_SQL = "(['Table', 'formula', 'image', 'vertical_text', 'paragraph', 'seal', 'other'])[conv_id % 7 + 1]"


def _label(k):
    return F.element_at(F.array(*map(F.lit, ("Table", "formula", "image", "vertical_text", "paragraph", "seal", "other"))), (k % 7 + 1).cast("int"))


@query(f"""WITH r AS (SELECT conv_id, turn, {LABEL_SQL} AS label, coalesce(text, '') AS content, turn % 3 AS p, conv_id % 50 AS d FROM conversations),
t AS (SELECT *, CASE WHEN label = 'Table' THEN 'table' WHEN label = 'formula' THEN 'formula' WHEN label = 'image' THEN 'figure' WHEN label = 'vertical_text' THEN 'rotated_text' WHEN label = 'other' THEN 'unknown' WHEN length(content) - length(replace(content, ':', '')) >= 2 OR regexp_matches(content, '[☐☑□✓]') THEN 'form' ELSE 'text' END AS type,
  CASE WHEN p > 0 THEN degrees(atan2(d * 1.0, 200.0)) WHEN label = 'vertical_text' THEN 90.0 ELSE 0.0 END AS rotation FROM r)
SELECT conv_id, turn, type, round(rotation, 9) AS rotation, CASE WHEN type IN ('table', 'form', 'formula') THEN 'structured' WHEN type = 'figure' THEN 'visual' WHEN abs(rotation) >= 1 THEN 'rotated' ELSE 'simple_text' END AS complexity, CAST(0.1 AS DOUBLE) AS x0, least(1.0::DOUBLE, (turn + 1) / 10) AS x1 FROM t""")
def region_normalisation(t: Tables):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    edge = F.when(F.col("turn") % 3 > 0, F.array(point(F.lit(0), F.lit(0)), point(F.lit(2), F.col("conv_id") % 50 / 50)))
    raw = t.conversations.select("conv_id", "turn", _label(F.col("conv_id")).alias("label"), F.col("text").alias("content"), edge.alias("polygon"), F.lit(100).alias("width"), F.lit(50).alias("height"), ((F.col("turn") + 1) * 100.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(500.0).alias("y1"))
    n = regions.normalised_regions(raw)
    return n.select("conv_id", "turn", "type", F.round("rotation", 9).alias("rotation"), "complexity", F.col("box.x0").alias("x0"), F.col("box.x1").alias("x1"))


DRAFT_SQL = """d AS (SELECT conv_id AS page, turn AS idx, CASE WHEN role = 'user' THEN 'form_field' ELSE 'paragraph' END AS type, replace('a' || chr(173) || 'b: ' || text, chr(8203), '') AS said, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn / 10 END AS c, turn % 5 = 1 AS bad, turn % 7 = 2 AS spans FROM conversations)"""


@query(f"""WITH {DRAFT_SQL}, b AS (SELECT *, replace(said, chr(173), '') AS text FROM d)
SELECT 'p' || page || '-b' || (idx + 1) AS block_id, text, least(c, 0.55::DOUBLE) AS confidence, CASE WHEN type = 'form_field' THEN 'ab' END AS form_label, CASE WHEN type = 'form_field' THEN trim(substr(text, 4)) END AS form_value,
  CASE WHEN bad THEN 'invalid box' WHEN spans THEN 'invalid confidence evidence' END AS reason, CASE WHEN bad OR spans THEN 'needs_review' ELSE 'pending' END AS status, idx AS region_idx FROM b""")
def draft_blocks(t: Tables):
    """There and back: the region index is read from the block again."""
    d = t.conversations.select(F.col("conv_id").alias("page"), F.col("turn").alias("idx"), F.when(F.col("role") == "user", "form_field").otherwise("paragraph").alias("type"), F.concat(F.lit("a­b: "), "text").alias("text"), F.when(F.col("turn") % 4 != 0, F.col("turn") / 10).alias("confidence"), F.array(F.lit(0.55), F.lit(None).cast("double")).alias("part_confidences"), (F.col("turn") % 7 == 2).alias("invalid_spans"), geometry.box(F.lit(0.1), F.lit(0.1), F.when(F.col("turn") % 5 == 1, 1.5).otherwise(0.5), F.lit(0.2)).alias("box"))
    b = regions.blocks_of_regions(d)
    again = regions.regions_of_blocks(b).select(F.concat(F.lit("p"), "page", F.lit("-b"), F.col("idx") + 1).alias("block_id"), "idx")
    return b.join(again, "block_id").select("block_id", "text", "confidence", "form_label", "form_value", "reason", "status", F.col("idx").cast("bigint").alias("region_idx"))


@query(f"""WITH {BOX_SQL}, b AS (SELECT *, [x0, y0, x1, y1] AS b FROM boxes) SELECT vec_id, x1 - x0 > 0 AND y1 - y0 > 0 AS solid, x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AND x0 <= x1 AND y0 <= y1 AS valid,
  coalesce((x1 - x0) * (y1 - y0) = 0 OR y0 >= 0.999 OR x0 >= 0.999, true) AS clipped, CAST(greatest(floor((x0 - 0.01) * 640 + 1e-9), 0) AS INTEGER) AS crop_left, CAST(least(ceil((y1 + 0.01) * 480 - 1e-9), 480) AS INTEGER) AS crop_bottom, x0 AS poly_x0, y1 AS poly_y1 FROM b""")
def box_checks(t: Tables):
    b = _boxes(t).withColumn("box", geometry.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    crop = geometry.crop_pixels(F.col("box"), F.lit(640), F.lit(480), 0.01)
    around = geometry.polygon_box(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y0"), ("x0", "y1"), ("x0", "y0"))]))
    return b.select("vec_id", (geometry.area(F.col("box")) > 0).alias("solid"), geometry.valid(F.col("box")).alias("valid"), geometry.clipped(F.col("box")).alias("clipped"), crop["left"].alias("crop_left"), crop["bottom"].alias("crop_bottom"), around["x0"].alias("poly_x0"), around["y1"].alias("poly_y1"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'paragraph' WHEN 'system' THEN 'heading' ELSE 'table' END AS node, role = 'user' AND turn / 8 < 0.85 OR turn % 6 = 0 AS verify, role <> 'user' AND turn % 2 = 0 AS probe,
  CASE WHEN role <> 'system' AND turn % 3 >= 2 THEN 0 WHEN role = 'user' THEN 1 END AS priority, CASE WHEN role = 'assistant' THEN 512 WHEN turn > 3 THEN 256 ELSE 128 END AS allowance, CAST(floor(turn * 100 / 8 + 0.5) AS BIGINT) AS percent, CASE WHEN turn % 2 = 0 THEN 'layout' ELSE 'text' END AS other_engine FROM conversations""")
def block_predicates(t: Tables):
    role, turn = F.col("role"), F.col("turn")
    label = F.when(role == "user", "Text").when(role == "system", "Section_Title").otherwise("Table_body")
    c = t.conversations.select("conv_id", "turn", "role", models.node_type(label).alias("node"), F.when(role == "user", turn / 8).alias("confidence"), F.when(turn % 6 == 0, "needs_review").otherwise("verified").alias("status"), (turn % 3).alias("options"), F.when(role == "assistant", "table").when(role == "user", "form").otherwise("paragraph").alias("type"), F.lit("a").alias("text"))
    return c.select("conv_id", "turn", "node", blocks.needs_verification().alias("verify"), ((F.col("role") != "user") & (turn % 2 == 0)).alias("probe"), blocks.form_priority().alias("priority"), text.output_tokens(F.col("node"), turn / 100).alias("allowance"), text.half_up_percent(turn / 8).alias("percent"), flows.alternate_engine(F.when(turn % 2 == 0, "text").otherwise("layout")).alias("other_engine"))


@query(r"""WITH v AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[x] Yes:' WHEN 1 THEN '☐ No' WHEN 2 THEN 'X  Maybe' ELSE '- b' END AS s, '| a \| b |' || role || '|' AS row_, 'Inv ' || conv_id || '/a.b.pdf' AS f, '<|s|>```html' || chr(10) || '<p>' || role || '</p>' || chr(10) || '```' AS m, 'well-' || chr(10) || 'known ' || role AS w FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'checked' WHEN 1 THEN 'unchecked' WHEN 2 THEN 'checked' END AS state, CASE turn % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' ELSE '- b' END AS label, ['a \| b', regexp_extract(row_, '\|(\w+)\|$', 1)] AS cells, 'Inv-' || conv_id || '-a.b' AS stem, regexp_extract(m, '<p>.*</p>') AS cleaned, ['well-known', regexp_extract(w, '(\w+)$', 1)] AS joined FROM v""")
def text_marks(t: Tables):
    s = F.expr("CASE turn % 4 WHEN 0 THEN '[x] Yes:' WHEN 1 THEN '☐ No' WHEN 2 THEN 'X  Maybe' ELSE '- b' END")
    row = F.concat(F.lit("| a \\| b |"), "role", F.lit("|"))
    return t.conversations.select("conv_id", "turn", text.checkbox_state(s).alias("state"), text.checkbox_label(s).alias("label"), text.table_row_cells(row).alias("cells"), text.safe_name(F.concat(F.lit("Inv "), "conv_id", F.lit("/a.b.pdf"))).alias("stem"), text.clean_model_output(F.concat(F.lit("<|s|>```html\n<p>"), "role", F.lit("</p>\n```"))).alias("cleaned"), text.recovery_tokens(F.concat(F.lit("well-\nknown "), "role")).alias("joined"))


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Total - 5' WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'rest ' || turn ELSE 'step a)x rest' END ELSE 'Step a) x' END AS bare, role <> 'system' AND turn % 2 = 0 AS marked, CASE turn % 3 WHEN 0 THEN '[x]' WHEN 1 THEN '[ ]' ELSE '[?]' END AS mark, CASE WHEN turn % 2 = 0 THEN 'opt: ' || role ELSE role END AS option_text,
  CASE WHEN turn % 5 = 0 THEN 0 WHEN turn % 5 = 1 THEN 1 WHEN turn % 5 = 2 THEN 2 END AS severity FROM conversations""")
def marker_rules(t: Tables):
    body = F.expr("CASE role WHEN 'user' THEN 'Total - total - 5' WHEN 'assistant' THEN CASE WHEN turn % 3 = 0 THEN 'step A) Step a)\\t rest ' || turn ELSE 'STEP a) step a)x rest' END ELSE 'Step a) x' END")
    kind = F.when(F.col("role") == "user", "paragraph").when(F.col("role") == "assistant", "list_item").otherwise("paragraph")
    states = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i > F.element_at(F.array(*map(F.lit, (4, 3, 1, 0, 0))), (F.col("turn") % 5 + 1).cast("int")), "checked"))
    marked = regions.has_marker(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\t "), F.upper("role"), F.lit("\tsaid"))).otherwise(F.concat("role", F.lit("s"))), F.when(F.col("role") != "system", F.col("role")).otherwise("none"))
    return t.conversations.select("conv_id", "turn", regions.without_marker(body, kind, F.lit(" step a) ")).alias("bare"), marked.alias("marked"), regions.checkbox_mark(F.expr("CASE turn % 3 WHEN 0 THEN 'checked' WHEN 1 THEN 'unchecked' END")).alias("mark"), regions.checkbox_text(F.when(F.col("turn") % 2 == 0, "opt"), F.col("role")).alias("option_text"), regions.unresolved_severity(states).alias("severity"))


@query("""SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN ['a b', role, 'text'] WHEN 1 THEN list_distinct_in_order(['L', role, 'text']) WHEN 2 THEN list_filter(['[x]', role, 'text'], lambda x: x <> '') WHEN 3 THEN ['text', 'cap'] ELSE ['text', '-'] END AS said FROM conversations""".replace("list_distinct_in_order(['L', role, 'text'])", "['L', role, 'text']"))
def semantic_fragments(t: Tables):
    kind = F.expr("CASE turn % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'form_field' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'figure' ELSE 'list_item' END")
    role, none = F.col("role"), F.lit(None).cast("string")
    cell = lambda col, c: F.struct(F.lit(0).alias("row"), F.lit(col).alias("col"), c.alias("text"))
    said = regions.fragments(kind, F.lit("text"), F.array(cell(0, F.lit("a\nb")), cell(1, role), cell(2, F.lit(""))), F.struct(F.lit("L:").alias("label"), role.alias("value"), none.alias("hint")), F.struct(F.lit("checked").alias("state"), none.alias("group"), role.alias("option")), F.array(F.lit("cap"), F.lit("text")), F.lit(""))
    return t.conversations.select("conv_id", "turn", said.alias("said"))


RESIDUAL_SQL = """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_returnflag AS f, l_linestatus AS s, l_partkey % 5 AS p FROM lineitem),
own AS (SELECT k, n, 0 AS x, CASE p WHEN 0 THEN f || '|' || s WHEN 1 THEN f WHEN 2 THEN 'note ' || f WHEN 3 THEN f || '|' || s ELSE '' END AS key, CASE p WHEN 0 THEN '| ' || f || ' |  ' || s || ' |' WHEN 1 THEN f WHEN 2 THEN 'note  ' || f ELSE f || ' | ' || s END AS line FROM l WHERE p < 4
  UNION ALL SELECT k, n, 1, f || '|' || s, f || '|' || s FROM l WHERE p = 3),
held AS (SELECT k, key, max(c) AS c FROM (SELECT k, v AS key, count(*) AS c FROM (SELECT k, unnest([f, s]) AS v FROM l) q GROUP BY 1, 2 UNION ALL SELECT k, f || '|' || s, count(*) FROM l GROUP BY 1, 2) q GROUP BY 1, 2),
rest AS (SELECT own.k, 1 AS part, n * 2 + x AS pos, trim(line) AS said FROM (SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY n, x) AS nth FROM own) own LEFT JOIN held USING (k, key) WHERE nth > coalesce(c, 0)),
every AS (SELECT k, 0 AS part, n * 2 AS pos, f AS said FROM l UNION ALL SELECT k, 0, n * 2 + 1, s FROM l UNION ALL SELECT * FROM rest),
firsts AS (SELECT k, said, min((part, pos)) AS place FROM every GROUP BY k, said)
SELECT k AS l_orderkey, string_agg(said, ';' ORDER BY place) AS said FROM firsts GROUP BY k"""


@query(RESIDUAL_SQL)
def residual_fragments(t: Tables):
    """Tables whose text repeats their rows and cells, some oftener than they stand there, with other lines between."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = t.lineitem.withColumn("n", F.row_number().over(order))
    f, s, p = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_partkey") % 5
    both = F.concat(f, F.lit(" | "), s, F.lit("\r\n"), f, F.lit("|"), s)
    body = F.when(p == 0, F.concat(F.lit("| "), f, F.lit(" |  "), s, F.lit(" |"))).when(p == 1, f).when(p == 2, F.concat(F.lit("note  "), f)).when(p == 3, both).otherwise("  ")
    cells = F.array(F.struct(F.col("n").alias("row"), F.lit(0).alias("col"), f.alias("text")), F.struct(F.col("n").alias("row"), F.lit(1).alias("col"), s.alias("text")))
    tables = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", body.alias("b"), cells.alias("c")))).alias("r"))
    said = regions.fragments(F.lit("table"), F.array_join(F.transform("r", lambda x: x["b"]), "\n"), F.flatten(F.transform("r", lambda x: x["c"])), F.lit(None).cast("struct<label:string,value:string,hint:string>"), F.lit(None).cast("struct<state:string,group:string,option:string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))
    return tables.select("l_orderkey", F.array_join(said, ";").alias("said"))


@query("""WITH a AS (SELECT c_custkey AS doc_id, c_custkey AS anchor_id, 'x' || c_custkey AS said FROM customer), b AS (SELECT o_custkey AS doc_id, o_orderkey AS block_id, o_orderkey % 3 AS page, o_orderkey AS n, 'x' || o_custkey || '-' || o_orderstatus AS text FROM orders WHERE o_orderstatus <> 'P')
SELECT a.doc_id, anchor_id, arg_min(block_id, (page, n)) AS block_id FROM a JOIN b ON a.doc_id = b.doc_id AND contains(b.text, a.said) GROUP BY 1, 2""")
def anchor_claims(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("anchor_id"), F.concat(F.lit("x"), "c_custkey").alias("anchor_text"))
    b = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("block_id"), (F.col("o_orderkey") % 3).alias("page"), F.col("o_orderkey").alias("reading_order"), F.concat(F.lit("x"), "o_custkey", F.lit("-"), "o_orderstatus").alias("text"))
    return joins.claimed_anchors(b, a, ["doc_id"])


@query(f"""WITH {BOX_SQL} SELECT page, vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'seen' END AS status FROM boxes""")
def box_statuses(t: Tables):
    b = _boxes(t).select("page", F.col("vec_id").alias("id"), "x0", "y0", "x1", "y1")
    s = b.where("id % 3 <> 0").select("page", *[(F.col(c) + 1e-9).alias(c) for c in ("x0", "y0", "x1", "y1")], F.lit("seen").alias("status")).distinct()
    return joins.rounded_box_join(b, s, ["page"]).select("page", "id", "status")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders) SELECT o_custkey, bool_and(NOT (o_custkey % 4 = 0 AND pos = 2)) AS valid FROM n GROUP BY 1""")
def plan_order(t: Tables):
    n = windows.numbering(t.orders, ["o_custkey"], ["o_orderkey"], "pos").select("o_custkey", "pos", F.col("o_orderkey").alias("id"))
    return joins.same_sequence(n.withColumn("id", F.when((F.col("o_custkey") % 4 == 0) & (F.col("pos") == 2), -1).otherwise(F.col("id"))), n, ["o_custkey"])


@query("""SELECT o_custkey, o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN 'new' ELSE o_orderpriority END AS text, CASE o_orderkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'corrected' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'rejected' ELSE 'pending' END AS status FROM orders""")
def applied_decisions(t: Tables):
    b = t.orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.lit("pending").alias("status"))
    d = b.where("id % 5 < 4").select("o_custkey", "id", F.expr("CASE id % 5 WHEN 0 THEN 'accept' WHEN 3 THEN 'reject' ELSE 'correct' END").alias("action"), F.when(F.col("id") % 5 == 1, 0.9).otherwise(0.5).alias("confidence"), F.lit("new").alias("text"))
    return joins.apply_decisions(b, d, ["o_custkey"])


@query("""SELECT conv_id, turn, substr(text, 1, 2) || '<!-- element:e' || turn || ' -->' || substr(text, 3) AS text FROM conversations WHERE text IS NOT NULL""")
def element_marks(t: Tables):
    c = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", "text")
    spans = c.select("conv_id", "turn", F.least(F.lit(2), F.length("text")).cast("bigint").alias("start"), F.concat(F.lit("e"), "turn").alias("element_id"))
    return blocks.marked_text(spans, c, ["conv_id", "turn"])


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '/' || (o_orderkey % 4) WHEN o_orderkey % 4 = 1 THEN o_orderstatus || '/0' END AS article FROM orders""")
def wiki_links(t: Tables):
    names = t.orders.select("o_orderstatus").distinct().select(F.explode(F.array(F.lit("0"), F.lit("2"))).alias("k"), "o_orderstatus").select(F.concat("o_orderstatus", F.lit("/"), "k").alias("path"), F.col("o_orderstatus").alias("stem"))
    links = t.orders.select("o_custkey", "o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '/' || (o_orderkey % 4) WHEN o_orderkey % 4 = 1 THEN o_orderstatus ELSE 'none' END").alias("target"))
    return joins.with_fallback(links, names, "target").select("o_custkey", "o_orderkey", "article")


@query("""SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN 'no annotation' ELSE 'version differs' END AS rule FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 3 = 0 OR o_custkey % 5 = 0""")
def corpus_links(t: Tables):
    m = t.orders.select(F.col("o_custkey").alias("doc_id")).distinct().withColumn("version", F.lit(1))
    return validate.corpus_links(m, m.where("doc_id % 3 <> 0").withColumn("version", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1)))


@query("""SELECT o_custkey AS doc_id, o_orderkey AS page, CASE WHEN o_orderstatus = 'P' THEN 'missing route' ELSE 'route not allowed' END AS rule FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey % 2 = 0)""")
def route_checks(t: Tables):
    pages = t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("page_type"))
    asked = pages.where("page_type <> 'P'").select("doc_id", "page", F.when(F.col("page") % 2 == 0, "ocr").otherwise("native").alias("route"))
    return validate.routes(pages, asked, t.spark.createDataFrame([("F", "native"), ("O", "native"), ("O", "ocr")], "page_type string, route string"))


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'not_found' WHEN o_orderkey % 5 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM orders""")
def field_confidences(t: Tables):
    f = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_orderkey") % 5 == 0, "zz").otherwise(F.lower("o_orderpriority"))).alias("value"), F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("-"), F.concat(F.lit("said "), "o_orderpriority"))).alias("cited"))
    return joins.field_confidence(f).select("o_custkey", "o_orderkey", "confidence")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 5 AS a, 3 + o_orderkey % 9 AS b FROM orders), c AS (SELECT o_custkey, o_orderkey, greatest(a, 2) AS start_page, least(b, 6) AS end_page, a FROM s)
SELECT o_custkey, o_orderkey, start_page, end_page, CASE WHEN a >= start_page AND a <= end_page THEN 0.9::DOUBLE ELSE 0.0 END AS confidence FROM c WHERE start_page <= end_page""")
def clipped_predictions(t: Tables):
    s = t.orders.select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 5).alias("start_page"), (3 + F.col("o_orderkey") % 9).alias("end_page"), F.lit(2).alias("first_page"), F.lit(6).alias("last_page"), F.lit(0.9).alias("confidence"))
    s = s.withColumn("evidence", F.array(F.struct(F.lit("e").alias("id"), F.col("start_page").alias("page"))))
    return windows.clip_predictions(s).select("o_custkey", "o_orderkey", F.col("start_page").cast("bigint").alias("start_page"), F.col("end_page").cast("bigint").alias("end_page"), "confidence")


@query("""SELECT conv_id, turn, coalesce(lag(turn * 2 + 1) OVER (PARTITION BY conv_id ORDER BY turn), turn * 2) AS read_from FROM conversations""")
def overlapped_contexts(t: Tables):
    c = t.conversations.select("conv_id", "turn", (F.col("turn") * 2).alias("first_page"), (F.col("turn") * 2 + 1).alias("last_page"))
    return windows.overlapped_windows(c, ["conv_id"], "turn").select("conv_id", "turn", "read_from")


@query("""SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def suppressed_repeats(t: Tables):
    return windows.suppress_repeats(t.events, ["user_id"], ["ts", "event_id"], F.lower("event_type")).select("user_id", "event_id")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, (o_orderkey % 10) / 10 AS c FROM orders)
SELECT o_custkey, round(avg(c), 6) AS semantic_coverage, list_filter([CASE WHEN bool_or(s = 'P') THEN 'rejected_content' END, CASE WHEN bool_or(s = 'F') THEN 'block_needs_review' END, CASE WHEN bool_or(o_orderkey % 7 = 0) THEN 'incomplete_structure' END, CASE WHEN bool_or(c < 0.9) THEN 'semantic_coverage_loss' END, CASE WHEN bool_or(o_orderkey % 11 = 0) THEN 'geometry_loss' END], lambda x: x IS NOT NULL) AS reasons FROM b GROUP BY 1""")
def page_quality(t: Tables):
    b = t.orders.select("o_custkey", F.expr("CASE o_orderstatus WHEN 'P' THEN 'rejected' WHEN 'F' THEN 'needs_review' ELSE 'verified' END").alias("status"), (F.col("o_orderkey") % 10 / 10).alias("coverage"), (F.col("o_orderkey") % 7 == 0).alias("bad_structure"), F.when(F.col("o_orderkey") % 11 != 0, F.lit(1)).alias("box"))
    return blocks.page_quality(b, ["o_custkey"])


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS idx, CASE o_orderkey % 5 WHEN 0 THEN 'Table' WHEN 1 THEN 'TABLE' ELSE 'text' END AS label, CASE WHEN o_orderkey % 7 = 0 THEN chr(9) || '  ' ELSE o_orderpriority || repeat('x', CAST(o_orderkey % 4 AS INTEGER)) END AS content, o_orderstatus AS s FROM orders)
SELECT o_custkey, coalesce(arg_max(content, (length(content), -idx)) FILTER (WHERE lower(label) = 'table' AND idx % 7 > 0), string_agg(content, chr(10) ORDER BY idx) FILTER (WHERE idx % 7 > 0), '') AS content, CAST(count(*) FILTER (WHERE s = 'O') AS BIGINT) AS n_tables FROM r GROUP BY 1""")
def recovered_content(t: Tables):
    """Tables of several lengths and spellings, blank ones among them; customers without one give all their texts."""
    k = F.col("o_orderkey")
    label = F.when(k % 5 == 0, "Table").when(k % 5 == 1, "TABLE").otherwise("text")
    r = t.orders.select("o_custkey", k.alias("idx"), label.alias("label"), F.when(k % 7 == 0, "\t  ").otherwise(F.concat("o_orderpriority", F.repeat(F.lit("x"), (k % 4).cast("int")))).alias("content"))
    b = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "O", "table").otherwise("text").alias("type"), F.lit("ok").alias("status"), k.alias("reading_order"), k.alias("block_id"))
    n = blocks.candidate_tables(b, ["o_custkey"]).groupBy("o_custkey").agg((F.max("ordinal") + 1).cast("bigint").alias("n"))
    return blocks.recovery_content(r, ["o_custkey"]).join(n, "o_custkey", "left").select("o_custkey", "content", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_tables"))


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + o_orderkey % 4) AS BIGINT) AS n_missing FROM orders GROUP BY 1""")
def missing_boxes(t: Tables):
    box = F.struct(F.lit(0.1).alias("x0"))
    lost = lambda n: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.when(i > n, box).alias("box")))
    d = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, box).alias("box"), lost(F.col("o_orderkey") % 4).alias("cells"), F.array(F.struct(box.alias("box"))).alias("atoms"))
    return regions.missing_boxes(d, ["o_custkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'native-v5' ELSE 'legacy-v4' END AS kind, o_orderpriority AS markdown, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey WHEN o_orderkey % 2 = 0 THEN 0 END AS input_tokens, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'base' END END AS base_markdown FROM orders""")
def stored_results(t: Tables):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "native-v5").otherwise("legacy-v4")
    s = t.orders.select("o_orderkey", regions.stored_result(kind, F.lit("{}"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")), F.lit(1), F.when(F.col("o_orderkey") % 5 != 0, "base")).alias("json"))
    return s.select("o_orderkey", regions.read_result(F.col("json")).alias("r")).select("o_orderkey", "r.kind", "r.markdown", "r.input_tokens", "r.base_markdown")


@query("""SELECT p_partkey, trim(p_brand) AS key, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_mfgr END AS schema_name, p_size % 2 = 0 AS extract FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 1 AND p_size % 3 = 0 THEN ' ' ELSE p_brand END AS p_brand, 'm' || p_size AS p_mfgr FROM part) WHERE trim(p_brand) <> '' OR p_size % 3 <> 0 OR p_size % 2 = 0""")
def drafted_profiles(t: Tables):
    size = F.col("p_size")
    rows = t.part.select("p_partkey", F.when((size % 2 == 1) & (size % 3 == 0), " ").otherwise(F.concat(F.lit(" "), "p_brand")).alias("key"), F.lit(None).cast("string").alias("description"), F.when(size % 2 == 0, F.lit(True)).alias("extract"), F.when(size % 3 != 0, F.concat(F.lit("m"), "p_size")).otherwise(" ").alias("schema_name"))
    return regions.profile_categories(rows).select("p_partkey", "key", "schema_name", "extract")


@query("""SELECT conv_id || '/' || CASE WHEN turn % 4 = 0 THEN 'Threat-Model.md' ELSE 'a.md' END AS path, turn, 'snapshot: S1' || chr(10) || 'snapshot: old' || chr(10) || '## H ' || role || chr(10) AS text, ['H ' || role] AS headings, turn % 4 = 0 AS is_security FROM conversations""")
def refreshed_articles(t: Tables):
    a = t.conversations.select(F.concat("conv_id", F.lit("/"), F.when(F.col("turn") % 4 == 0, "Threat-Model.md").otherwise("a.md")).alias("path"), "turn", F.concat(F.lit("snapshot: x\nsnapshot: old\n## H "), "role", F.lit("\n")).alias("text"))
    r = regions.refreshed_articles(a.withColumn("path", F.concat_ws("#", "turn", "path")), "S1")
    return r.select(F.substring_index("path", "#", -1).alias("path"), F.substring_index("path", "#", 1).cast("bigint").alias("turn"), "text", "headings", "is_security")


@query("""SELECT o_custkey, count(*) AS n_blocks, avg(o_totalprice) AS mean_price, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN ['review'] ELSE [] END AS unavailable FROM orders GROUP BY 1""")
def scorecards(t: Tables):
    docs = t.orders.select("o_custkey").distinct()
    counted = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("o_totalprice").alias("mean_price"))
    s = regions.scorecard(docs, {"blocks": counted, "review": t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))}, "o_custkey")
    return s.select("o_custkey", "blocks.n_blocks", "blocks.mean_price", "unavailable")


@query("""SELECT o_custkey, count(*) AS n_blocks, arg_min(o_orderpriority, (o_orderkey % 3, o_orderkey)) AS first_text FROM orders GROUP BY 1""")
def model_contexts(t: Tables):
    b = t.orders.select("o_custkey", (F.col("o_orderkey") % 3).alias("page"), F.col("o_orderkey").alias("reading_order"), F.col("o_orderkey").cast("string").alias("block_id"), F.lit("text").alias("type"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("array<struct<id:string,text:string>>").alias("atoms"))
    c = regions.model_context(b, "o_custkey")
    return c.select("o_custkey", F.json_array_length("layout").cast("bigint").alias("n_blocks"), F.get_json_object("layout", "$[0].text").alias("first_text"))


@query("""SELECT run_id, bool_and(t = 0) AS local_only FROM (SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id % 2 END AS t FROM events) GROUP BY 1""")
def local_runs(t: Tables):
    return models.without_ai(t.events.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("event_id") % 2).alias("input_tokens"), F.lit(0).alias("output_tokens")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, (o_orderkey % 10) / 20 AS x0, o_orderkey % 4 AS k FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE x0 + 0.3 <= 0.55) >= 2 AND count(*) FILTER (WHERE x0 >= 0.45) >= 2 AS two_columns, round(0.03::DOUBLE * count(*) FILTER (WHERE k = 0), 9) AS table_area, round(0.03::DOUBLE * count(*) FILTER (WHERE k = 1), 9) AS picture_area FROM r GROUP BY 1""")
def page_features(t: Tables):
    x = F.col("o_orderkey") % 10 / 20
    r = t.orders.select("o_custkey", F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Table' WHEN 1 THEN 'Figure' ELSE 'text' END").alias("label"), x.alias("x0"), F.lit(0.2).alias("y0"), (x + 0.3).alias("x1"), F.lit(0.3).alias("y1"))
    c = models.complexity(r, ["o_custkey"])
    return c.select("o_custkey", "two_columns", F.round("table_area", 9).alias("table_area"), F.round("picture_area", 9).alias("picture_area"))


@query("""SELECT o_custkey, o_orderkey AS segment_id, CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE 'confirmed' END AS review_status, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS number FROM orders""")
def reviewed_segments(t: Tables):
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("segment_id"), F.col("o_orderkey").alias("start_page"), F.col("o_orderkey").alias("end_page"), F.col("o_orderstatus").alias("category"))
    e = o.withColumn("category", F.when(F.col("segment_id") % 5 == 0, "other").otherwise(F.col("category")))
    return models.reviewed_segments(o.where("segment_id % 3 <> 0"), e, ["o_custkey"]).select("o_custkey", "segment_id", "review_status", "number")


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS text, o_orderkey % 3 = 0 AS refined FROM orders""")
def refined_texts(t: Tables):
    base = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("text"))
    return models.with_fallback(t.orders.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("text")), base, ["o_custkey", "o_orderkey"], "text")
