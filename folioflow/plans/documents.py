"""Scans, rendering, control tables, validation and streaming-shaped queries. ``pages`` plays HTML sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import models, validate, windows
from ..sources import formats, sinks
from ..streaming import jobs
from .registry import Tables, query


@query()
def html_blocks(t: Tables):
    return formats.html_records(t.pages, "page_id", "html")


@query()
def html_heading_parents(t: Tables):
    r = formats.html_records(t.pages, "page_id", "html").withColumn("level", F.regexp_extract("path", r"/h([1-6])\[\d+\]$", 1))
    return windows.heading_parents(r.where("level <> ''").withColumn("level", F.col("level").cast("int")), ["page_id"], "seq", "level").select("page_id", "seq", "level", "parent")


@query(r"SELECT page_id, length(html) AS html_chars, len(regexp_extract_all(html, '(?i)<(?:p|li|h[1-6])[ >]')) AS n_tags FROM pages")
def html_tag_counts(t: Tables):
    return t.pages.select("page_id", F.length("html").cast("bigint").alias("html_chars"), F.regexp_count("html", F.lit(r"(?i)<(?:p|li|h[1-6])[ >]")).cast("bigint").alias("n_tags"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS visible FROM pages""")
def visible_html(t: Tables):
    return t.pages.select("page_id", text.visible_html(F.col("html")).alias("visible"))


@query("""WITH p AS (SELECT conv_id, turn // 3 AS page, string_agg(CASE WHEN role = 'system' THEN '# ' || text WHEN role = 'user' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE length(text) > 0 GROUP BY 1, 2)
SELECT conv_id, string_agg(t, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY conv_id""")
def markdown_render(t: Tables):
    kind = F.expr("CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'list_item' ELSE 'paragraph' END")
    none = F.lit(None).cast("string")
    b = t.conversations.where("length(text) > 0").select("conv_id", F.floor(F.col("turn") / 3).alias("page"), "turn", sinks.body(kind, F.col("text"), none.cast("int"), none, none).alias("text"))
    return sinks.markdown(b, ["conv_id"], "page", "turn", "text")


@query("""WITH b AS (SELECT conv_id, turn, turn // 3 AS page, length(text) AS n FROM conversations WHERE length(text) > 0), g AS (SELECT *, CASE WHEN lag(page) OVER w IS NULL THEN 0 WHEN lag(page) OVER w = page THEN 2 ELSE 23 END AS gap FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY page, turn))
SELECT conv_id, turn, CAST(sum(gap + n) OVER (PARTITION BY conv_id ORDER BY page, turn) - n AS BIGINT) AS start, CAST(sum(gap + n) OVER (PARTITION BY conv_id ORDER BY page, turn) AS BIGINT) AS "end" FROM g""")
def emitted_spans(t: Tables):
    b = t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("page"), "text")
    return sinks.emitted_spans(b, ["conv_id"], "page", "turn", "text").select("conv_id", "turn", "start", "end")


@query("""WITH c AS (SELECT n_regionkey AS g, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS r, n_name, n_nationkey FROM nation), l AS (SELECT g, r, '| ' || n_name || ' | ' || n_nationkey || ' |' AS line FROM c)
SELECT g AS n_regionkey, min(CASE WHEN r = 0 THEN line END) || chr(10) || '| --- | --- |' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY r) FILTER (WHERE r > 0), '') AS markdown FROM l GROUP BY g""")
def table_markdown(t: Tables):
    n = windows.numbering(t.nation, ["n_regionkey"], ["n_nationkey"])
    cells = n.select("n_regionkey", (F.col("n") - 1).alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("n_name").alias("text")), F.struct(F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("text")))).alias("c")).select("n_regionkey", "row", "c.*")
    return sinks.table_markdown(cells, ["n_regionkey"])


@query("""WITH u AS (SELECT lower(p_brand) AS k, p_partkey AS version, p_brand, p_size FROM part) SELECT arg_max(p_brand, version) AS p_brand, max(version) AS version, arg_max(p_size, version) AS p_size FROM u GROUP BY k""")
def latest_wins_upsert(t: Tables):
    p = t.part.select("p_brand", F.col("p_partkey").alias("version"), "p_size")
    return sinks.upsert(p.where("version % 2 = 0"), p.where("version % 2 = 1"), ["p_brand"], "version")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 UNION ALL SELECT c_custkey, lower(c_name) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0""")
def table_sync(t: Tables):
    stored = t.customer.where("c_custkey % 3 = 0").select("c_custkey", "c_name")
    return sinks.sync(stored, t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lower("c_name").alias("c_name")), ["c_custkey"])


@query("""SELECT o_custkey, o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND d.o_orderkey = o.o_orderkey)""")
def incremental_skip(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("complete"))
    return jobs.skip_done(o.select("o_custkey", "o_orderkey"), o, ["o_custkey", "o_orderkey"])


@query("""SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""")
def event_windows(t: Tables):
    return jobs.event_windows(t.events).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, rule FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([CASE WHEN l_quantity < 45 THEN NULL ELSE 'quantity' END, CASE WHEN l_discount <= 0.08 THEN NULL ELSE 'discount' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem) q""")
def rule_violations(t: Tables):
    return validate.violations(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], {"quantity": F.col("l_quantity") < 45, "discount": F.col("l_discount") <= 0.08})


@query("""SELECT lower(p_name) AS p_name, count(*) AS n, 'unique names' AS rule FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_names(t: Tables):
    return validate.duplicates(t.part, ["p_name"], "unique names")


@query("""WITH u AS (SELECT event_type, sum(CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(event_id % 50 - 5, 0) END) AS i, CAST(count(*) FILTER (WHERE event_id % 9 = 0) AS BIGINT) AS unavailable FROM events GROUP BY 1) SELECT event_type, CAST(i AS BIGINT) AS input_tokens, unavailable FROM u""")
def recorded_usage(t: Tables):
    e = t.events.select("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 50 - 5).alias("input_tokens"), (F.col("event_id") % 3).alias("output_tokens"), F.lit(1).cast("bigint").alias("cached_input_tokens"))
    return models.recorded_usage(e).groupBy("event_type").agg(F.sum("input_tokens").alias("input_tokens"), F.count_if(~F.col("telemetry_available")).alias("unavailable"))


@query("""WITH b AS (SELECT conv_id, turn, role = 'user' AS is_heading, text FROM conversations), l AS (SELECT *, CASE WHEN lag(is_heading) OVER w THEN lower(regexp_replace(trim(lag(text) OVER w), ':$', '')) END AS h FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN h <> '' AND h = lower(regexp_replace(trim(split_part(text, chr(10), 1)), ':$', '')) THEN ltrim(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END) ELSE text END AS text FROM l""")
def heading_echo_removed(t: Tables):
    b = t.conversations.select("conv_id", "turn", (F.col("role") == "user").alias("is_heading"), "text")
    return windows.drop_repeated_first_line(b, ["conv_id"], ["turn"], "text", "is_heading").select("conv_id", "turn", "text")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn AS id, CASE WHEN turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS parent FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY id) AS nth FROM t),
w AS (SELECT conv_id, id, 0 AS depth, lpad(CAST(nth AS VARCHAR), 8, '0') AS path, CAST(nth AS VARCHAR) AS number FROM n WHERE parent IS NULL UNION ALL SELECT n.conv_id, n.id, w.depth + 1, w.path || '.' || lpad(CAST(nth AS VARCHAR), 8, '0'), w.number || '.' || nth FROM w JOIN n ON n.conv_id = w.conv_id AND n.parent = w.id)
SELECT conv_id, id AS block_id, depth, number, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) AS INTEGER) AS "position" FROM w""")
def tree_preorder(t: Tables):
    from ..operators import blocks

    b = t.conversations.select("conv_id", F.col("turn").alias("block_id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent_id"), F.col("turn").alias("reading_order"))
    return blocks.preorder(b, ["conv_id"])


@query("""SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS page_text FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id""")
def evaluation_text(t: Tables):
    from ..operators import blocks

    b = t.conversations.select("conv_id", F.col("turn").alias("block_id"), F.col("turn").alias("reading_order"), "text", F.when(F.col("role") == "system", "rejected").otherwise("verified").alias("status"))
    return blocks.page_texts(b, ["conv_id"])


@query("""WITH c AS (SELECT o_custkey, o_orderkey % 7 AS r, o_orderkey % 3 AS k, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS v FROM orders)
SELECT o_custkey, CASE WHEN max(r) + 1 < 2 OR max(k) + 1 < 2 THEN 0.25 ELSE (avg(CASE WHEN trim(v) <> '' THEN 1.0 ELSE 0.0 END) + count(DISTINCT (r, k)) / ((max(r) + 1) * (max(k) + 1))) / 2 END AS table_quality FROM c GROUP BY 1""")
def table_quality(t: Tables):
    from ..operators import blocks

    c = t.orders.select("o_custkey", (F.col("o_orderkey") % 7).alias("row"), (F.col("o_orderkey") % 3).alias("col"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("text"))
    return blocks.table_quality(c, ["o_custkey"])


@query("""SELECT user_id, count(*) FILTER (WHERE event_id % 4 > 0 AND event_type = 'view') AS full_page_calls, count(*) FILTER (WHERE event_id % 4 > 0 AND event_type = 'click') AS crop_calls, CAST(coalesce(sum(event_id % 100) FILTER (WHERE event_id % 4 > 0), 0) AS BIGINT) AS image_pixels,
  CAST(coalesce(sum(event_id % 100) FILTER (WHERE event_id % 4 > 0 AND event_type = 'click'), 0) AS BIGINT) AS crop_pixels, round(coalesce(sum((event_id % 100) / (event_id % 6)) FILTER (WHERE event_id % 4 > 0 AND event_id % 6 > 0), 0.0), 9) AS full_page_equivalents,
  count(*) FILTER (WHERE event_type <> 'view') AS repair_calls, CAST(count(DISTINCT event_id % 10) FILTER (WHERE event_type <> 'view') AS INTEGER) AS repaired_targets FROM events GROUP BY user_id""")
def run_telemetry(t: Tables):
    from ..operators import blocks

    e = t.events.select("user_id", (F.col("event_id") % 4).alias("image_count"), F.expr("CASE event_type WHEN 'view' THEN 'full_page' WHEN 'click' THEN 'crop_batch' ELSE 'other' END").alias("image_scope"), (F.col("event_id") % 100).alias("image_pixels"), (F.col("event_id") % 6).alias("source_page_pixels"), F.when(F.col("event_type") == "view", "page_draft").otherwise("repair").alias("action"), F.array(F.col("event_id") % 10).alias("target_ids"))
    return blocks.run_telemetry(e, ["user_id"]).withColumn("full_page_equivalents", F.round("full_page_equivalents", 9))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS confidence, o_orderstatus = 'F' AS risky, o_orderstatus = 'O' AS doubtful FROM orders)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN risky THEN 1 ELSE 2 END, confidence NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM b WHERE risky OR doubtful QUALIFY rank <= 3""")
def repair_order(t: Tables):
    from ..operators import blocks

    b = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("block_id"), F.col("o_orderkey").alias("reading_order"), F.when(F.col("o_orderkey") % 6 != 0, (F.col("o_orderkey") % 10).cast("double") / 10).alias("confidence"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("structure"))).otherwise(F.array().cast("array<string>")).alias("risks"), (F.col("o_orderstatus") == "O").alias("doubtful"))
    return blocks.repair_order(b, ["o_custkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query()
def lexical_retrieval(t: Tables):
    from ..operators import blocks

    e = t.conversations.select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "system", "heading").otherwise("paragraph").alias("type"), "text")
    return blocks.retrieve(e, "the order of the pages", ["conv_id"], k=3)


@query("""WITH l AS (SELECT conv_id, turn, trim(line) AS line, regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^[ |]+|[ |]+$', '', 'g') AS key, pos FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations) q),
h AS (SELECT conv_id, key, count(*) AS held FROM l WHERE turn % 2 = 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn * 100000 + pos) AS nth FROM l WHERE turn % 2 = 1)
SELECT conv_id, turn * 100000 + pos AS pos, line FROM o LEFT JOIN h USING (conv_id, key) WHERE nth > coalesce(held, 0) AND line <> ''""")
def residual_lines(t: Tables):
    from ..operators import blocks

    l = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("conv_id", "turn", (F.col("turn") * 100000 + F.col("p")).alias("pos"), "line")
    return blocks.residual_lines(l.where("turn % 2 = 1"), l.where("turn % 2 = 0"), ["conv_id"])
