"""Queries of citation, recognition, probe and numbering operators. ``orders`` and ``conversations`` play blocks, ``events`` elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import blocks, joins, models, windows
from .registry import Tables, query


@query("""SELECT user_id, event_id AS element_id, event_id % 7 AS page, event_type AS text FROM events WHERE event_id % 3 <> 0""")
def cited_elements(t: Tables):
    cited = t.events.select("user_id", F.col("event_id").alias("element_id"))
    known = t.events.where("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("element_id"), (F.col("event_id") % 7).alias("page"), F.col("event_type").alias("text"))
    return blocks.citations(cited, known, ["user_id"])


@query("""SELECT o_custkey, o_orderkey, s AS similarity FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 10) / 10 AS s FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderkey) = 1""")
def best_readings(t: Tables):
    pairs = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 10 / 10).alias("similarity"))
    return joins.best_match(pairs, ["o_custkey"], "similarity", "o_orderkey")


@query("""SELECT conv_id, list(turn ORDER BY turn)[-4:] AS tail FROM conversations GROUP BY 1""")
def history_tails(t: Tables):
    said = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("h"))
    return said.select("conv_id", blocks.history_tail(F.col("h"), 4).alias("tail"))


CROP_SQL = "(SELECT o_custkey, o_orderkey, o_orderkey % 3 AS p, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 10) / 10 END AS c FROM orders)"


@query(f"""SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank, CAST((rank - 1) // 2 AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, c ASC NULLS LAST, o_orderkey) AS rank FROM {CROP_SQL}) WHERE rank <= 5""")
def crop_requests(t: Tables):
    k = F.col("o_orderkey")
    r = t.orders.select("o_custkey", "o_orderkey", (k % 3).alias("priority"), F.when(k % 5 != 0, k % 10 / 10).alias("confidence"), k.alias("reading_order"), k.alias("block_id"))
    return blocks.crop_batches(r, ["o_custkey"], 2, 5).select("o_custkey", "o_orderkey", "rank", "batch")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 1 THEN (l_orderkey % 10) / 10 END, CASE WHEN l_linenumber % 3 <> 0 THEN 0.8::DOUBLE END, CASE WHEN l_orderkey % 4 <> 0 THEN 0.95::DOUBLE END) AS known FROM lineitem) SELECT * FROM s WHERE known < 0.85""")
def doubtful_literals(t: Tables):
    line, k = F.col("l_linenumber"), F.col("l_orderkey")
    s = t.lineitem.select("l_orderkey", "l_linenumber", F.when(line % 2 == 1, k % 10 / 10).alias("span_confidence"), F.when(line % 3 != 0, 0.8).alias("owner_confidence"), F.when(k % 4 != 0, 0.95).alias("block_confidence"))
    return blocks.literal_candidates(s).select("l_orderkey", "l_linenumber", "known")


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderstatus END AS content, CASE WHEN o_orderkey % 3 = 0 THEN 'no result' WHEN o_orderkey % 4 = 0 THEN 'timeout' END AS error FROM orders""")
def expected_pages(t: Tables):
    k = F.col("o_orderkey")
    pages = t.orders.select("o_custkey", "o_orderkey")
    got = t.orders.where(k % 3 != 0).select("o_custkey", "o_orderkey", F.when(k % 4 != 0, F.col("o_orderstatus")).alias("content"), F.when(k % 4 == 0, "timeout").alias("error"))
    return models.expected_pages(pages, got, ["o_custkey", "o_orderkey"])


@query("""SELECT o_custkey, count(*) AS n_regions, CASE WHEN count(*) > 10 THEN 'too many regions' END AS error FROM orders GROUP BY 1""")
def region_limits(t: Tables):
    return models.limited_regions(t.orders, ["o_custkey"], 10)


@query("""SELECT event_id, CAST(round_even((event_id % 11 + CASE WHEN event_id % 2 = 0 THEN 0.025::DOUBLE ELSE 0.05::DOUBLE + 0.95::DOUBLE * (event_id % 5) / greatest(event_id % 6, 1) END) * 1000, 0) AS BIGINT) AS done, CAST(12000 AS BIGINT) AS "of" FROM events WHERE event_id % 7 <> 0""")
def region_progress(t: Tables):
    k = F.col("event_id")
    e = t.events.select("event_id", F.when(k % 2 == 0, "layout").otherwise("region").alias("stage"), (k % 5).alias("current"), (k % 6).alias("total"), F.when(k % 7 != 0, k % 11).alias("page_position"), F.lit(12).alias("n_pages"))
    return models.region_progress(e).select("event_id", "done", "of")


@query("""SELECT o_orderkey, lower(o_orderstatus) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' b c' END AS said, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'native' END END AS route,
  CASE WHEN o_orderkey % 3 = 0 THEN 'asked' WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN 'annotated' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'synthetic_exact' ELSE 'generated' END AS basis,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 6 <> 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END ELSE least((o_orderkey % 10) / 10, CASE WHEN o_orderkey % 6 <> 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END) END AS confidence FROM orders""")
def block_columns(t: Tables):
    k = F.col("o_orderkey")
    even = k % 2 == 0
    routes = F.when(k % 5 != 0, F.concat(F.lit(" 1 : x,2: "), F.when(even, "ocr").otherwise("native"))).otherwise("1:x,oops")
    return t.orders.select(
        "o_orderkey", blocks.semantic_text(F.lower("o_orderstatus"), F.when(even, " \n ").otherwise(" b\t c ")).alias("said"), F.try_element_at(blocks.route_key(routes), F.lit(2)).alias("route"),
        blocks.reference_basis(F.when(k % 3 == 0, "asked"), F.when(k % 7 == 0, "annotated"), ~even, k % 5 == 0).alias("basis"),
        blocks.aggregated_confidence(F.when(k % 4 != 0, k % 10 / 10), F.array(F.lit(0.9), F.when(k % 6 != 0, 0.5).otherwise(None))).alias("confidence"),
    )


@query("""SELECT o_orderkey, risks, len(list_filter(risks, lambda x: x <> 'confidence')) > 0 AS repair FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN [] ELSE list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' END,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 OR o_orderkey % 3 = 1 AND o_orderkey % 4 <> 1 THEN 'structure' END, CASE WHEN (o_orderkey % 10) / 10 < 0.85 THEN 'confidence' END, CASE WHEN o_orderkey % 6 = 0 THEN 'geometry' END, CASE WHEN o_orderkey % 7 = 0 THEN 'degraded' END], lambda x: x IS NOT NULL) END AS risks FROM orders)""")
def structure_risks(t: Tables):
    k = F.col("o_orderkey")
    b = t.orders.select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'form_field' ELSE 'paragraph' END").alias("type"), F.when(k % 5 == 0, "rejected").otherwise("verified").alias("status"), (k % 10 / 10).alias("confidence"), geometry.box(F.lit(0.1), F.lit(0.1), F.when(k % 6 == 0, 0.1).otherwise(0.5), F.lit(0.5)).alias("box"))
    bad = blocks.incomplete(F.array(F.lit("a"), F.when(k % 4 == 0, " ").otherwise("b")), F.when(k % 4 == 1, "Name").when(k % 4 == 2, " "), F.lit("x"))
    risks = blocks.repair_risks(bad, F.col("box"), F.array(F.lit("fine"), F.when(k % 7 == 0, "Text is Illegible").otherwise("")))
    return b.select("o_orderkey", risks.alias("risks")).select("o_orderkey", "risks", blocks.requires_repair(F.col("risks")).alias("repair"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE 7 END AS INTEGER) AS idx, o_orderstatus AS label, o_orderpriority AS content, 0.1::DOUBLE AS x0, 0.4::DOUBLE AS y0, (10 + o_orderkey % 50) / 100 AS x1, 1.0::DOUBLE AS y1 FROM orders WHERE o_orderkey % 50 > 0""")
def recognised_regions(t: Tables):
    box = F.concat(F.lit("[10,20,"), (F.col("o_orderkey") % 50 + 10).cast("string"), F.lit(",60]"))
    one = F.concat(F.lit('[{"block_label":"'), "o_orderstatus", F.lit('","block_content":"'), "o_orderpriority", F.lit('","block_order":7,"block_bbox":'), box, F.lit("}]"))
    other = F.concat(F.lit('{"blocks":[{"label":"'), "o_orderstatus", F.lit('","content":"'), "o_orderpriority", F.lit('","bbox":'), box, F.lit("}]}"))
    result = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"parsing_res_list":'), one, F.lit("}"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"res":{"parsing_res_list":'), one, F.lit("}}"))).otherwise(other)
    pages = t.orders.select("o_orderkey", result.alias("result"), F.lit(100).alias("width"), F.lit(50).alias("height"))
    return models.recognised_regions(pages, ["o_orderkey"], "result", "width", "height")


@query("""SELECT DISTINCT o_custkey, 'visual' AS reason, (o_orderkey % 5) / 10 AS x1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 >= 2 AND o_orderstatus <> 'P'
UNION ALL SELECT o_custkey, 'interior', 0.9::DOUBLE FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 10 <= 7""")
def missing_region_probes(t: Tables):
    k = F.col("o_orderkey")
    b = t.orders.select("o_custkey", F.when(k % 3 == 0, "figure").otherwise("text").alias("type"), F.when(k % 4 == 0, " ").when(k % 2 == 1, "said").alias("text"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("ok").alias("status"), geometry.box(F.lit(0.0), F.lit(0.0), k % 5 / 10, F.lit(1.0)).alias("box"))
    covered = t.orders.select("o_custkey").distinct().withColumn("covered", F.col("o_custkey") % 10 / 10)
    return blocks.scan_probes(b, covered, ["o_custkey"]).select("o_custkey", "reason", F.col("box.x1").alias("x1"))


@query("""WITH n AS (SELECT conv_id, turn, text, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) AS n FROM conversations),
o AS (SELECT *, coalesce(sum(CASE WHEN size > 0 THEN size + 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT conv_id, turn, CAST(n AS INTEGER) AS element_order, CAST(CASE WHEN size > 0 THEN before END AS BIGINT) AS "start", CAST(CASE WHEN size > 0 THEN before + size END AS BIGINT) AS "end" FROM o""")
def native_elements(t: Tables):
    r = t.conversations.select(F.col("conv_id").alias("path"), F.lit("record").alias("kind"), F.concat(F.lit("unit "), F.col("turn") % 2).alias("unit_id"), F.col("turn").alias("seq"), F.lit("text").alias("type"), "text", F.col("turn").alias("anchor"))
    return blocks.native_document(r).select(F.col("path").alias("conv_id"), F.col("anchor").alias("turn"), "element_order", "start", "end")


@query("""SELECT c_custkey, list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'blank' END, CASE WHEN c_custkey % 150 < 100 THEN 'blur' END, CASE WHEN c_custkey % 4 = 0 OR 250 - c_custkey % 240 < 40 THEN 'low contrast' END], lambda x: x IS NOT NULL) AS problems FROM customer""")
def scan_problems(t: Tables):
    """Grey histograms of two levels: a dark one with no, or 10 to 30, pixels and a light one with 96."""
    k = F.col("c_custkey")
    grey = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(i == 250, 96).when(i == k % 240, k % 4 * 10).otherwise(0))
    pages = t.customer.select("c_custkey").repartition(4 * t.spark.sparkContext.defaultParallelism, "c_custkey")  # a small file, much work a row
    return pages.select("c_custkey", blocks.scan_quality(grey, k % 150).alias("problems"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey AS id, o_orderkey % 3 AS page, (o_orderkey % 10) / 10 AS confidence FROM orders),
a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey, page ORDER BY confidence, page, id) <= 2), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY confidence, page, id) <= 3)
SELECT o_custkey, id, CASE WHEN id % 4 = 0 THEN 'unavailable' WHEN id % 2 = 0 THEN 'agreed' ELSE 'disagreed' END AS outcome FROM b""")
def cross_checked(t: Tables):
    k = F.col("o_orderkey")
    c = t.orders.select("o_custkey", k.alias("id"), (k % 3).alias("page"), (k % 10 / 10).alias("confidence"), F.col("o_orderpriority").alias("text"))
    other = c.where("id % 4 <> 0").select("o_custkey", "page", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("other_index"), "text")
    other = other.select("o_custkey", "page", "id", "other_index", F.when((F.col("id") % 2 == 0) & (F.col("other_index") == 1), F.col("text")).otherwise("other").alias("other_text"))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return models.cross_check(c, other, ["o_custkey"], same, per_page=2, in_all=3).select("o_custkey", "id", "outcome")


@query("""WITH s AS (SELECT conv_id, turn AS element_id, turn % 3 + 1 AS level, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, CASE WHEN turn % 4 <> 0 THEN turn END NULLS LAST, turn) AS n FROM conversations)
SELECT conv_id, element_id, CAST(n AS INTEGER) AS n, CAST((SELECT max(p.n) FROM s AS p WHERE p.conv_id = s.conv_id AND p.n < s.n AND p.level < s.level) AS INTEGER) AS parent FROM s""")
def contents_tree(t: Tables):
    turn = F.col("turn")
    twice = t.conversations.select("conv_id", turn.alias("element_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), F.col("role").alias("title"), (turn % 3 + 1).alias("level"), F.when(turn % 4 != 0, turn).alias("order"), (turn % 2).alias("page"))
    said = twice.withColumn("title", F.when(F.col("seq") == 0, F.upper("title")).otherwise(F.col("title")))
    return blocks.toc(said, ["conv_id"]).select("conv_id", "element_id", "n", "parent")
