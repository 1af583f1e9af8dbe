"""Window, packing, top-k and segment queries. ``conversations`` plays ordered blocks of a document, ``orders`` candidates and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, joins, windows
from .registry import Tables, query


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n FROM conversations")
def element_numbering(t: Tables):
    return windows.numbering(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"])


@query("""WITH s AS (SELECT conv_id, turn, coalesce(length(text), 0) AS len, coalesce(sum(CASE WHEN length(text) > 0 THEN length(text) + 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN len > 0 THEN before END AS BIGINT) AS start, CAST(CASE WHEN len > 0 THEN before + len END AS BIGINT) AS "end" FROM s""")
def running_offsets(t: Tables):
    return windows.running_offsets(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "start", "end")


@query("""SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY lower(p_brand)) AS name_count, CAST(row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS INTEGER) AS name_no, CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS INTEGER) AS copy_no,
  CASE WHEN count(*) OVER (PARTITION BY lower(p_brand)) > 1 THEN p_brand || ' (' || row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) || ')' ELSE p_brand END AS display_name FROM part""")
def duplicate_occurrence(t: Tables):
    return windows.occurrences(t.part.select("p_partkey", "p_brand", "p_size"), "p_brand", ["p_brand", "p_size"], ["p_partkey"]).drop("p_size")


SEGMENTS_SQL = """seg AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey, o_orderpriority AS category, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence FROM orders),
s AS (SELECT doc_id, CASE WHEN o_orderkey % 23 = 0 THEN n * 2 ELSE n * 2 - 1 END AS start_page, n * 2 AS end_page, category, confidence, o_orderkey, n % 2 = 0 AS at_boundary FROM seg)"""


def _segments(t: Tables):
    s = windows.numbering(t.orders, ["o_custkey"], ["o_orderkey"])
    return s.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 23 == 0, F.col("n") * 2).otherwise(F.col("n") * 2 - 1).cast("bigint").alias("start_page"), (F.col("n") * 2).cast("bigint").alias("end_page"), F.col("o_orderpriority").alias("category"), ((F.col("o_orderkey") % 100).cast("double") / 100).alias("confidence"), "o_orderkey", (F.col("n") % 2 == 0).alias("at_boundary"))


@query(f"""WITH {SEGMENTS_SQL}, k AS (SELECT *, start_page = coalesce(lag(end_page) OVER (PARTITION BY doc_id ORDER BY start_page, end_page) + 1, 1) AND start_page <= end_page AS ok, 2 * count(*) OVER (PARTITION BY doc_id) AS n_pages FROM s)
SELECT doc_id, bool_and(ok) AS contiguous, max(end_page) = max(n_pages) AS reaches_end, count(*) AS n_segments FROM k GROUP BY doc_id""")
def segment_contiguity(t: Tables):
    s = _segments(t)
    return windows.contiguity(s.join(s.groupBy("doc_id").agg((2 * F.count(F.lit(1))).alias("n_pages")), "doc_id"), ["doc_id"], "n_pages")


@query(f"""WITH {SEGMENTS_SQL}, f AS (SELECT *, CASE WHEN at_boundary AND lag(end_page) OVER w + 1 = start_page AND lag(category) OVER w = category THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start_page)),
i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY doc_id ORDER BY start_page) AS BIGINT) AS island FROM f)
SELECT doc_id, island, min(start_page) AS start_page, max(end_page) AS end_page, first(category) AS category, min(confidence) AS confidence, list_sort(list(DISTINCT o_orderkey % 5)) AS evidence, count(*) > 1 AS needs_review FROM i GROUP BY doc_id, island""")
def merge_adjacent_segments(t: Tables):
    s = _segments(t).withColumn("evidence", F.array(F.col("o_orderkey") % 5))
    return windows.merge_segments(s, ["doc_id"]).withColumn("evidence", F.array_sort("evidence"))


HEADINGS_SQL = "h AS (SELECT conv_id, turn, CAST(CASE WHEN turn % 3 = 2 THEN NULL ELSE (conv_id * 7 + turn * turn * 5) % 6 + 1 END AS INTEGER) AS level, role || turn AS title FROM conversations)"


def _headings(t: Tables):
    return t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 != 2, (F.col("conv_id") * 7 + F.col("turn") * F.col("turn") * 5) % 6 + 1).cast("int").alias("level"), F.concat("role", F.col("turn").cast("string")).alias("title"))


@query(f"WITH {HEADINGS_SQL} SELECT a.conv_id, a.turn, a.level, (SELECT max(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level) AS parent FROM h a WHERE a.level IS NOT NULL")
def nearest_lower_heading(t: Tables):
    return windows.heading_parents(_headings(t).where("level IS NOT NULL"), ["conv_id"], "turn", "level").select("conv_id", "turn", "level", "parent")


@query(f"""WITH RECURSIVE {HEADINGS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM h),
r AS (SELECT conv_id, turn, i, []::VARCHAR[] AS section_path, CASE WHEN level IS NULL THEN []::VARCHAR[] ELSE [title] END AS after FROM n WHERE i = 1
  UNION ALL SELECT n.conv_id, n.turn, n.i, CASE WHEN n.level IS NULL THEN r.after ELSE r.after[1:least(len(r.after), n.level - 1)] END, CASE WHEN n.level IS NULL THEN r.after ELSE list_append(r.after[1:least(len(r.after), n.level - 1)], n.title) END FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)
SELECT conv_id, turn, section_path FROM r""")
def section_path(t: Tables):
    return windows.section_paths(_headings(t), ["conv_id"], "turn", "level", "title")


@query("""WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS nw FROM events),
i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f) SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, island""")
def runs_grouped(t: Tables):
    from pyspark.sql import Window

    same = F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return windows.islands(t.events, ["user_id"], ["ts", "event_id"], same).groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, length(text) * 40 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, CASE WHEN size > 48000 THEN NULL ELSE 0 END AS context, CASE WHEN size > 48000 THEN -1 ELSE 0 END AS top, CASE WHEN size > 48000 THEN 0 ELSE 1 END AS n, CASE WHEN size > 48000 THEN 0 ELSE size END AS held FROM p WHERE i = 1
  UNION ALL SELECT p.conv_id, p.turn, p.i, CASE WHEN p.size > 48000 THEN NULL WHEN r.n = 0 OR r.n >= 8 OR r.held + p.size > 48000 THEN r.top + 1 ELSE r.top END, CASE WHEN p.size > 48000 THEN r.top WHEN r.n = 0 OR r.n >= 8 OR r.held + p.size > 48000 THEN r.top + 1 ELSE r.top END,
    CASE WHEN p.size > 48000 THEN 0 WHEN r.n = 0 OR r.n >= 8 OR r.held + p.size > 48000 THEN 1 ELSE r.n + 1 END, CASE WHEN p.size > 48000 THEN 0 WHEN r.n = 0 OR r.n >= 8 OR r.held + p.size > 48000 THEN p.size ELSE r.held + p.size END FROM r JOIN p ON p.conv_id = r.conv_id AND p.i = r.i + 1)
SELECT conv_id, turn, CAST(context AS BIGINT) AS context, CAST(0 AS BIGINT) AS part FROM r""")
def chunk_packing(t: Tables):
    return folds.pack(t.conversations.select("conv_id", "turn", (F.length("text") * 40).alias("size")), "conv_id", "turn", "size", oversize="skip")


@query()
def context_packing(t: Tables):
    return folds.pack(t.conversations.select("conv_id", "turn", (F.length("text") * 40).alias("size")), "conv_id", "turn", "size")


@query("""WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 7 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS ra FROM c WHERE rn <= 3) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(ra AS INTEGER) AS in_all FROM k WHERE ra <= 8""")
def capped_topk(t: Tables):
    li = t.lineitem.withColumn("page", F.col("l_partkey") % 7)
    return joins.capped_topk(li, ["l_suppkey", "page"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 3, 8, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "in_all")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) - 1 AS ignored FROM orders WHERE o_orderstatus <> 'P') SELECT o_custkey, o_orderkey, ignored FROM c WHERE rn = 1""")
def first_grounded_value(t: Tables):
    c = t.orders.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start"), F.col("o_orderkey").alias("end"))
    return joins.first_value(c, ["o_custkey"]).select("o_custkey", "o_orderkey", "ignored")


@query("""WITH c AS (SELECT o_custkey, o_orderstatus AS name, o_orderpriority AS value, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, o_orderkey FROM orders),
b AS (SELECT *, max(rank) OVER (PARTITION BY o_custkey, name) AS best FROM c)
SELECT o_custkey, name, arg_min(value, (-rank, o_orderkey)) AS value, arg_min(o_orderkey, (-rank, o_orderkey)) AS page, count(DISTINCT CASE WHEN rank = best THEN value END) > 1 AS conflict FROM b GROUP BY 1, 2""")
def field_merge_ranked(t: Tables):
    c = t.orders.select("o_custkey", F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("value"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_orderkey").alias("page"), F.lit(0).alias("context"))
    return joins.merge_fields(c, ["o_custkey", "name"])


@query("""WITH x AS (SELECT *, coalesce('g' || CASE WHEN l_linenumber <= 4 THEN l_linenumber % 2 END, 's' || row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey)) AS g FROM lineitem),
gr AS (SELECT l_suppkey, g, min(l_extendedprice) AS f FROM x GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY f, g) - 1 AS item FROM gr)
SELECT l_suppkey, CAST(item AS INTEGER) AS item, count(*) AS n, min(l_extendedprice) AS first_start FROM x JOIN n USING (l_suppkey, g) GROUP BY 1, 2""")
def array_item_groups(t: Tables):
    c = t.lineitem.select("l_suppkey", F.col("l_extendedprice").alias("start"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("end"), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber") % 2).cast("string").alias("group_index"))
    return joins.array_items(c, ["l_suppkey"]).groupBy("l_suppkey", "item").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority LIKE '1%' AS hit FROM orders) SELECT a.o_custkey, a.o_orderkey FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE b.o_custkey = a.o_custkey AND b.hit AND abs(a.i - b.i) <= 1)""")
def neighbour_expansion(t: Tables):
    n = windows.numbering(t.orders, ["o_custkey"], ["o_orderkey"], "i")
    return joins.neighbour_expansion(n.where("o_orderpriority LIKE '1%'"), n.select("o_custkey", "o_orderkey", "i"), ["o_custkey"], "i").select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT k, 'missing' AS side FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'unused' FROM b ANTI JOIN a USING (k)""")
def missing_and_unused_keys(t: Tables):
    return joins.key_differences(t.customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), ["k"])


@query("""WITH r AS (SELECT DISTINCT o_custkey AS g, o_orderkey AS id, o_orderstatus AS e FROM orders WHERE o_orderkey % 37 <> 0),
d AS (SELECT o_custkey AS g, o_orderkey AS id, CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE o_orderstatus END AS e FROM orders WHERE o_orderkey % 43 <> 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 47 = 0 AND o_orderkey % 43 <> 0),
x AS (SELECT g, id, count(*) AS n, min(e) AS given FROM d GROUP BY 1, 2),
j AS (SELECT coalesce(r.g, x.g) AS o_custkey, CASE WHEN x.n IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'unexpected' WHEN x.n > 1 THEN 'duplicate' WHEN given IS DISTINCT FROM r.e THEN 'wrong evidence' END AS issue FROM r FULL JOIN x ON r.g = x.g AND r.id = x.id)
SELECT o_custkey, count(issue) AS n_issues, coalesce(list_sort(list(DISTINCT issue) FILTER (WHERE issue IS NOT NULL)), []) AS issues, count(issue) = 0 AS accepted FROM j GROUP BY 1""")
def decision_gate(t: Tables):
    base = t.orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("evidence_ref"))
    d = base.where("id % 43 <> 0").withColumn("evidence_ref", F.when(F.col("id") % 41 == 0, "x").otherwise(F.col("evidence_ref"))).unionByName(base.where("id % 47 = 0 AND id % 43 <> 0"))
    return joins.decision_gate(base.where("id % 37 <> 0"), d, ["o_custkey"])


@query("""WITH e AS (SELECT o_custkey AS doc_id, o_orderkey AS pointer, unnest([o_orderkey, o_orderkey + 1, o_orderkey + 7]) AS id, unnest([0, 1, 2]) AS pos FROM orders), a AS (SELECT o_custkey AS doc_id, o_orderkey AS id, o_orderpriority AS text FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS doc_id, o_orderkey AS id, o_orderstatus AS text FROM orders WHERE o_orderkey % 3 = 0)
SELECT doc_id, pointer, pos, id, CASE WHEN a.id IS NOT NULL THEN 'atom' WHEN b.id IS NOT NULL THEN 'block' ELSE 'unknown' END AS kind, coalesce(a.text, b.text) AS text FROM e LEFT JOIN a USING (doc_id, id) LEFT JOIN b USING (doc_id, id)""")
def evidence_resolution(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderstatus")
    e = o.select("doc_id", F.col("id").alias("pointer"), F.array("id", F.col("id") + 1, F.col("id") + 7).alias("ids"))
    return joins.resolve_evidence(e, o.where("id % 2 = 0").withColumnRenamed("o_orderpriority", "text"), o.where("id % 3 = 0").withColumnRenamed("o_orderstatus", "text"))


@query("""WITH l AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_custkey AS k, o_orderkey AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders WHERE o_orderstatus = 'O')
SELECT k, CAST(nth AS INTEGER) AS nth, o_orderkey, other FROM l FULL JOIN r USING (k, nth)""")
def claim_matching(t: Tables):
    left = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), "o_orderkey")
    right = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("other"), "o_orderdate")
    return joins.occurrence_match(left, right, ["k"], ["o_orderkey"], ["o_orderdate", "other"]).drop("o_orderdate")


@query("""WITH s AS (SELECT user_id AS doc_id, event_id AS id, CAST(floor(value * 100) AS BIGINT) AS a, CAST(floor(value * 100) AS BIGINT) + event_id % 50 + 1 AS b FROM events)
SELECT x.doc_id, x.id, count(*) AS n, CAST(sum(y.id) AS BIGINT) AS ids FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.a < y.b AND y.a < x.b GROUP BY 1, 2""")
def overlap_join(t: Tables):
    a = F.floor(F.col("value") * 100).cast("bigint")
    s = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), a.alias("start"), (a + F.col("event_id") % 50 + 1).alias("end"))
    right = s.select("doc_id", F.col("id").alias("other"), F.col("start").alias("start2"), F.col("end").alias("end2"))
    return joins.overlap_join(s, right, ["doc_id"]).groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("ids"))


@query("""WITH s AS (SELECT user_id AS doc_id, CAST(floor(value * 100) AS BIGINT) AS a, CAST(floor(value * 100) AS BIGINT) + event_id % 50 + 1 AS b FROM events), w AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
i AS (SELECT *, sum(CASE WHEN a <= m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT doc_id, CAST(island AS BIGINT) AS island, min(a) AS start, max(b) AS "end" FROM i GROUP BY 1, 2""")
def merged_intervals(t: Tables):
    a = F.floor(F.col("value") * 100).cast("bigint")
    return joins.merged_intervals(t.events.select(F.col("user_id").alias("doc_id"), a.alias("start"), (a + F.col("event_id") % 50 + 1).alias("end")), ["doc_id"])


@query("""WITH v AS (SELECT conv_id, turn, text, 10 + turn % 5 AS s, 40 + turn % 7 AS e FROM conversations), c AS (SELECT conv_id, turn, s + unnest(range(e - s)) AS p, text FROM v),
h AS (SELECT conv_id, turn, p, substr(text, p + 1, 1) AS ch, EXISTS (SELECT 1 FROM (VALUES (0, 20), (18, 30), (31, 44)) x(a, b) WHERE p >= a AND p < b) AS held FROM c)
SELECT conv_id, turn, bool_and(held OR ch IN (' ', chr(10), '')) AS covered FROM h GROUP BY 1, 2""")
def interval_coverage(t: Tables):
    v = t.conversations.select("conv_id", F.col("turn").alias("id"), "text", (10 + F.col("turn") % 5).alias("start"), (40 + F.col("turn") % 7).alias("end"))
    v = v.withColumn("text", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    spans = t.conversations.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for a, b in ((0, 20), (18, 30), (31, 44))])).alias("s")).select("conv_id", "s.*")
    return joins.covered(v, spans, ["conv_id"]).withColumnRenamed("id", "turn")


@query("""WITH s AS (SELECT c.conv_id, c.turn, c.text, ((c.conv_id + c.turn) % 3) + 1 AS start_page FROM conversations c) SELECT conv_id, turn, substr(text, 9, 32) AS "before", substr(text, 46, 32) AS "after" FROM s""")
def span_context(t: Tables):
    return windows.span_context(t.conversations.select("conv_id", "turn", "text", F.lit(40).alias("start"), F.lit(45).alias("end")), "text", "start", "end").select("conv_id", "turn", "before", "after")


@query("""WITH p AS (SELECT o_custkey, count(*) * 2 AS pages FROM orders GROUP BY 1), s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey FROM orders)
SELECT s.o_custkey, o_orderkey, unnest([2 * n - 1, 2 * n]) AS page FROM s""")
def pages_of_segments(t: Tables):
    s = windows.numbering(t.orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", (F.col("n") * 2 - 1).alias("start_page"), (F.col("n") * 2).alias("end_page"))
    pages = s.groupBy("o_custkey").agg(F.max("end_page").alias("m")).select("o_custkey", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("page"))
    return joins.pages_of_segments(s, pages, ["o_custkey"]).select("o_custkey", "o_orderkey", F.col("page").cast("bigint").alias("page"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(event_id % 40 AS BIGINT) * 10 AS s, CAST(event_id % 9 AS BIGINT) AS nl FROM (SELECT DISTINCT ON (user_id, event_id % 40) * FROM events ORDER BY user_id, event_id % 40, event_id) q)
SELECT user_id, event_id, CAST(s + d AS BIGINT) AS new_start, CAST(s + d + nl AS BIGINT) AS new_end FROM (SELECT *, coalesce(sum(nl - 5) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM e) z""")
def rebased_spans(t: Tables):
    e = t.events.groupBy("user_id", (F.col("event_id") % 40).alias("k")).agg(F.min("event_id").alias("event_id"))
    e = e.select("user_id", "event_id", (F.col("k") * 10).alias("start"), (F.col("k") * 10 + 5).alias("end"), (F.col("event_id") % 9).alias("new_length"))
    return windows.rebase_spans(e, ["user_id"]).select("user_id", "event_id", "new_start", "new_end")
