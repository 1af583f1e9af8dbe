"""Text, similarity, geometry and JSON queries. ``benchmark`` plays reference texts, ``embeddings`` boxes, ``events.props`` JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, pointers, text
from ..operators import blocks, folds, joins
from .registry import Tables, query

FOLD_SQL = "replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ς', 'σ')"
WHITE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD_SQL = rf"regexp_extract_all({FOLD_SQL}, '[\p{{{{L}}}}\p{{{{N}}}}_]+(?:[-''’][\p{{{{L}}}}\p{{{{N}}}}_]+)*')"
TOKEN_SQL = "regexp_extract_all(lower({0}), '[A-Za-z0-9]+(?:[./:@_-][A-Za-z0-9]+)*')"


@query(f"SELECT doc_id, len({WORD_SQL.format('text')}) AS n_words, len(list_distinct({WORD_SQL.format('text')})) AS n_distinct FROM documents")
def semantic_word_counts(t: Tables):
    w = t.documents.select("doc_id", text.semantic_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


# the same text with accents apart, another final sigma and no-break spaces
APART_SQL = "replace(replace(replace(replace(replace(text, 'é', 'e' || chr(769)), 'ä', 'a' || chr(776)), 'ü', 'u' || chr(776)), 's ', 'ς' || chr(160)), chr(10), chr(8195))"


def _apart(c):
    for old, new in (("é", "e\u0301"), ("ä", "a\u0308"), ("ü", "u\u0308"), ("s ", "ς\u00a0"), ("\n", "\u2003")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


@query(f"SELECT doc_id, array_to_string({WORD_SQL.format(APART_SQL)}, ' ') AS words, trim(regexp_replace({FOLD_SQL.format(APART_SQL)}, '{WHITE_SQL}', ' ', 'g')) AS folded FROM documents")
def semantic_words_decomposed(t: Tables):
    c = _apart(F.col("text"))
    return t.documents.select("doc_id", F.array_join(text.semantic_words(c), " ").alias("words"), text.normal_folded(c).alias("folded"))


@query(f"SELECT conv_id, turn, {TOKEN_SQL.format('text')} AS tokens FROM conversations")
def literal_tokens(t: Tables):
    return t.conversations.select("conv_id", "turn", text.tokens(F.col("text")).alias("tokens"))


def _successors(t: Tables, first: str, second: str):
    """Every turn's text as ``first`` and its successor's as ``second``."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias(first))
    return a.join(t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias(second)), ["conv_id", "turn"])


@query(f"""WITH x AS (SELECT a.conv_id, a.turn, {TOKEN_SQL.format('a.text')} AS e, {TOKEN_SQL.format('b.text')} AS f FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT conv_id, turn, sum(least(c, len(list_filter(f, lambda y: y = k)))) AS met FROM (SELECT conv_id, turn, f, k, count(*) AS c FROM (SELECT conv_id, turn, f, unnest(e) AS k FROM x) q GROUP BY 1, 2, 3, 4) r GROUP BY 1, 2)
SELECT x.conv_id, x.turn, CASE WHEN len(e) = 0 THEN 1.0 ELSE round(met / len(e), 6) END AS coverage FROM x LEFT JOIN m USING (conv_id, turn)""")
def token_coverage_multiset(t: Tables):
    return _successors(t, "a", "b").select("conv_id", "turn", text.multiset_coverage(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("coverage"))


@query(f"""WITH RECURSIVE x AS (SELECT a.conv_id, a.turn, {TOKEN_SQL.format('a.text')} AS needle, {TOKEN_SQL.format('b.text')} AS hay FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
r AS (SELECT conv_id, turn, needle, hay, 0 AS p, 0 AS i FROM x UNION ALL SELECT conv_id, turn, needle, hay, p + 1, CASE WHEN i < len(needle) AND hay[p + 1] = needle[i + 1] THEN i + 1 ELSE i END FROM r WHERE p < len(hay))
SELECT conv_id, turn, len(needle) > 0 AND max(i) = len(needle) AS contained FROM r GROUP BY conv_id, turn, needle""")
def ordered_subsequence_flag(t: Tables):
    return _successors(t, "a", "b").select("conv_id", "turn", text.ordered_subsequence(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("contained"))


@query()
def critical_values(t: Tables):
    return t.documents.select("doc_id", text.critical_values(F.col("text")).alias("values"))


@query()
def garbage_ratio(t: Tables):
    return t.documents.select("doc_id", text.garbage_ratio(F.col("text")).alias("garbage"))


@query(r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS visible, regexp_matches(text, '\d|https?://|www\.|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_.-]+\.[A-Za-z]{2,}') AS critical FROM documents")
def visible_characters(t: Tables):
    return t.documents.select("doc_id", text.visible_characters(F.col("text")).cast("bigint").alias("visible"), text.has_critical_literal(F.col("text")).alias("critical"))


# DuckDB's levenshtein counts bytes, so the letters beyond ASCII take control characters there
LETTERS = "éèÉßêÑÈóüöÖñÊÄíçÇäÜáúàâîôûëï"


@query(f"""WITH c AS (SELECT item_id, text AS a, translate(text, '{LETTERS}', {" || ".join(f"chr({i + 1 if i < 8 else i + 3})" for i in range(len(LETTERS)))}) AS t FROM benchmark), r AS (SELECT item_id + 1 AS item_id, a AS b, t AS u FROM c)
SELECT item_id, levenshtein(t, u) AS distance, greatest(0.0, 1 - levenshtein(t, u) / length(b)) AS character_accuracy FROM c JOIN r USING (item_id) WHERE length(b) > 0""")
def char_accuracy(t: Tables):
    c = t.benchmark.select("item_id", F.col("text").alias("a"))
    r = c.select((F.col("item_id") + 1).alias("item_id"), F.col("a").alias("b"))
    d = c.join(r, "item_id").where(F.length("b") > 0).withColumn("d", F.levenshtein("a", "b"))
    return d.select("item_id", F.col("d").cast("bigint").alias("distance"), text.accuracy(F.col("d"), F.length("a"), F.length("b")).alias("character_accuracy"))


@query()
def word_accuracy(t: Tables):
    c = t.benchmark.select("item_id", text.semantic_words(F.col("text")).alias("a"))
    j = c.join(c.select((F.col("item_id") + 1).alias("item_id"), F.col("a").alias("b")), "item_id").withColumn("d", text.token_distance("a", "b")).withColumn("insertions", text.token_insertions("a", "b"))
    return j.select("item_id", "d", "insertions", text.accuracy(F.col("d"), F.size("a"), F.size("b")).alias("word_accuracy"), (F.col("insertions") / F.size("a")).alias("hallucination_rate"))


@query()
def ocr_similarity(t: Tables):
    return _successors(t, "a", "b").select("conv_id", "turn", text.ocr_similarity(F.col("a"), F.col("b")).alias("similarity"), text.ratio("a", "b").alias("ratio"))


@query(f"""WITH f AS (SELECT item_id, trim(regexp_replace({FOLD_SQL.format('text')}, '{WHITE_SQL}', ' ', 'g')) AS lit FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace({FOLD_SQL.format('text')}, '{WHITE_SQL}', ' ', 'g')) AS said FROM documents)
SELECT doc_id, CAST(count(item_id) AS BIGINT) AS forbidden FROM d LEFT JOIN f ON contains(said, lit) GROUP BY doc_id""")
def forbidden_literals(t: Tables):
    return blocks.forbidden_hits(t.documents, t.benchmark, "doc_id")


BOX_SQL = """boxes AS (SELECT vec_id, label, vec_id // 50 AS page, least(a, b) AS x0, least(c, d) AS y0, greatest(a, b) AS x1, greatest(c, d) AS y1, conf FROM (SELECT vec_id, label, (e[1] + 1) / 2 AS a, (e[2] + 1) / 2 AS b, (e[3] + 1) / 2 AS c, (e[4] + 1) / 2 AS d, (e[5] + 1) / 2 AS conf
  FROM (SELECT vec_id, label, list_transform(embedding[1:5], lambda v: least(greatest(round(CAST(v AS DOUBLE), 4), -1.0), 1.0)) AS e FROM embeddings) q) r)"""


def _boxes(t: Tables):
    e = F.transform(F.slice("embedding", 1, 5), lambda v: (F.least(F.greatest(F.round(v.cast("double"), 4), F.lit(-1.0)), F.lit(1.0)) + 1) / 2)
    b = t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("page"), e.alias("e"))
    low, high = (lambda i, j: F.least(F.col("e")[i], F.col("e")[j])), (lambda i, j: F.greatest(F.col("e")[i], F.col("e")[j]))
    return b.select("vec_id", "label", "page", low(0, 1).alias("x0"), low(2, 3).alias("y0"), high(0, 1).alias("x1"), high(2, 3).alias("y1"), F.col("e")[4].alias("conf"))


IOU_SQL = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"


@query(f"""WITH {BOX_SQL}, p AS (SELECT a.page, {IOU_SQL} AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM boxes a LEFT JOIN boxes b ON b.vec_id = a.vec_id + 1 AND b.page = a.page),
q AS (SELECT page, CASE WHEN s IS NULL OR s - i = 0 THEN 0.0 ELSE i / (s - i) END AS iou FROM p) SELECT page, round(avg(iou), 9) AS mean_iou, avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END) AS recall_at_half FROM q GROUP BY page""")
def box_iou_pairs(t: Tables):
    b = _boxes(t).select("page", F.col("vec_id").alias("id"), geometry.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))
    return joins.iou_recall(b.withColumn("id", F.col("id") - 1), b, ["page"]).withColumn("mean_iou", F.round("mean_iou", 9))


@query(f"WITH {BOX_SQL} SELECT a.page, a.vec_id AS id, b.vec_id AS other, round({IOU_SQL}, 9) AS overlap FROM boxes a JOIN boxes b ON a.page = b.page AND a.vec_id <> b.vec_id AND {IOU_SQL} > 0")
def spatial_neighbours(t: Tables):
    return joins.spatial_neighbours(_boxes(t).withColumnRenamed("vec_id", "id"), ["page"]).withColumn("overlap", F.round("overlap", 9))


@query(f"""WITH {BOX_SQL}, xs AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM (SELECT page, x0 AS x FROM boxes UNION SELECT page, x1 FROM boxes) q), ys AS (SELECT page, y, lead(y) OVER (PARTITION BY page ORDER BY y) AS ny FROM (SELECT page, y0 AS y FROM boxes UNION SELECT page, y1 FROM boxes) q)
SELECT p.page, round(coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM boxes b WHERE b.page = xs.page AND b.x0 <= xs.x AND b.x1 >= xs.nx AND b.y0 <= ys.y AND b.y1 >= ys.ny) THEN (nx - x) * (ny - y) ELSE 0 END), 0), 9) AS union_area FROM (SELECT DISTINCT page FROM boxes) p JOIN xs USING (page) JOIN ys USING (page) WHERE nx IS NOT NULL AND ny IS NOT NULL GROUP BY p.page""")
def union_area(t: Tables):
    return folds.union_area(_boxes(t), ["page"]).withColumn("union_area", F.round("union_area", 9))


@query()
def detector_dedup(t: Tables):
    r = _boxes(t).select("page", F.col("vec_id").alias("idx"), "label", F.col("conf").alias("confidence"), "x0", "y0", "x1", "y1")
    return folds.detector_dedup(r, ["page"])


@query()
def recovery_suppression(t: Tables):
    return folds.suppress(_boxes(t), ["page"], ["label", "vec_id"])


@query(f"""WITH {BOX_SQL}, c AS (SELECT page, r.vec_id AS id, sum(b.conf * (b.label + 1)) / sum(b.label + 1) AS m FROM (SELECT page, vec_id, x0 AS a0, y0 AS b0, x1 AS a1, y1 AS b1 FROM boxes) r JOIN boxes b USING (page) WHERE (b.x0 + b.x1) / 2 BETWEEN a0 AND a1 AND (b.y0 + b.y1) / 2 BETWEEN b0 AND b1 GROUP BY 1, 2)
SELECT page, id, round(m, 8) AS confidence FROM c""")
def centre_weighted_mean(t: Tables):
    b = _boxes(t)
    cells = b.select("page", "x0", "y0", "x1", "y1", F.col("conf").alias("confidence"), F.repeat(F.lit("x"), (F.col("label") + 1).cast("int")).alias("text"))
    regions = b.select("page", F.col("vec_id").alias("id"), F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"))
    return joins.centre_weighted_mean(cells, regions, ["page"])


@query("""SELECT event_id, '/' || k AS pointer, 'number' AS kind, CAST(CAST(json_extract_string(props, '$.' || k) AS DOUBLE) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) q""")
def json_leaves(t: Tables):
    return pointers.leaves(t.events, "event_id", "props")


@query("""WITH a AS (SELECT event_id AS doc_id, CAST(json_extract(props, '$.k') AS INTEGER) AS v FROM events), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN v + 1 ELSE v END AS w FROM a)
SELECT doc_id, CAST(CASE WHEN v = w THEN 1 ELSE 0 END AS BIGINT) AS exact_matches, CAST(v = w AS DOUBLE) AS "precision", CAST(v = w AS DOUBLE) AS recall, CAST(v = w AS DOUBLE) AS f1 FROM a JOIN b USING (doc_id)""")
def leaf_match(t: Tables):
    from ..operators import metrics

    e = t.events.select(F.col("event_id").alias("doc_id"), "props")
    changed = e.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct((pointers.lookup(F.col("props"), "/k", "int") + 1).alias("k")))).otherwise(F.col("props")).alias("props"))
    return metrics.leaf_scores(pointers.leaves(changed, "doc_id", "props"), pointers.leaves(e, "doc_id", "props"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def pointer_lookup(t: Tables):
    return t.events.select("event_id", pointers.lookup(F.col("props"), "/k", "bigint").alias("k"), pointers.lookup(F.col("props"), "/none").alias("missing"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN 'TRUE' WHEN 3 THEN '-' || (1000000000000000000 + event_id) WHEN 4 THEN '+9' || (9000000000000000000 + event_id) ELSE '1' || event_id || '.5' END AS s FROM events)
SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(s, '[+-]?\\d+') THEN s END AS BIGINT) AS as_integer, TRY_CAST(CASE WHEN regexp_full_match(s, '[+-]?\\d+(\\.\\d*)?') THEN s END AS DOUBLE) AS as_number, CASE WHEN lower(s) = 'true' THEN true WHEN lower(s) = 'false' THEN false END AS as_boolean FROM v""")
def literal_coercion(t: Tables):
    s = F.expr("CASE event_id % 6 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN event_type WHEN 2 THEN 'TRUE' WHEN 3 THEN concat('-', 1000000000000000000 + event_id) WHEN 4 THEN concat('+9', 9000000000000000000 + event_id) ELSE concat('1', event_id, '.5') END")
    return t.events.select("event_id", pointers.coerce(s, "integer").alias("as_integer"), pointers.coerce(s, "number").alias("as_number"), pointers.coerce(s, "boolean").alias("as_boolean"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'name' WHEN 2 THEN 'zz' ELSE 'count' END AS cls, 0 AS s, CASE WHEN turn % 5 = 0 THEN 400 ELSE 6 END AS e, text AS base FROM conversations),
g AS (SELECT *, CASE WHEN turn % 7 = 3 THEN 'nope!!' ELSE substr(base, s + 1, 6) END AS txt FROM c), p AS (SELECT *, CASE WHEN cls IN ('date', 'name', 'count') THEN '/' || cls END AS pointer FROM g)
SELECT conv_id, turn, CASE WHEN pointer IS NULL THEN 'unknown class' WHEN e > length(base) THEN 'bad interval' WHEN substr(base, s + 1, e - s) <> txt THEN 'text mismatch' WHEN regexp_replace(substr(txt, 6, 1), '\\s', '') <> '' THEN 'no source span' WHEN cls = 'count' AND NOT regexp_full_match(txt, '[+-]?\\d+') THEN 'bad literal' END AS reason FROM p""")
def grounded_candidates(t: Tables):
    base = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "conv_id", "turn", F.col("text").alias("base_text"))
    cls = F.expr("CASE turn % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'name' WHEN 2 THEN 'zz' ELSE 'count' END")
    c = base.select("doc_id", F.col("turn").alias("id"), cls.alias("class"), F.when(F.col("turn") % 7 == 3, "nope!!").otherwise(F.substring("base_text", 1, 6)).alias("text"), F.lit(0).cast("bigint").alias("start"), F.when(F.col("turn") % 5 == 0, 400).otherwise(6).cast("bigint").alias("end"))
    fields = t.spark.createDataFrame([("date", "/date", "string"), ("name", "/name", "string"), ("count", "/count", "integer")], "class string, pointer string, kind string")
    spans = base.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.lit(5).cast("bigint").alias("end"))
    out = joins.ground_candidates(c, fields, base.select("doc_id", "base_text"), spans)
    return out.join(base.select("doc_id", "conv_id", "turn"), "doc_id").select("conv_id", "turn", "reason")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256('{"Z":' || l_suppkey || ',"a":{"b":' || CASE WHEN l_partkey % 3 = 0 THEN 'null' ELSE CAST(l_partkey AS VARCHAR) END || ',"c":[' || l_linenumber || ',"x:1.0"]}}') AS sha FROM lineitem""")
def canonical_fingerprints(t: Tables):
    """Fields in two orders, numbers with and without a fraction, nulls: one hash."""
    part, other = F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey")), F.col("l_linenumber") % 2 == 0
    one = F.concat(F.lit('{ "a": {"c": ['), "l_linenumber", F.lit('.0, "x:1.0"], "b": '), F.coalesce(part.cast("string"), F.lit("null")), F.lit('}, "Z": '), "l_suppkey", F.lit("}"))
    two = F.concat(F.lit('{"Z":'), "l_suppkey", F.lit(',"a":{"b":'), F.coalesce(part.cast("string"), F.lit("null")), F.lit(',"c":['), "l_linenumber", F.lit(',"x:1.0"]}}'))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.sha2(pointers.canonical_json(F.when(other, one).otherwise(two)), 256).alias("sha"))
