"""Queries of instance validation, traced requests and rules as rows. Orders with their line items play JSON documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, instances, metrics, validate
from ..sources import stores
from .registry import Tables, query

_S = lambda kind, *more: {"type": [kind, *more]}
_LINE = {"type": ["object", "null"], "properties": {"no": _S("integer"), "qty": _S("number", "null"), "a/b": _S("string", "null")}, "required": ["no", "qty", "a/b"], "additionalProperties": False}
SCHEMA = {
    "type": "object",
    "properties": {"id": _S("integer"), "status": {"type": ["string", "null"], "enum": ["O", "F"]}, "open": _S("boolean", "null"), "lines": {"type": ["array", "null"], "items": _LINE}, "tags": {"type": ["array", "null"], "items": {"type": ["array", "null"], "items": _S("string", "null")}}},
    "required": ["id", "status", "open", "lines", "tags"], "additionalProperties": False,
}


def _documents(t: Tables):
    """One JSON text an order, wrong in ways that its numbers choose."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    no = F.when(p % 5 == 0, F.concat(F.lit('"'), n, F.lit('"'))).when(p % 5 == 1, F.concat(n, F.lit(".0"))).otherwise(n.cast("string"))
    qty = F.when(p % 7 == 0, "null").when(p % 7 == 1, "true").when(p % 7 == 2, "3").otherwise("1.5e1")
    line = F.when(p % 11 == 0, F.lit("null")).when(p % 11 == 1, F.concat(F.lit("["), n, F.lit("]"))).otherwise(F.concat(F.lit('{"no":'), no, F.when(p % 3 == 0, "").otherwise(F.concat(F.lit(', "qty" : '), qty)), F.lit(',"a/b":"x"'), F.when(p % 13 == 0, ',"*":[{"deep":1}]').otherwise(""), F.lit("}")))
    lines = t.lineitem.withColumn("i", F.row_number().over(order) - 1).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), ",").alias("l"))
    k = F.col("o_orderkey")
    status = F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))
    whole = F.concat(F.lit('{"status":'), status, F.when(k % 4 == 0, ',"id":null').otherwise(F.concat(F.lit(',"id":'), k)), F.lit(',"open":'), F.when(k % 6 == 0, '"yes"').otherwise("false"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit(',"lines":['), "l", F.lit("]"))), F.lit(',"tags":'), F.when(k % 5 == 0, '[["a",1],null,"b"]').otherwise("[]"), F.when(k % 10 == 3, "").otherwise("}"))
    return t.orders.join(lines, "o_orderkey").select("o_orderkey", F.lit("order").alias("schema"), whole.alias("document"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i, l_partkey AS p FROM lineitem JOIN o ON k = l_orderkey WHERE k % 10 <> 3 AND k % 9 <> 0),
full_ AS (SELECT * FROM l WHERE p % 11 > 1)
SELECT k AS o_orderkey, pointer, problem FROM (
  SELECT k, '/' AS pointer, 'no JSON' AS problem FROM o WHERE k % 10 = 3
  UNION ALL SELECT k, '/id', 'null is not allowed' FROM o WHERE k % 10 <> 3 AND k % 4 = 0
  UNION ALL SELECT k, '/status', 'value is not in enum' FROM o WHERE k % 10 <> 3 AND s NOT IN ('O', 'F')
  UNION ALL SELECT k, '/open', 'expected boolean' FROM o WHERE k % 10 <> 3 AND k % 6 = 0
  UNION ALL SELECT k, '/lines', 'missing' FROM o WHERE k % 10 <> 3 AND k % 9 = 0
  UNION ALL SELECT k, '/tags/0/1', 'expected string' FROM o WHERE k % 10 <> 3 AND k % 5 = 0
  UNION ALL SELECT k, '/tags/2', 'expected array' FROM o WHERE k % 10 <> 3 AND k % 5 = 0
  UNION ALL SELECT k, '/lines/' || i, 'expected object' FROM l WHERE p % 11 = 1
  UNION ALL SELECT k, '/lines/' || i || '/no', 'expected integer' FROM full_ WHERE p % 5 < 2
  UNION ALL SELECT k, '/lines/' || i || '/qty', 'missing' FROM full_ WHERE p % 3 = 0
  UNION ALL SELECT k, '/lines/' || i || '/qty', 'expected number' FROM full_ WHERE p % 3 <> 0 AND p % 7 = 1
  UNION ALL SELECT k, '/lines/' || i || '/*', 'unexpected' FROM full_ WHERE p % 13 = 0) q""")
def instance_problems(t: Tables):
    return instances.instance_problems(_documents(t), instances.rules(t.spark, {"order": SCHEMA}), "o_orderkey", "schema", "document")


def _model():
    """Answers in place of a language model: some right at once, some only when told what was wrong, some never, some not at all."""

    def answer(row: dict) -> dict:
        k, first = row["o_custkey"], row["attempt"] == 1
        if k % 7 == 0:
            raise RuntimeError("timeout")
        if k % 7 == 1 and first:
            raise ValueError("no schema-valid result")
        bad = k % 3 == 0 and first or k % 5 == 0
        assert first == (row["problems"] is None)
        return {"document": '{"n": "%d"}' % k if bad else '{"n": %d}' % k, "input_tokens": 100 + row["attempt"], "output_tokens": k % 10}

    return answer


@query("""WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders), one AS (SELECT k, 1 AS attempt, CASE WHEN k % 7 = 0 THEN 'failed' WHEN k % 7 = 1 OR k % 3 = 0 OR k % 5 = 0 THEN 'schema_invalid' ELSE 'completed' END AS status, CASE WHEN k % 7 < 2 THEN 0 WHEN k % 3 = 0 OR k % 5 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN k % 7 > 1 THEN 101 END AS i FROM c),
two AS (SELECT k, 2, CASE WHEN k % 5 = 0 THEN 'schema_invalid' ELSE 'completed' END, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, 102 FROM one WHERE status = 'schema_invalid'), every AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT k AS o_custkey, CAST(attempt AS INTEGER) AS attempt, status, CAST(n AS BIGINT) AS n_problems, CAST(i AS BIGINT) AS input_tokens, CASE WHEN status <> 'completed' THEN NULL ELSE '{"n": ' || k || '}' END AS document FROM every""")
def traced_requests(t: Tables):
    """One row an attempt, with the document where it completed the request."""
    schema = {"type": "object", "properties": {"n": {"type": ["integer", "null"]}}, "required": ["n"], "additionalProperties": False}
    asked = t.orders.select("o_custkey", F.lit("n").alias("schema")).distinct()
    answers, trace = instances.structured_requests(asked, _model, instances.rules(t.spark, {"n": schema}), "o_custkey", "schema")
    done = trace.where("status = 'completed'").join(answers, "o_custkey").select("o_custkey", "attempt", "document")
    return trace.join(done, ["o_custkey", "attempt"], "left").select("o_custkey", "attempt", "status", F.col("n_problems").cast("bigint").alias("n_problems"), "input_tokens", "document")


@query("""WITH r AS (SELECT o_custkey AS k, o_orderpriority AS kind, avg(o_totalprice) AS c, count(*) AS n, min(o_totalprice) AS b FROM orders GROUP BY ALL),
j AS (SELECT 'price' AS name, '/prices/0/mean' AS path, k, kind, c, b, true AS c_num, false AS up, NULL::DOUBLE AS low, 250000.0::DOUBLE AS high, 20000.0::DOUBLE AS slack, kind <> '5-LOW' AS base FROM r
  UNION ALL SELECT 'orders', '/a~1b/n', k, kind, n, 1, n % 4 > 0, true, 2, NULL, NULL, true FROM r WHERE kind = '1-URGENT'
  UNION ALL SELECT 'none', '/missing', k, kind, NULL, NULL, NULL, true, 1, NULL, NULL, true FROM r WHERE kind = '2-HIGH'),
t AS (SELECT *, c IS NOT NULL AND c_num AS usable FROM j),
u AS (SELECT *, CASE WHEN usable THEN (low IS NULL OR c >= low) AND (high IS NULL OR c <= high) ELSE true END AS absolute_passed, CASE WHEN usable AND slack IS NOT NULL THEN base AND c <= b + slack END AS regression_passed FROM t),
v AS (SELECT *, CASE WHEN name = 'none' THEN 'candidate metric is missing' WHEN NOT c_num THEN 'candidate metric is not numeric' WHEN slack IS NOT NULL AND NOT base THEN 'baseline metric is missing' WHEN NOT absolute_passed AND regression_passed IS false THEN 'absolute threshold and baseline regression failed' WHEN NOT absolute_passed THEN 'absolute threshold failed' WHEN regression_passed IS false THEN 'baseline regression exceeded' END AS reason FROM u)
SELECT k || kind AS report, name, path, absolute_passed, regression_passed, reason IS NULL AS passed, reason FROM v""")
def report_gates(t: Tables):
    """A report for each customer and priority; the rules are rows with a pointer of their own each."""
    r = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("kind")).agg(F.avg("o_totalprice").alias("c"), F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("b"))
    n = F.when(F.col("n") % 4 == 0, F.concat(F.lit('"'), "n", F.lit('"'))).otherwise(F.col("n").cast("string"))
    whole = F.concat(F.lit('{"prices":[{"mean":'), "c", F.lit('}],"a/b":{"n":'), n, F.lit("}}"))
    base = F.when(F.col("kind") == "5-LOW", '{"prices":[]}').otherwise(F.concat(F.lit('{"prices":[{"mean":'), F.col("b").cast("double"), F.lit("}]}")))
    rules = t.orders.select(F.col("o_orderpriority").alias("kind")).distinct().select("kind", F.lit("price").alias("name"), F.lit("/prices/0/mean").alias("path"), F.lit(False).alias("higher_is_better"), F.lit(None).cast("double").alias("minimum"), F.lit(250000.0).alias("maximum"), F.lit(20000.0).alias("max_regression"))
    more = t.spark.createDataFrame([("1-URGENT", "orders", "/a~1b/n", True, 2.0, None, None), ("2-HIGH", "none", "/missing", True, 1.0, None, None)], "kind string, name string, path string, higher_is_better boolean, minimum double, maximum double, max_regression double")
    return metrics.report_gate(r.select(F.concat("o_custkey", "kind").alias("report"), "kind", whole.alias("candidate"), base.alias("baseline")), rules.unionByName(more), "report")


@query("""WITH s AS (SELECT c_custkey AS k, c_name AS name, 1 + c_custkey % 3 AS version FROM customer WHERE c_custkey % 4 <> 0), c AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 9 ELSE 1 + k % 3 END AS expected, k % 7 = 0 AS del FROM (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0) q),
o AS (SELECT c.k, c.name AS cname, s.name, s.version, CASE WHEN expected IS NULL AND s.k IS NOT NULL THEN 'exists' WHEN expected IS NULL AND del THEN 'missing' WHEN expected IS NULL THEN 'created' WHEN s.k IS NULL THEN 'missing' WHEN s.version <> expected THEN 'conflict' WHEN del THEN 'deleted' ELSE 'updated' END AS outcome FROM c LEFT JOIN s USING (k)),
after AS (SELECT name, version, 'old' AS payload FROM s WHERE k NOT IN (SELECT k FROM o WHERE outcome IN ('updated', 'deleted')) UNION ALL SELECT coalesce(name, lower(cname)), coalesce(version, 0) + 1, 'new' FROM o WHERE outcome IN ('created', 'updated'))
SELECT w.n AS asked, a.name, CAST(a.version AS INTEGER) AS version, a.payload, outcome FROM (SELECT c_custkey AS k, upper(c_name) AS n FROM customer) w LEFT JOIN after a ON lower(a.name) = lower(w.n) LEFT JOIN o ON o.k = w.k""")
def caseless_store(t: Tables):
    """Names in three spellings are one key in the update and in the lookup; repeated changes of a key are told and not taken."""
    c, k = t.customer, F.col("c_custkey")
    stored = c.where(k % 4 != 0).select("c_name", (1 + k % 3).cast("int").alias("version"), F.lit("old").alias("payload"))
    own = c.where(k % 2 == 0).select(F.lower("c_name").alias("c_name"), F.when(k % 5 == 0, None).when(k % 5 == 1, 9).otherwise((1 + k % 3).cast("int")).alias("expected"), k.alias("seq"), (k % 7 == 0).alias("deleted"), F.lit("new").alias("payload"))
    again = c.where(k % 2 == 0).select(F.upper("c_name").alias("c_name"), F.lit(None).cast("int").alias("expected"), (k + 1_000_000_000).alias("seq"), F.lit(False).alias("deleted"), F.lit("never").alias("payload"))
    after, told = stores.put(stored, own.unionByName(again), "c_name")
    asked = stores.found(after, c.select(F.upper("c_name").alias("c_name")), "c_name")
    first = told.where("outcome <> 'repeated'").select(F.upper("c_name").alias("asked"), "outcome")
    return asked.join(first, "asked", "left").select("asked", F.col("c_name").alias("name"), "version", "payload", "outcome")


@query("""WITH o AS (SELECT o_custkey AS d, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_custkey % 3 = 0),
ids AS (SELECT DISTINCT d FROM o), there AS (SELECT DISTINCT d FROM o WHERE k % 6 > 0 OR k % 2 = 0),
t AS (SELECT d, sum(levenshtein(CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k * 7 % 1000 AS VARCHAR) END, CAST(k AS VARCHAR))) AS dist, sum(length(CAST(k AS VARCHAR))) AS n, count(*) AS pages FROM o WHERE k % 4 < 3 AND p <> '5-LOW' GROUP BY d),
c AS (SELECT DISTINCT d, p, s FROM o WHERE k % 2 = 0), g AS (SELECT DISTINCT d, p, s FROM o WHERE k % 3 > 0),
r AS (SELECT g.d, count(*) AS ng, count(c.d) AS hit, any_value((SELECT count(*) FROM c x WHERE x.d = g.d)) AS nc FROM g LEFT JOIN c ON c.d = g.d AND c.p = g.p AND c.s = g.s GROUP BY g.d),
a AS (SELECT ids.d AS doc_id, CASE WHEN ids.d % 5 = 0 THEN 'error' WHEN there.d IS NULL THEN 'missing' ELSE 'evaluated' END AS status, CASE WHEN ids.d % 5 = 0 THEN 'timeout' END AS error, t.dist, t.n, t.pages, r.ng, r.hit, r.nc FROM ids LEFT JOIN there ON there.d = ids.d LEFT JOIN t ON t.d = ids.d LEFT JOIN r ON r.d = ids.d)
SELECT doc_id, status, error, CASE WHEN status = 'evaluated' AND n IS NOT NULL THEN round(greatest(0.0, 1 - dist / n), 6)::DOUBLE END AS word_accuracy, CASE WHEN status = 'evaluated' THEN pages END AS page_count, CASE WHEN status = 'evaluated' AND ng IS NOT NULL THEN CASE WHEN nc = 0 THEN 0.0 ELSE round(hit / nc, 6) END END::DOUBLE AS "precision",
  CASE WHEN status = 'evaluated' THEN round(hit / ng, 6) END::DOUBLE AS recall, CASE WHEN status = 'evaluated' THEN list_filter([CASE WHEN n IS NULL THEN 'text' END, CASE WHEN ng IS NULL THEN 'relations' END], lambda x: x IS NOT NULL) END AS unavailable FROM a""")
def corpus_scores(t: Tables):
    """Customers as documents, orders as pages; some pages are not asked for, some have no gold, some no result, some documents fail."""
    o, k = t.orders.where("o_custkey % 3 = 0"), F.col("o_orderkey")
    spaced = lambda c: F.array_join(F.split(c.cast("string"), ""), " ")
    page = [F.col("o_custkey").alias("doc_id"), k.alias("page")]
    result = {"text": o.where("o_orderkey % 6 > 0").select(*page, spaced(k * 7 % 1000).alias("text")), "relations": o.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderpriority", "o_orderstatus").toDF("doc_id", "source", "target")}
    gold = {"text": o.where("o_orderpriority <> '5-LOW'").select(*page, spaced(k).alias("text")), "relations": o.where("o_orderkey % 3 > 0").select("o_custkey", "o_orderpriority", "o_orderstatus").toDF("doc_id", "source", "target")}
    manifest = t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.collect_list(F.when(k % 4 < 3, k)).alias("pages")).where("doc_id % 3 = 0")
    errors = o.where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("doc_id"), F.lit("timeout").alias("error"))
    s = evaluation.corpus(manifest, result, gold, errors)
    return s.select("doc_id", "status", "error", F.round("text.word_accuracy", 6).alias("word_accuracy"), "text.page_count", F.round("relations.precision", 6).alias("precision"), F.round("relations.recall", 6).alias("recall"), "unavailable")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_returnflag AS f, l_linestatus AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, p AS l_partkey, CASE p % 5 WHEN 0 THEN [f, s] WHEN 1 THEN [f || chr(92) || '|' || s, 'x'] WHEN 2 THEN [f || chr(92) || chr(92), s] WHEN 3 THEN NULL ELSE [''] END AS cited,
  CASE p % 5 WHEN 0 THEN [f, s] WHEN 1 THEN [f || '|' || s, 'x'] WHEN 2 THEN [f || chr(92) || '|' || s] WHEN 3 THEN [f, s || '|'] ELSE [''] END AS schema_cells,
  CASE p % 3 WHEN 0 THEN '0,0,true,A;0,1,true,B;1,0,false,' || f || ';1,1,false,' || s WHEN 1 THEN '0,0,false,' || f || ';0,1,false,' || s || ';1,0,false,C' ELSE '' END AS grid FROM r""")
def table_dialects(t: Tables):
    """Rows with escaped bars, escaped backslashes, open ends; tables with and without a rule below their first row."""
    p, f, s = F.col("l_partkey"), F.col("l_returnflag"), F.col("l_linestatus")
    row = (
        F.when(p % 5 == 0, F.concat(F.lit(" | "), f, F.lit(" |\t"), s, F.lit(" | "))).when(p % 5 == 1, F.concat(F.lit("|"), f, F.lit("\\|"), s, F.lit("| x |"))).when(p % 5 == 2, F.concat(F.lit("|"), f, F.lit("\\\\|"), s, F.lit("|")))
        .when(p % 5 == 3, F.concat(f, F.lit(" | "), s, F.lit("\\|"))).otherwise("|")
    )
    whole = F.when(p % 3 == 0, F.concat(F.lit("| A | B |\r\n|:---| - - - |\n\n"), f, F.lit("|"), s)).when(p % 3 == 1, F.concat(F.lit("||"), f, F.lit("|"), s, F.lit("\ntext\nC|"))).otherwise(F.concat(f, F.lit("|"), s))
    grid = F.array_join(F.transform(text.markdown_cells(whole), lambda c: F.concat_ws(",", c["row"], c["col"], c["header"].cast("string"), c["text"])), ";")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.table_row_cells(row).alias("cited"), text.schema_row_cells(row).alias("schema_cells"), grid.alias("grid"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, p AS l_partkey, rule FROM (SELECT *, unnest(list_filter([CASE WHEN p % 5 < 0 THEN 'start is not negative' END, CASE WHEN p % 5 >= s % 4 THEN 'start is before end' END, CASE WHEN p % 3 = 0 AND s % 2 = 0 THEN 'replace has a text' END, CASE WHEN p % 3 > 0 AND s % 2 = 1 THEN 'only replace has a text' END,
  CASE WHEN p % 7 = 6 THEN 'confidence is a share' END, CASE WHEN p % 4 < 2 AND s % 3 > 0 THEN 'heading_level is of a heading' END, CASE WHEN p % 4 = 2 AND s % 3 > 0 THEN 'list_depth is of a list item' END, CASE WHEN p % 4 = 0 THEN 'heading_level is 1 to 6' END], lambda x: x IS NOT NULL)) AS rule FROM r) q""")
def record_rules(t: Tables):
    """Spans, replacements and directives of one row each; null where a part says nothing."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", (p % 5).alias("start"), (s % 4).alias("end"), F.when(p % 3 == 0, "replace").when(p % 3 == 1, "confirm").alias("action"), F.when(s % 2 == 1, "new").alias("replacement_text"), F.when(p % 7 > 0, p % 7 / 5.0).alias("confidence"),
        F.when(s % 3 > 0, F.when(s % 3 == 1, "text")).when(p % 4 < 2, "heading").otherwise("list_item").alias("render_as"), F.when(p % 4 < 2, p % 4 * 6).alias("heading_level"), F.when(p % 4 == 2, 6).alias("list_depth"),
    )
    return validate.violations(rows, ["l_orderkey", "l_linenumber", "l_partkey"], {**validate.record_rules("span"), **validate.record_rules("replacement"), **validate.record_rules("directive")})
