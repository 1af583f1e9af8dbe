"""Telemetry, cost, classification and gate queries. ``events`` plays the event log: event_type names the model or stage, value is a latency, props a JSON counter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from .registry import Tables, query

# fixed values: a price list per million tokens (input, output, cached input) by event type, one type left out on purpose
PRICES = [("click", 0.2, 1.2, 0.02), ("view", 0.3, 2.5, None), ("purchase", 0.75, 3.75, None)]
PRICES_SQL = "(VALUES ('click',0.2,1.2,0.02),('view',0.3,2.5,NULL),('purchase',0.75,3.75,NULL)) AS p(model,input_rate,output_rate,cached_rate)"
CALLS_SQL = """calls AS (SELECT event_type AS model, CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) * (event_id % 3) AS cached_input_tokens,
  CAST(event_id % 97 AS BIGINT) AS output_tokens, event_id % 11 <> 0 AS telemetry_available, user_id, value FROM events)"""


def _prices(t: Tables):
    return t.spark.createDataFrame(PRICES, "model string, input_rate double, output_rate double, cached_rate double")


def _calls(t: Tables):
    tokens = F.floor(F.col("value") * 10).cast("bigint")
    return t.events.select(F.col("event_type").alias("model"), tokens.alias("input_tokens"), (tokens * (F.col("event_id") % 3)).alias("cached_input_tokens"), (F.col("event_id") % 97).alias("output_tokens"), (F.col("event_id") % 11 != 0).alias("telemetry_available"), "user_id", "value")


COST_SQL = f"""{CALLS_SQL}, per AS (SELECT model, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(least(sum(cached_input_tokens), sum(input_tokens)) AS BIGINT) AS c FROM calls WHERE telemetry_available GROUP BY model),
cost AS (SELECT model, i AS input_tokens, c AS cached_input_tokens, o AS output_tokens, ((i - c) * coalesce(input_rate, 0) + c * coalesce(cached_rate, input_rate, 0) + o * coalesce(output_rate, 0)) / 1000000.0 AS estimated_cost FROM per LEFT JOIN {PRICES_SQL} USING (model))"""


@query(f"WITH {COST_SQL} SELECT * FROM cost")
def usage_cost_by_type(t: Tables):
    return metrics.usage_cost(_calls(t), _prices(t))


@query(f"""WITH {COST_SQL}, named AS (SELECT *, coalesce(l.label, cost.model) AS name FROM cost LEFT JOIN (VALUES ('click','Click model'),('view','View model')) AS l(model,label) USING (model))
SELECT CASE WHEN grouping(name) = 1 THEN 'Total' ELSE name END AS label, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, sum(estimated_cost) AS estimated_cost FROM named GROUP BY ROLLUP(name)""")
def session_cost_table(t: Tables):
    labels = t.spark.createDataFrame([("click", "Click model"), ("view", "View model")], "model string, label string")
    return metrics.usage_with_total(metrics.usage_cost(_calls(t), _prices(t)), labels)


@query("""SELECT event_type, count(*) AS n_records, median(value) AS p50, quantile_disc(value, 0.95) AS p95, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 97) AS BIGINT) AS output_tokens,
  CASE WHEN sum(event_id % 5) = 0 THEN 0.0 ELSE sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) / sum(event_id % 5) END AS repaired_target_rate FROM events GROUP BY event_type""")
def telemetry_summary(t: Tables):
    e = t.events.select("event_type", F.col("value").alias("latency_seconds"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 97).alias("output_tokens"), (F.col("event_id") % 7 == 0).cast("int").alias("repaired_targets"), (F.col("event_id") % 5).alias("blocks"))
    return metrics.telemetry(e, ["event_type"])


@query(f"""WITH {CALLS_SQL}, u AS (SELECT model, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM calls GROUP BY model), j AS (SELECT * FROM u LEFT JOIN {PRICES_SQL} USING (model))
SELECT CASE WHEN count(*) FILTER (WHERE input_rate IS NULL) = 0 THEN sum((i * input_rate + o * output_rate) / 1000000.0) / (SELECT count(DISTINCT user_id) FROM events) END AS cost_per_page,
  CASE WHEN count(*) FILTER (WHERE input_rate IS NULL) > 0 THEN 'no rates for: ' || string_agg(model, ', ' ORDER BY model) FILTER (WHERE input_rate IS NULL) END AS reason, (SELECT count(DISTINCT user_id) FROM events) AS total_pages FROM j""")
def cost_gate(t: Tables):
    c = _calls(t)
    usage = c.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    rates = _prices(t).select("model", F.col("input_rate").alias("input_per_million"), F.col("output_rate").alias("output_per_million"))
    return metrics.cost_per_page(usage, rates, c.agg(F.count_distinct("user_id").alias("pages")))


SCORED_SQL = """scored AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS expected, CASE WHEN (doc_id * 7 + quality) % 4 = 0 THEN CASE toxic WHEN 1 THEN 'good' ELSE 'bad' END ELSE CASE quality WHEN 1 THEN 'good' ELSE 'bad' END END AS predicted,
  CAST((doc_id * 37 % 101) AS DOUBLE) / 100 AS confidence FROM labels)"""


def _scored(t: Tables):
    name = lambda c: F.when(F.col(c) == 1, "good").otherwise("bad")
    return t.labels.select("doc_id", name("quality").alias("expected"), F.when((F.col("doc_id") * 7 + F.col("quality")) % 4 == 0, name("toxic")).otherwise(name("quality")).alias("predicted"), ((F.col("doc_id") * 37 % 101).cast("double") / 100).alias("confidence"))


PER_CLASS_SQL = f"""WITH {SCORED_SQL}, e AS (SELECT expected, count(*) AS support, count(*) FILTER (WHERE expected = predicted) AS tp, avg(confidence) AS mean_confidence, avg(CASE WHEN confidence < 0.85 THEN 1.0 ELSE 0.0 END) AS review_rate FROM scored GROUP BY 1),
p AS (SELECT predicted AS expected, count(*) AS np FROM scored GROUP BY 1), m AS (SELECT expected, support, CASE WHEN coalesce(np, 0) = 0 THEN 0.0 ELSE tp / np END AS "precision", tp / support AS recall, mean_confidence, review_rate FROM e LEFT JOIN p USING (expected)),
per AS (SELECT expected, support, "precision", recall, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1, mean_confidence, review_rate FROM m)"""


@query(f"{PER_CLASS_SQL} SELECT * FROM per")
def classification_prf(t: Tables):
    return metrics.per_class(_scored(t))


@query(f"WITH {SCORED_SQL} SELECT expected, predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion_matrix(t: Tables):
    return metrics.confusion(_scored(t))


@query(f"""{PER_CLASS_SQL} SELECT count(*) AS scored_documents, avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END) AS accuracy, CAST(count(*) FILTER (WHERE confidence < 0.85) AS BIGINT) AS review_count, avg(CASE WHEN confidence < 0.85 THEN 1.0 ELSE 0.0 END) AS review_rate,
  CAST(count(*) FILTER (WHERE confidence >= 0.85) AS BIGINT) AS auto_approved_count, avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END) FILTER (WHERE confidence >= 0.85) AS auto_approved_accuracy,
  (SELECT avg("precision") FROM per) AS macro_precision, (SELECT avg(recall) FROM per) AS macro_recall, (SELECT avg(f1) FROM per) AS macro_f1 FROM scored""")
def auto_approved_accuracy(t: Tables):
    return metrics.classification_summary(_scored(t))


BINS_SQL = f"""WITH {SCORED_SQL}, b AS (SELECT *, (SELECT max(k) FROM range(10) r(k) WHERE k / 10.0::DOUBLE <= confidence) AS bin, CASE WHEN expected = predicted THEN 1.0::DOUBLE ELSE 0.0 END AS ok FROM scored),
bins AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(ok) AS accuracy, abs(avg(confidence) - avg(ok)) AS gap FROM b GROUP BY bin)"""


@query(f"{BINS_SQL} SELECT * FROM bins")
def calibration_bins(t: Tables):
    return metrics.calibration_bins(_scored(t))


@query(f"{BINS_SQL} SELECT (SELECT avg((confidence - ok) * (confidence - ok)) FROM b) AS brier, sum(gap * n) / sum(n) AS ece FROM bins")
def brier_ece(t: Tables):
    return metrics.brier_ece(_scored(t))


@query("""WITH o AS (SELECT c.lang AS kind, length(c.text) % 50 + 1 AS block_count, doc_id % 7 AS needs_review_count, doc_id % 3 AS rejected_count FROM documents c)
SELECT kind, CAST(sum(block_count) AS BIGINT) AS block_count, CAST(sum(needs_review_count) AS BIGINT) AS needs_review_count, CAST(sum(rejected_count) AS BIGINT) AS rejected_count, sum(needs_review_count) / sum(block_count) AS review_rate, sum(rejected_count) / sum(block_count) AS rejection_rate FROM o GROUP BY kind""")
def review_rates(t: Tables):
    o = t.documents.select(F.col("lang").alias("kind"), (F.length("text") % 50 + 1).alias("block_count"), (F.col("doc_id") % 7).alias("needs_review_count"), (F.col("doc_id") % 3).alias("rejected_count"))
    return metrics.review_rates(o, ["kind"])


@query("""WITH m AS (SELECT doc_id, 'quality' AS metric, 'value' AS key, CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END AS value, CASE WHEN toxic = 1 THEN 'toxic' END AS reason FROM labels
  UNION ALL SELECT doc_id, 'toxicity', 'value', CAST(toxic AS DOUBLE), NULL FROM labels UNION ALL SELECT doc_id, 'layout', 'value', NULL, CASE WHEN doc_id % 2 = 0 THEN 'no boxes' ELSE 'no pages' END FROM labels)
SELECT metric, key, avg(value) AS mean_value, count(value) AS n_available, CASE WHEN count(value) = 0 THEN string_agg(DISTINCT reason, '; ' ORDER BY reason) END AS reasons FROM m GROUP BY 1, 2""")
def macro_metrics_unpivot(t: Tables):
    doc, null = F.col("doc_id"), F.lit(None)
    rows = t.labels.select("doc_id", F.explode(F.array(
        F.struct(F.lit("quality").alias("metric"), F.lit("value").alias("key"), F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("value"), F.when(F.col("toxic") == 1, "toxic").alias("reason")),
        F.struct(F.lit("toxicity").alias("metric"), F.lit("value").alias("key"), F.col("toxic").cast("double").alias("value"), null.cast("string").alias("reason")),
        F.struct(F.lit("layout").alias("metric"), F.lit("value").alias("key"), null.cast("double").alias("value"), F.when(doc % 2 == 0, "no boxes").otherwise("no pages").alias("reason")),
    )).alias("m")).select("doc_id", "m.*")
    return metrics.macro_mean(rows)


@query("""WITH d AS (SELECT l.doc_id, d.lang AS document_type, d.source, CAST(l.quality AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))
SELECT 'overall' AS grouping_kind, NULL AS group_key, count(*) AS n_docs, avg(score) AS mean_score FROM d UNION ALL SELECT 'document_type', document_type, count(*), avg(score) FROM d GROUP BY document_type
UNION ALL SELECT 'feature', f, count(*), avg(score) FROM (SELECT unnest(list_distinct([source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE source END])) AS f, score FROM d) GROUP BY f""")
def report_grouping_sets(t: Tables):
    d = t.labels.join(t.documents, "doc_id").select("doc_id", F.col("lang").alias("document_type"), F.col("quality").cast("double").alias("score"), F.array("source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise(F.col("source"))).alias("features"))
    return metrics.grouped_report(d)


@query("""WITH m AS (SELECT '/types/' || event_type AS path, avg(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY event_type), b AS (SELECT '/types/' || event_type AS path, avg(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY event_type),
r AS (SELECT * FROM (VALUES ('a','/types/click',true,10.0,NULL,0.5),('b','/types/view',false,NULL,40.0,0.1),('c','/types/none',true,1.0,NULL,NULL),('d','/types/purchase',false,NULL,1000.0,1000.0),('e','/types/purchase',true,1000.0,NULL,NULL)) AS r(name,path,up,minimum,maximum,max_regression)),
j AS (SELECT r.*, m.value AS c, b.value AS b FROM r LEFT JOIN m USING (path) LEFT JOIN b USING (path)),
k AS (SELECT name, path, CASE WHEN c IS NULL THEN true ELSE (minimum IS NULL OR c >= minimum) AND (maximum IS NULL OR c <= maximum) END AS absolute_passed,
  CASE WHEN c IS NULL OR max_regression IS NULL THEN NULL WHEN b IS NULL THEN false WHEN up THEN c >= b - max_regression ELSE c <= b + max_regression END AS regression_passed, c, b, max_regression FROM j),
f AS (SELECT name, path, absolute_passed, regression_passed, CASE WHEN c IS NULL THEN 'candidate metric is missing' WHEN max_regression IS NOT NULL AND b IS NULL THEN 'baseline metric is missing' WHEN NOT absolute_passed AND regression_passed IS false THEN 'absolute threshold and baseline regression failed'
  WHEN NOT absolute_passed THEN 'absolute threshold failed' WHEN regression_passed IS false THEN 'baseline regression exceeded' END AS reason FROM k)
SELECT name, path, absolute_passed, regression_passed, reason IS NULL AS passed, reason FROM f""")
def regression_gate(t: Tables):
    side = lambda odd: t.events.where(F.col("event_id") % 2 == odd).groupBy(F.concat(F.lit("/types/"), "event_type").alias("path")).agg(F.avg("value").alias("value")).withColumn("is_number", F.lit(True))
    rules = t.spark.createDataFrame(
        [("a", "/types/click", True, 10.0, None, 0.5), ("b", "/types/view", False, None, 40.0, 0.1), ("c", "/types/none", True, 1.0, None, None), ("d", "/types/purchase", False, None, 1000.0, 1000.0), ("e", "/types/purchase", True, 1000.0, None, None)],
        "name string, path string, higher_is_better boolean, minimum double, maximum double, max_regression double",
    )
    return metrics.regression_gate(side(0), side(1), rules)


@query("""WITH c AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS a, o_orderstatus AS b FROM orders WHERE o_orderkey % 2 = 0), h AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS a, o_orderstatus AS b FROM orders WHERE o_orderkey % 3 <> 0),
j AS (SELECT coalesce(c.g, h.g) AS o_custkey, count(c.g) AS nc, count(h.g) AS ng, count(*) FILTER (WHERE c.g IS NOT NULL AND h.g IS NOT NULL) AS matches FROM c FULL JOIN h ON c.g = h.g AND c.a = h.a AND c.b = h.b GROUP BY 1),
k AS (SELECT *, CASE WHEN nc = 0 THEN 0.0 ELSE matches / nc END AS "precision", CASE WHEN ng = 0 THEN 0.0 ELSE matches / ng END AS recall FROM j)
SELECT o_custkey, CAST(matches AS BIGINT) AS matches, "precision", recall, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM k""")
def pair_prf(t: Tables):
    return metrics.pair_scores(t.orders.where("o_orderkey % 2 = 0"), t.orders.where("o_orderkey % 3 <> 0"), ["o_orderpriority", "o_orderstatus"], ["o_custkey"])


@query("""WITH g AS (SELECT user_id AS doc_id, event_id AS anchor, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
c AS (SELECT user_id AS doc_id, event_id AS anchor, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS cpos FROM events WHERE event_type <> 'click'),
j AS (SELECT g.*, cpos FROM g LEFT JOIN c USING (doc_id, anchor)), n AS (SELECT doc_id, count(*) AS n_gold, count(cpos) AS n_found FROM j GROUP BY doc_id),
p AS (SELECT a.doc_id, sum(CASE WHEN a.cpos < b.cpos THEN 1 ELSE 0 END) AS ok, count(*) AS pairs FROM j a JOIN j b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.cpos IS NOT NULL AND b.cpos IS NOT NULL GROUP BY a.doc_id)
SELECT n.doc_id, CASE WHEN p.pairs IS NULL THEN 1.0 ELSE ok / pairs END AS pairwise_order_accuracy, n_found / n_gold AS anchor_coverage FROM n LEFT JOIN p USING (doc_id)""")
def reading_order_concordance(t: Tables):
    from pyspark.sql import Window

    pos = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(c, "event_id")).alias("pos")
    key = [F.col("user_id").alias("doc_id"), F.col("event_id").alias("anchor")]
    return metrics.reading_order(t.events.where("event_type <> 'click'").select(*key, pos("value")), t.events.select(*key, pos("ts")))


CELLS = "o_custkey % 50 AS page, o_orderkey % 4 AS ordinal, o_orderkey AS row, o_custkey % 7 AS col"


@query(f"""WITH g AS (SELECT {CELLS}, o_orderstatus AS text, 1 AS row_span, 1 AS col_span FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT {CELLS}, CASE WHEN o_totalprice < 250000 THEN o_orderstatus ELSE o_orderpriority END AS text, 1 AS row_span, 1 AS col_span FROM orders WHERE o_custkey % 50 < 40),
j AS (SELECT g.page, c.text IS NOT NULL AND c.text = g.text AS same FROM g LEFT JOIN c USING (page, ordinal, row, col)),
tt AS (SELECT x.page, x.ordinal, y.page AS there FROM (SELECT DISTINCT page, ordinal FROM g) x LEFT JOIN (SELECT DISTINCT page, ordinal FROM c) y USING (page, ordinal))
SELECT (SELECT count(*) FROM j) AS n_cells, (SELECT avg(CAST(same AS DOUBLE)) FROM j) AS cell_exact_accuracy, (SELECT count(there) FROM tt) AS matched_tables, (SELECT count(there) / count(*) FROM tt) AS table_coverage""")
def gold_cell_match(t: Tables):
    cells = t.orders.selectExpr(*CELLS.split(", "), "1 row_span", "1 col_span", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey", "o_custkey")
    c = cells.where("o_custkey % 50 < 40").select("page", "ordinal", "row", "col", F.expr("CASE WHEN o_totalprice < 250000 THEN o_orderstatus ELSE o_orderpriority END").alias("text"), "row_span", "col_span", F.lit(0).alias("seq"))
    return metrics.table_cells(c, cells.where("o_orderkey % 5 <> 0").withColumnRenamed("o_orderstatus", "text"))
