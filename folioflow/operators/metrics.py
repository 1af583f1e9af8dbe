"""Telemetry, cost, review, classification, calibration and gate aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pointers


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; ``empty`` where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r, 0.0)


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost of each model. calls: model, input_tokens, cached_input_tokens, output_tokens, telemetry_available;
    prices: model, input_rate, output_rate, cached_rate (per million; a missing model is free, a missing cached rate is the input rate)."""
    per = calls.where("telemetry_available").groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_input_tokens").alias("cached"), F.sum("output_tokens").alias("output_tokens"))
    per = per.withColumn("cached_input_tokens", F.least("cached", "input_tokens")).drop("cached").join(prices, "model", "left")
    rate = lambda c, other=F.lit(0.0): F.coalesce(F.col(c), other)
    cost = (F.col("input_tokens") - F.col("cached_input_tokens")) * rate("input_rate") + F.col("cached_input_tokens") * rate("cached_rate", rate("input_rate")) + F.col("output_tokens") * rate("output_rate")
    return per.select("model", "input_tokens", "cached_input_tokens", "output_tokens", (cost / 1_000_000).alias("estimated_cost"))


def usage_with_total(cost: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a model and a Total row; a model without label shows its id."""
    named = cost.join(labels, "model", "left").withColumn("label", F.coalesce("label", "model"))
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "estimated_cost")]
    return named.rollup("label").agg(F.grouping("label").alias("g"), *sums).select(F.when(F.col("g") == 1, "Total").otherwise(F.col("label")).alias("label"), "input_tokens", "cached_input_tokens", "output_tokens", "estimated_cost")


def telemetry(records: DataFrame, by: list[str]) -> DataFrame:
    """A1, A3: counts, token sums, median and nearest-rank 95th percentile of latency_seconds, repaired share."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"), F.median("latency_seconds").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_seconds)").alias("p95"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), ratio(F.sum("repaired_targets"), F.sum("blocks"), 0.0).alias("repaired_target_rate"),
    )


def cost_per_page(usage: DataFrame, rates: DataFrame, pages: DataFrame) -> DataFrame:
    """One row; any model without a rate makes the cost null and is named in the reason. rates: small by nature, joined as Catalyst decides."""
    joined = usage.join(rates, "model", "left")
    missing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("input_per_million").isNull(), F.col("model")))), ", ")
    one = joined.agg(F.sum((F.col("input_tokens") * F.col("input_per_million") + F.col("output_tokens") * F.col("output_per_million")) / 1_000_000).alias("cost"), missing.alias("missing"))
    total = pages.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"))
    both = one.join(total)  # one row each
    ok = (F.col("missing") == "") & (F.col("total_pages") != 0)
    reason = F.when(F.col("missing") != "", F.concat(F.lit("no rates for: "), F.col("missing"))).when(F.col("total_pages") == 0, "page count is zero")
    return both.select(F.when(ok, F.col("cost") / F.col("total_pages")).alias("cost_per_page"), reason.alias("reason"), "total_pages")


def macro_mean(values: DataFrame) -> DataFrame:
    """A5: mean of each (metric, key) over documents with a value; a metric without any gives its reasons. values: doc_id, metric, key, value, reason."""
    means = values.groupBy("metric", "key").agg(F.avg("value").alias("mean_value"), F.count("value").alias("n_available"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))
    return means.withColumn("reasons", F.when(F.col("n_available") == 0, F.when(F.col("reasons") == "", "metric is not annotated").otherwise(F.col("reasons"))))


def grouped_report(documents: DataFrame) -> DataFrame:
    """Overall and by document type as grouping sets, by feature as a branch of exploded features. documents: document_type, features, score."""
    sets = documents.groupingSets([["document_type"], []], "document_type").agg(F.grouping("document_type").alias("g"), F.count(F.lit(1)).alias("n_docs"), F.avg("score").alias("mean_score"))
    sets = sets.select(F.when(F.col("g") == 1, "overall").otherwise("document_type").alias("grouping_kind"), F.when(F.col("g") == 0, F.col("document_type")).alias("group_key"), "n_docs", "mean_score")
    by_feature = documents.select(F.explode(F.array_distinct("features")).alias("feature"), "score").groupBy("feature").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("score").alias("mean_score"))
    return sets.unionByName(by_feature.select(F.lit("feature").alias("grouping_kind"), F.col("feature").alias("group_key"), "n_docs", "mean_score"))


def review_rates(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Micro rates of review and rejection."""
    s = {c: F.sum(c) for c in ("block_count", "needs_review_count", "rejected_count")}
    return outcomes.groupBy(*by).agg(*[v.alias(k) for k, v in s.items()], ratio(s["needs_review_count"], s["block_count"], 0.0).alias("review_rate"), ratio(s["rejected_count"], s["block_count"], 0.0).alias("rejection_rate"))


def confusion(scored: DataFrame) -> DataFrame:
    """Expected, predicted, n."""
    return scored.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def per_class(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Support, precision, recall, F1, mean confidence and review rate of each expected class; one pass over the pair counts."""
    pairs = scored.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.sum(F.when(F.col("confidence") < threshold, 1).otherwise(0)).alias("low"))
    predicted = pairs.groupBy(F.col("predicted").alias("expected")).agg(F.sum("n").alias("n_predicted"))
    own = pairs.groupBy("expected").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"), F.sum("c").alias("c"), F.sum("low").alias("low"))
    both = own.join(predicted, "expected", "left")
    p, r = ratio(F.col("tp"), F.col("n_predicted"), 0.0), ratio(F.col("tp"), F.col("support"), 0.0)
    return both.select("expected", "support", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), (F.col("c") / F.col("support")).alias("mean_confidence"), (F.col("low") / F.col("support")).alias("review_rate"))


def classification_summary(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row of accuracy, macro means over expected classes, review and auto-approval."""
    right = F.when(F.col("expected") == F.col("predicted"), 1.0).otherwise(0.0)
    auto = F.col("confidence") >= threshold
    overall = scored.agg(F.count(F.lit(1)).alias("scored_documents"), F.avg(right).alias("accuracy"), F.sum(F.when(~auto, 1).otherwise(0)).alias("review_count"), F.avg(F.when(auto, 0.0).otherwise(1.0)).alias("review_rate"), F.sum(F.when(auto, 1).otherwise(0)).alias("auto_approved_count"), F.avg(F.when(auto, right)).alias("auto_approved_accuracy"))
    macro = per_class(scored, threshold).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return overall.join(macro)  # one row each


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """A10: equal bins [k/10, (k+1)/10), the last closed above. The bin is found by comparing with the same bounds, not by flooring a product, which differs at float edges."""
    index = sum((F.when(F.col("confidence") >= F.lit(k / bins), 1).otherwise(0) for k in range(1, bins)), F.lit(0))
    right = F.when(F.col("expected") == F.col("predicted"), 1.0).otherwise(0.0)
    return scored.where("confidence >= 0").groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(right).alias("accuracy"), F.abs(F.avg("confidence") - F.avg(right)).alias("gap"))


def brier_ece(scored: DataFrame) -> DataFrame:
    """A10: top-label Brier score and expected calibration error."""
    right = F.when(F.col("expected") == F.col("predicted"), 1.0).otherwise(0.0)
    brier = scored.agg(F.avg((F.col("confidence") - right) ** 2).alias("brier"))
    ece = calibration_bins(scored).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))
    return brier.join(ece)  # one row each


def report_gate(reports: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Rules as rows over JSON reports: each report meets the rules of its kind, and each rule the number at its own pointer.

    reports: key, kind, candidate, baseline (JSON texts); rules: kind, name, path (a pointer), higher_is_better, minimum, maximum,
    max_regression. The leaves of all reports are joined by pointer, so rules may name any place of any report."""
    asked = reports.select(key, "kind").join(rules, "kind")
    number = F.when(F.col("kind") == "number", F.col("value").cast("double"))
    side = lambda c: pointers.leaves(reports, key, c).select(key, F.col("pointer").alias("path"), number.alias("value"), (F.col("kind") == "number").alias("is_number"))
    return regression_gate(side("candidate"), side("baseline"), asked, [key])


def regression_gate(metrics: DataFrame, baseline: DataFrame, rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rules over metrics keyed by pointer (and by); a missing or non-numeric metric fails. metrics, baseline: path, value, is_number;
    rules: name, path, higher_is_better, minimum, maximum, max_regression."""
    by = by or []
    c = metrics.select(*by, "path", F.col("value").alias("candidate"), F.col("is_number").alias("c_number"), F.lit(True).alias("c_there"))
    b = baseline.select(*by, "path", F.col("value").alias("baseline"), F.col("is_number").alias("b_number"), F.lit(True).alias("b_there"))
    if by:  # metrics of many reports look small to the planner, as their texts are; they are never sent whole to the driver
        c, b = c.hint("merge"), b.hint("merge")
    j = rules.join(c, [*by, "path"], "left").join(b, [*by, "path"], "left")
    there = lambda x: F.coalesce(F.col(x), F.lit(False))
    usable = there("c_there") & there("c_number")
    absolute = F.when(usable, (F.col("minimum").isNull() | (F.col("candidate") >= F.col("minimum"))) & (F.col("maximum").isNull() | (F.col("candidate") <= F.col("maximum")))).otherwise(True)
    within = F.when(F.col("higher_is_better"), F.col("candidate") >= F.col("baseline") - F.col("max_regression")).otherwise(F.col("candidate") <= F.col("baseline") + F.col("max_regression"))
    held = F.when(usable & F.col("max_regression").isNotNull(), F.when(there("b_there") & there("b_number"), within).otherwise(False))
    j = j.withColumn("absolute_passed", absolute).withColumn("regression_passed", held)
    bad = F.col("regression_passed").eqNullSafe(False)
    reason = (
        F.when(~there("c_there"), "candidate metric is missing").when(~there("c_number"), "candidate metric is not numeric")
        .when(F.col("max_regression").isNotNull() & ~there("b_there"), "baseline metric is missing").when(F.col("max_regression").isNotNull() & ~there("b_number"), "baseline metric is not numeric")
        .when(~F.col("absolute_passed") & bad, "absolute threshold and baseline regression failed").when(~F.col("absolute_passed"), "absolute threshold failed").when(bad, "baseline regression exceeded")
    )
    return j.withColumn("reason", reason).select(*by, "name", "path", "absolute_passed", "regression_passed", F.col("reason").isNull().alias("passed"), "reason")


def pair_scores(candidate: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision, recall and F1 of distinct pairs in each group."""
    c, g = candidate.select(*by, *keys).distinct(), gold.select(*by, *keys).distinct()
    both = c.withColumn("c", F.lit(1)).join(g.withColumn("g", F.lit(1)), [*by, *keys], "full").groupBy(*by).agg(F.count("c").alias("nc"), F.count("g").alias("ng"), F.sum(F.when(F.col("c").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("matches"))
    p, r = ratio(F.col("matches"), F.col("nc"), 0.0), ratio(F.col("matches"), F.col("ng"), 0.0)
    return both.select(*by, "matches", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def ordered_pairs(values: np.ndarray) -> int:
    """Pairs of places i < j with values[i] < values[j]: blocks of doubling width are merged, a level at a time."""
    n = len(values)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    at, total, width = np.arange(n), 0, 1
    while width < n:
        block = at // (2 * width)
        key, left = block * n + ranks, at // width % 2 == 0
        held = np.sort(key[left])
        start = np.searchsorted(held, block[~left] * n)
        total += int((np.searchsorted(held, key[~left]) - start).sum())
        width *= 2
    return total


@F.pandas_udf(T.LongType())
def _ordered_pairs(lines: pd.Series) -> pd.Series:
    return pd.Series([ordered_pairs(np.asarray(x)) for x in lines], dtype="int64")


def reading_order(candidate: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairwise concordance over ordered gold pairs and anchor coverage. candidate, gold: doc_id, anchor, pos; of repeated candidates the first counts.

    Pairs in order are counted by merging within a document, so no pair is made.
    """
    c = candidate.groupBy("doc_id", "anchor").agg(F.min("pos").alias("cpos"))
    j = gold.join(c, ["doc_id", "anchor"], "left")
    per = j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("cpos").alias("n_found"), F.transform(F.array_sort(F.collect_list(F.when(F.col("cpos").isNotNull(), F.struct("pos", "cpos")))), lambda x: x["cpos"]).alias("line"))
    later = _ordered_pairs("line")
    n_pairs = F.col("n_found") * (F.col("n_found") - 1) / 2
    return per.select("doc_id", ratio(later.cast("double"), n_pairs, 1.0).alias("pairwise_order_accuracy"), ratio(F.col("n_found").cast("double"), F.col("n_gold"), 1.0).alias("anchor_coverage"))


def table_cells(candidate: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold cells matched by (page, ordinal, row, col) with equal text and spans; of duplicate candidates the last (by seq) counts."""
    key = ["page", "ordinal", "row", "col"]
    last = candidate.groupBy(*key).agg(F.max_by(F.struct("text", "row_span", "col_span"), "seq").alias("cell"))
    cells = gold.join(last, key, "left").select(*key, (F.col("cell").eqNullSafe(F.struct("text", "row_span", "col_span"))).alias("same"))
    tables = gold.select("page", "ordinal").distinct().join(candidate.select("page", "ordinal", F.lit(1).alias("there")).distinct(), ["page", "ordinal"], "left")
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.avg(F.col("same").cast("double")).alias("cell_exact_accuracy")).join(tables.agg(F.count("there").alias("matched_tables"), (F.count("there") / F.count(F.lit(1))).alias("table_coverage")))


def leaf_scores(candidate: DataFrame, gold: DataFrame) -> DataFrame:
    """Matches of JSON leaves on (doc_id, pointer) with equal (kind, value), as precision, recall and F1 of each document."""
    c = candidate.select("doc_id", "pointer", F.struct("kind", "value").alias("c"))
    g = gold.select("doc_id", "pointer", F.struct("kind", "value").alias("g"))
    per = c.join(g, ["doc_id", "pointer"], "full").groupBy("doc_id").agg(F.count("c").alias("nc"), F.count("g").alias("ng"), F.sum(F.when(F.col("c").isNotNull() & F.col("c").eqNullSafe(F.col("g")), 1).otherwise(0)).alias("exact_matches"))
    p, r = ratio(F.col("exact_matches"), F.col("nc"), 0.0), ratio(F.col("exact_matches"), F.col("ng"), 0.0)
    return per.select("doc_id", "exact_matches", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))
