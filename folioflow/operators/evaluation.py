"""Evaluation of a corpus: pages that the manifest asks for, metrics of each document, errors that stay with their document.

A result and its gold are frames of one shape each; a document has a metric if its gold has rows for it, and what its result lacks of them
counts as not found. Frames by name:

text: doc_id, page, text; order: doc_id, anchor, pos; relations: doc_id, source, target; boxes: doc_id, id, box; data: doc_id, document (JSON);
label: doc_id, label; claims: doc_id, forbidden (gold), rejected (gold) and accepted (result), arrays of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pointers
from . import blocks, joins, metrics, regions

KEY = "doc_id"


def _text(result: DataFrame, gold: DataFrame) -> DataFrame:
    pages = gold.select(KEY, "page", F.col("text").alias("reference")).join(result.select(KEY, "page", F.col("text").alias("candidate")), [KEY, "page"], "left")
    return blocks.page_accuracy(pages.withColumn("candidate", F.coalesce("candidate", F.lit(""))), [KEY])


def _relations(result: DataFrame, gold: DataFrame) -> DataFrame:
    own = gold.select(KEY).distinct()
    return metrics.pair_scores(result.join(own, KEY, "left_semi"), gold, ["source", "target"], [KEY])


def _data(result: DataFrame, gold: DataFrame) -> DataFrame:
    scored = metrics.leaf_scores(pointers.leaves(result, KEY, "document"), pointers.leaves(gold, KEY, "document"))
    return gold.select(KEY).distinct().join(scored, KEY)


def _label(result: DataFrame, gold: DataFrame) -> DataFrame:
    return gold.select(KEY, F.col("label").alias("expected")).join(result.select(KEY, F.col("label").alias("predicted")), KEY, "left").withColumn("correct", F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)))


METRICS = {
    "text": _text, "order": metrics.reading_order, "relations": _relations, "boxes": lambda result, gold: joins.iou_recall(result, gold, [KEY]), "data": _data, "label": _label,
}


def scorecards(documents: DataFrame, result: dict[str, DataFrame], gold: dict[str, DataFrame]) -> DataFrame:
    """Documents with a struct for each metric whose gold is given, and unavailable, the names of those that a document has no gold for.
    A metric without any result frame is that of empty results."""
    frames = {name: METRICS[name](result.get(name, gold[name].limit(0)), gold[name]) for name in METRICS if name in gold}
    return regions.scorecard(documents, frames, KEY)


def corpus(manifest: DataFrame, result: dict[str, DataFrame], gold: dict[str, DataFrame], errors: DataFrame, chosen: list | None = None) -> DataFrame:
    """One row a chosen document of the manifest: status (evaluated, error, missing), error, a struct for each metric, unavailable.

    manifest: doc_id, pages (the pages to look at; null: all); errors: doc_id, error. Text outside a document's pages is left out of both
    sides. A document with an error, or whose result has no rows in any frame, has no metrics and does not touch the others.
    """
    asked = manifest if chosen is None else manifest.where(F.col(KEY).isin(chosen))
    subset = lambda frame: frame.join(asked.select(KEY, "pages"), KEY).where(F.col("pages").isNull() | F.array_contains("pages", F.col("page"))).drop("pages")
    cut = lambda frames: {n: subset(f) if n == "text" else f.join(asked.select(KEY), KEY, "left_semi") for n, f in frames.items()}
    there = None
    for frame in result.values():
        ids = frame.select(KEY)
        there = ids if there is None else there.union(ids)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("_there").isNull(), "missing").otherwise("evaluated")
    told = asked.join(errors.groupBy(KEY).agg(F.min("error").alias("error")), KEY, "left").join(there.distinct().withColumn("_there", F.lit(True)), KEY, "left").withColumn("status", status).drop("_there", "pages")
    scored = scorecards(told.where("status = 'evaluated'").select(KEY), cut(result), cut(gold))
    return told.join(scored, KEY, "left")
