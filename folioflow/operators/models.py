"""Model boundary and recognition output.

Models are functions the caller injects; everything around them is here. A call that raises gives an error row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins


def call(rows: DataFrame, load: Callable[[], Callable[[dict], dict]], fields: str) -> DataFrame:
    """Rows with the model's fields and ``error``. ``load`` builds the model once a task; the model takes and gives a dict."""
    names = [f.strip().split()[0] for f in fields.split(",")]
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    got = model(row)
                    out.append({**row, **{n: got.get(n) for n in names}, "error": None})
                except Exception as e:
                    out.append({**row, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*columns, *names, "error"])

    base = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{base}, {fields}, error string")


def recorded_usage(calls: DataFrame) -> DataFrame:
    """M8: counters clamped: none below 0, cached at most the input; missing ones mean that telemetry is unavailable."""
    low = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    return calls.withColumn("telemetry_available", F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()).withColumn("cached_input_tokens", F.least(low("cached_input_tokens"), low("input_tokens"))).withColumn("input_tokens", low("input_tokens")).withColumn("output_tokens", low("output_tokens"))


def recognised_regions(pages: DataFrame, key: list[str], result: str, width: str, height: str) -> DataFrame:
    """Regions of a service's JSON (a list named blocks, or parsing_res_list, at the top or one level down) with boxes in the unit square, in reading order."""
    item = "array<struct<block_label:string,block_content:string,block_bbox:array<double>,block_order:int,label:string,content:string,bbox:array<double>>>"
    j = F.col(result)
    found = F.coalesce(*[F.from_json(F.get_json_object(j, p), item) for p in ("$.parsing_res_list", "$.res.parsing_res_list", "$.blocks", "$.result.blocks")])
    rows = pages.select(*key, F.col(width).alias("w"), F.col(height).alias("h"), F.posexplode_outer(found).alias("pos", "b")).where("b IS NOT NULL")
    box = F.coalesce("b.block_bbox", "b.bbox")
    unit = lambda i, size: F.least(F.greatest(box[i] / F.col(size), F.lit(0.0)), F.lit(1.0))
    x, y = (unit(0, "w"), unit(2, "w")), (unit(1, "h"), unit(3, "h"))
    return rows.select(*key, F.coalesce("b.block_order", "pos").alias("idx"), F.coalesce("b.block_label", "b.label").alias("label"), F.coalesce("b.block_content", "b.content").alias("content"), F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1")).where("x1 > x0 AND y1 > y0")


def expected_pages(pages: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Every page once; a page without a result is an error row."""
    return pages.join(results, key, "left").withColumn("error", F.coalesce("error", F.when(F.col("content").isNull(), "no result")))


def limited_regions(regions: DataFrame, by: list[str], most: int) -> DataFrame:
    """Pages with more regions than a limit are an error of their own."""
    n = regions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_regions"))
    return n.withColumn("error", F.when(F.col("n_regions") > most, "too many regions"))


def node_type(label: Column) -> Column:
    """Detector label to block type."""
    l = F.lower(label)
    return (
        F.when(l.contains("title") | l.contains("heading"), "heading").when(l.contains("table"), "table").when(l.contains("list"), "list_item").when(l.contains("checkbox"), "checkbox")
        .when(l.contains("form"), "form_field").when(l.contains("chart"), "chart").when(l.contains("image") | l.contains("figure"), "figure").when(l.contains("header"), "header").when(l.contains("footer"), "footer").otherwise("paragraph")
    )


def complexity(regions: DataFrame, by: list[str]) -> DataFrame:
    """Page features: two columns, share of tables and pictures, rotation of the text."""
    kind, size = node_type(F.col("label")), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    left, right = F.count_if(F.col("x1") <= 0.55), F.count_if(F.col("x0") >= 0.45)
    tables, pictures = F.coalesce(F.sum(F.when(kind == "table", size)), F.lit(0.0)), F.coalesce(F.sum(F.when(kind.isin("figure", "chart"), size)), F.lit(0.0))
    return regions.groupBy(*by).agg(((left >= 2) & (right >= 2)).alias("two_columns"), tables.alias("table_area"), pictures.alias("picture_area"), F.when(tables + pictures >= 0.5, "complex").when((tables + pictures >= 0.15) | ((left >= 2) & (right >= 2)), "mixed").otherwise("simple").alias("complexity"))


def cross_check(candidates: DataFrame, alternatives: DataFrame, by: list[str], similarity: Callable[[str, str], Column], agree: float = 0.9, per_page: int = 2, in_all: int = 16) -> DataFrame:
    """The least certain regions are compared with the best alternative reading: agreed, disagreed or unavailable."""
    chosen = joins.capped_topk(candidates, [*by, "page"], ["confidence", "page", "id"], per_page, in_all, by)
    pairs = chosen.join(alternatives, [*by, "page", "id"], "left").withColumn("similarity", similarity("text", "other_text"))
    best = joins.best_match(pairs, [*by, "page", "id"], "similarity", "other_index")
    return best.withColumn("outcome", F.when(F.col("other_text").isNull(), "unavailable").when(F.col("similarity") >= agree, "agreed").otherwise("disagreed"))


def with_fallback(refined: DataFrame, base: DataFrame, key: list[str], column: str) -> DataFrame:
    """The refined text where a model gave one, else the base."""
    r = refined.select(*key, F.col(column).alias("_r"))
    return base.join(r, key, "left").withColumn("refined", F.col("_r").isNotNull()).withColumn(column, F.coalesce("_r", column)).drop("_r")


def reviewed_segments(original: DataFrame, edits: DataFrame, by: list[str]) -> DataFrame:
    """Human edits over predicted segments: changed, confirmed or added, numbered by page."""
    from .windows import numbering

    o = original.select(*by, "segment_id", F.col("start_page").alias("_s"), F.col("end_page").alias("_e"), F.col("category").alias("_c"))
    j = edits.join(o, [*by, "segment_id"], "left")
    same = (F.col("start_page") == F.col("_s")) & (F.col("end_page") == F.col("_e")) & (F.col("category") == F.col("_c"))
    j = j.withColumn("review_status", F.when(F.col("_s").isNull(), "added").when(same, "confirmed").otherwise("changed")).drop("_s", "_e", "_c")
    return numbering(j, by, ["start_page", "segment_id"], "number")


def without_ai(runs: DataFrame) -> DataFrame:
    """V9: whether a run used no model at all."""
    return runs.groupBy("run_id").agg(F.bool_and((F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)).alias("local_only"))


def region_progress(events: DataFrame) -> DataFrame:
    """Region events (stage, current, total, page_position, n_pages) as thousandths of a page: done of n_pages * 1000."""
    share = F.when(F.col("stage") == "layout", 0.025).otherwise(0.05 + 0.95 * F.col("current") / F.greatest("total", F.lit(1)))
    return events.where("page_position IS NOT NULL").withColumns({"done": F.rint((F.col("page_position") + share) * 1000).cast("bigint"), "of": (F.col("n_pages") * 1000).cast("bigint")})
