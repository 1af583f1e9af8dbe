"""Order-dependent reductions inside one group: packing, greedy suppression, duplicate blocks, union areas.

Each runs per group (a document or a page) through applyInPandas, cells of tables as a stream; groups are small by nature, and a document is the unit of order.
"""

from __future__ import annotations

import bisect
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES, MAX_CHARACTERS = 8, 48_000


def pack(pages: DataFrame, by: str, order: str, size: str, oversize: str = "split", max_pages: int = MAX_PAGES, max_size: int = MAX_CHARACTERS) -> DataFrame:
    """Greedy contexts. A context closes at max_pages or before max_size would be passed; an oversize page closes it too and then
    stands in contexts of its own (``split``: slices of half the limit) or is left out (``skip``). Gives by, order, context (null if skipped), part."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        context, n, held, out = -1, 0, 0, []
        for row in group.sort_values(order).itertuples(index=False):
            key, at, length = getattr(row, by), getattr(row, order), getattr(row, size)
            if length > max_size:
                n = held = 0
                if oversize == "skip":
                    out.append((key, at, None, 0))
                else:
                    for part in range(-(-length // (max_size // 2))):
                        context += 1
                        out.append((key, at, context, part))
                continue
            if n == 0 or n >= max_pages or held + length > max_size:
                context, n, held = context + 1, 0, 0
            n, held = n + 1, held + length
            out.append((key, at, context, 0))
        return pd.DataFrame(out, columns=[by, order, "context", "part"])

    t = dict(pages.dtypes)
    return pages.select(by, order, size).groupBy(by).applyInPandas(fold, f"`{by}` {t[by]}, `{order}` {t[order]}, context bigint, part bigint")


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersection of box a with boxes b, and their areas."""
    w = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None)
    h = np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
    size = lambda x: np.clip(x[..., 2] - x[..., 0], 0, None) * np.clip(x[..., 3] - x[..., 1], 0, None)
    return w * h, size(a), size(b)


def suppress(candidates: DataFrame, by: list[str], rank: list[str], iou: float = 0.5, containment: float = 0.85) -> DataFrame:
    """L1: in rank order, a candidate stays unless it overlaps one that stayed (IoU, or overlap over the smaller box). Equal boxes keep their best rank first."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(rank, kind="stable")
        boxes = group[["x0", "y0", "x1", "y1"]].to_numpy(float)
        kept: list[int] = []
        for i in range(len(boxes)):
            if kept:
                inter, own, other = _overlap(boxes[i], boxes[kept])
                union, small = own + other - inter, np.minimum(own, other)
                near = (np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) >= iou) | (np.divide(inter, small, out=np.zeros_like(inter), where=small > 0) >= containment)
                if near.any():
                    continue
            kept.append(i)
        return group.iloc[kept]

    return candidates.groupBy(*by).applyInPandas(fold, candidates.schema)


def detector_dedup(regions: DataFrame, by: list[str], order: str = "idx", overlap: float = 0.9) -> DataFrame:
    """In detector order, a region whose overlap over the smaller box with an earlier one is high is that one again; the more confident gives label, confidence and box, the earlier keeps its index."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in group.sort_values(order).to_dict("records"):
            if kept:
                inter, own, other = _overlap(np.array([row[c] for c in ("x0", "y0", "x1", "y1")]), np.array([[k[c] for c in ("x0", "y0", "x1", "y1")] for k in kept]))
                small = np.minimum(own, other)
                hit = np.flatnonzero(np.divide(inter, small, out=np.zeros_like(inter), where=small > 0) >= overlap)
                if len(hit):
                    old = kept[hit[0]]
                    if row["confidence"] > old["confidence"]:
                        kept[hit[0]] = {**row, order: old[order]}
                    continue
            kept.append(row)
        return pd.DataFrame(kept, columns=group.columns)

    return regions.groupBy(*by).applyInPandas(fold, regions.schema)


def block_dedup(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Duplicate blocks of a page. blocks: id, type, reading_order, fingerprint, x0..y1, rejected, verified, confidence.

    In reading order, a block repeats an earlier one of its type when the fingerprints are equal and so is the order or the boxes overlap
    (IoU 0.8), or when both reach the bottom edge, one is clipped and the fingerprints are 0.75 alike. The better one of the two stays
    (not rejected, not clipped, verified, confident, large; unknown confidence counts below any)."""
    from ..functions.text import matching_ratio

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        cols = ("x0", "y0", "x1", "y1")

        def area(r):
            return max(r["x1"] - r["x0"], 0) * max(r["y1"] - r["y0"], 0)

        def cut(r):
            return area(r) == 0 or r["y0"] >= 0.999 or r["x0"] >= 0.999

        def better(r):
            return (not r["rejected"], not cut(r), bool(r["verified"]), -1.0 if pd.isna(r["confidence"]) else r["confidence"], area(r))

        def again(a, b):
            if a["type"] != b["type"] or not a["fingerprint"] or not b["fingerprint"]:
                return False
            if a["fingerprint"] == b["fingerprint"]:
                inter, x, y = _overlap(np.array([a[c] for c in cols], float), np.array([[b[c] for c in cols]], float))
                union = float(x + y[0] - inter[0])
                if a["reading_order"] == b["reading_order"] or (union and inter[0] / union >= 0.8):
                    return True
            low = a["y1"] >= 0.95 and b["y1"] >= 0.95 and (cut(a) or cut(b))
            return low and matching_ratio(a["fingerprint"], b["fingerprint"], autojunk=False) >= 0.75

        for row in group.sort_values(["reading_order", "id"]).to_dict("records"):
            same = next((i for i, k in enumerate(kept) if again(k, row)), None)
            if same is None:
                kept.append(row)
            elif better(row) > better(kept[same]):
                kept[same] = row
        return pd.DataFrame(kept, columns=group.columns)

    return blocks.groupBy(*by).applyInPandas(fold, blocks.schema)


def covered_area(boxes: np.ndarray) -> float:
    """Area of the union of boxes: strips between x edges, each with its merged y intervals."""
    boxes = boxes[(boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])]
    if not len(boxes):
        return 0.0
    boxes = boxes[np.argsort(boxes[:, 1], kind="stable")]
    xs, total = np.unique(boxes[:, [0, 2]]), 0.0
    for left, right in zip(xs, xs[1:]):
        strip = boxes[(boxes[:, 0] <= left) & (boxes[:, 2] >= right)]
        if len(strip):
            reach = np.maximum.accumulate(strip[:, 3])
            before = np.concatenate([[-np.inf], reach[:-1]])
            total += (right - left) * float(np.clip(strip[:, 3] - np.maximum(strip[:, 1], before), 0, None).sum())
    return total


def union_area(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Area of the union of each group's boxes. Groups stand whole and in order in their partition and are read as a stream, so that many small ones cost one batch."""
    corners = ("x0", "y0", "x1", "y1")

    def run(batches):
        held = None  # rows of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held, batch])
            if held is not None and _same_group(held[0].slice(0, 1), batch.slice(batch.num_rows - 1), by):
                held.append(batch)  # one group so far: it is put together once, at its end
                continue
            starts = _group_starts(table, by)
            held = table.slice(int(starts[-1])).to_batches()
            if len(starts) > 1:
                yield from areas(table.slice(0, int(starts[-1])), starts[:-1])
        if held is not None:
            yield from areas(pa.Table.from_batches(held), np.array([0]))

    def areas(table: pa.Table, starts: np.ndarray):
        xy = np.column_stack([table[c].to_numpy().astype(float) for c in corners])
        found = [covered_area(xy[i:j]) for i, j in zip(starts, [*starts[1:], len(xy)])]
        firsts = table.select(by).take(pa.array(starts))
        yield from pa.Table.from_arrays([*firsts.columns, pa.array(found, pa.float64())], names=[*by, "union_area"]).to_batches()

    t = dict(boxes.dtypes)
    ordered = boxes.select(*by, *[F.col(c).cast("double").alias(c) for c in corners]).repartition(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {t[c]}" for c in by) + ", union_area double")


def _group_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    """First rows of runs of equal keys; nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in by:
        column = table[c].combine_chunks()
        codes = pc.fill_null(column.dictionary_encode().combine_chunks().indices if isinstance(column, pa.ChunkedArray) else column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _same_group(a: pa.RecordBatch, b: pa.RecordBatch, by: list[str]) -> bool:
    return all(a.column(c).to_pylist() == b.column(c).to_pylist() for c in by)


def covered_fraction(boxes: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """Share of each group's region (rx0..ry1) that its boxes cover."""
    cut = boxes.join(regions, by).select(*by, F.greatest("x0", "rx0").alias("x0"), F.greatest("y0", "ry0").alias("y0"), F.least("x1", "rx1").alias("x1"), F.least("y1", "ry1").alias("y1"))
    size = (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0"))
    return regions.join(union_area(cut, by), by, "left").select(*by, F.when(size > 0, F.coalesce("union_area", F.lit(0.0)) / size).otherwise(0.0).alias("covered"))


class Grid:
    """Columns that the cells of one table take, given by row and place. A cell that reaches below its row is one interval of columns with the
    row behind it, so a span of any number of rows or columns takes one entry while it lasts."""

    __slots__ = ("row", "column", "held", "next")

    def __init__(self):
        self.row, self.column, self.held, self.next = None, 0, [], 0  # held: spans (first column, column behind, row behind) by first column

    def place(self, row: int, down: int, across: int) -> int:
        """The first free column of the row for a cell of that many rows and columns; it may run over a span beside it."""
        if row != self.row:
            self.row, self.column, self.held, self.next = row, 0, [x for x in self.held if x[2] > row], 0
        held, column, i = self.held, self.column, self.next
        while i < len(held) and held[i][0] <= column:
            column, i = max(column, held[i][1]), i + 1
        if down > 1:
            bisect.insort(held, (column, column + across, row + down))
            i += 1
        self.column, self.next = column + across, i
        return column


def place_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Table cells (row, seq, row_span, col_span and more) put on the grid; a cell takes the first free column of its row, and may run over a span beside it.

    Tables stand whole and in order in their partition and are read as a stream.
    """

    def run(batches):
        key, grid = None, Grid()
        for batch in batches:
            named, columns = {n: batch.column(n) for n in batch.schema.names}, []
            for k, r, down, across in zip(zip(*[named[b].to_pylist() for b in by]), *[named[n].to_pylist() for n in ("row", "row_span", "col_span")]):
                if k != key:
                    key, grid = k, Grid()
                columns.append(grid.place(r, down, across))
            yield pa.RecordBatch.from_arrays([*[named[b] for b in by], named["row"], pa.array(columns, pa.int64()), named["row_span"], named["col_span"], *[named[n] for n in rest]], names=[*by, "row", "column", "row_span", "col_span", *rest])

    t = dict(cells.dtypes)
    rest = [c for c in cells.columns if c not in (*by, "seq", "row", "row_span", "col_span")]
    whole = cells.select(*by, "seq", F.col("row").cast("bigint").alias("row"), *[F.col(c).cast("bigint").alias(c) for c in ("row_span", "col_span")], *rest)
    ordered = whole.repartition(*by).sortWithinPartitions(*by, "row", "seq")
    return ordered.mapInArrow(run, ", ".join(f"`{b}` {t[b]}" for b in by) + ", row bigint, column bigint, row_span bigint, col_span bigint" + "".join(f", `{c}` {t[c]}" for c in rest))
