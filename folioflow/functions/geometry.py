"""Box arithmetic as column expressions (F40-F44, V1). A box is a struct x0, y0, x1, y1; a null box has area 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def ordered_unit_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Per-mille coordinates brought to the unit square, clamped, corners put in order."""
    unit = lambda v: F.least(F.greatest(F.when(F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1)) > 1, v / 1000).otherwise(v), F.lit(0.0)), F.lit(1.0))
    return box(F.least(unit(x0), unit(x1)), F.least(unit(y0), unit(y1)), F.greatest(unit(x0), unit(x1)), F.greatest(unit(y0), unit(y1)))


def area(b: Column) -> Column:
    return F.coalesce(F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0)), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.coalesce(F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u != 0, i / u).otherwise(0.0)


def over_smaller(a: Column, b: Column) -> Column:
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def clipped(b: Column) -> Column:
    return F.coalesce((area(b) == 0) | (b["y0"] >= 0.999) | (b["x0"] >= 0.999), F.lit(True))


def valid(b: Column) -> Column:
    """V1: both corners within the unit square and in order."""
    return F.coalesce((b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= 1) & (b["y1"] <= 1) & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"]), F.lit(False))


def crop_pixels(b: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """The padded box in whole pixels within the page; a hair of tolerance keeps exact edges exact."""
    eps = 1e-9
    px = lambda low, high, size: (F.greatest(F.floor((low - padding) * size + eps), F.lit(0)), F.least(F.ceil((high + padding) * size - eps), size))
    (left, right), (top, bottom) = px(b["x0"], b["x1"], width), px(b["y0"], b["y1"], height)
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def polygon_box(points: Column) -> Column:
    """The box around a polygon of struct x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
