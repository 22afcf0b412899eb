"""Box expressions over struct<l, t, r, b, coord_origin>: M1-M11."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_left(box: Column, page_height: Column | None = None) -> Column:
    """M1: the box as struct<x0, y0, x1, y1> with y growing downwards."""
    height = F.coalesce(page_height, F.greatest(box["t"], box["b"])) if page_height is not None else F.greatest(box["t"], box["b"])
    up = box["coord_origin"] == "BOTTOMLEFT"
    y0, y1 = F.least(box["t"], box["b"]), F.greatest(box["t"], box["b"])
    return F.struct(F.least(box["l"], box["r"]).alias("x0"), F.when(up, height - y1).otherwise(y0).alias("y0"), F.greatest(box["l"], box["r"]).alias("x1"), F.when(up, height - y0).otherwise(y1).alias("y1"))


def from_top_left(rect: Column, origin: Column, page_height: Column) -> Column:
    """M2."""
    up = origin == "BOTTOMLEFT"
    return F.struct(rect["x0"].alias("l"), F.when(up, page_height - rect["y0"]).otherwise(rect["y0"]).alias("t"), rect["x1"].alias("r"), F.when(up, page_height - rect["y1"]).otherwise(rect["y1"]).alias("b"), origin.alias("coord_origin"))


def area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    """M3: the share of ``inner`` within ``outer``; 0 for an empty one."""
    return F.coalesce(F.try_divide(intersection(inner, outer), area(inner)), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """M4."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def centre_distance(a: Column, b: Column, scale_x: Column | float = 1.0, scale_y: Column | float = 1.0) -> Column:
    """M5: between centres, in units of the scales; infinite if a box is missing."""
    dx = (a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2 / scale_x
    dy = (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2 / scale_y
    return F.coalesce(F.hypot(dx, dy), F.lit(float("inf")))


def bbox_warning(box: Column, width: Column, height: Column) -> Column:
    """M6: the first that applies of wrong order, outside the page, smaller than half a percent of it; else null."""
    r = top_left(box, height)
    wrong = (box["l"] >= box["r"]) | F.when(box["coord_origin"] == "BOTTOMLEFT", box["b"] >= box["t"]).otherwise(box["t"] >= box["b"])
    outside = (r["x0"] < 0) | (r["y0"] < 0) | (r["x1"] > width) | (r["y1"] > height)
    small = area(r) < 0.005 * width * height
    return F.when(wrong, "invalid_order").when(outside, "outside_page").when(small, "too_small")


def from_unit_box(box: Column, width: Column, height: Column) -> Column:
    """M7: a 0-1 box with y downwards as page units with y upwards; zeros if missing."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(z(box["x0"] * width).alias("l"), z((1 - box["y0"]) * height).alias("t"), z(box["x1"] * width).alias("r"), z((1 - box["y1"]) * height).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))


def crop_region(rect: Column, width: Column, height: Column, padding: float = 0.03) -> Column:
    """M8: a 0-1 rectangle in pixels, padded and clamped, with a warning for tiny and page-filling ones."""
    x0, y0 = F.greatest(F.floor((rect["x0"] - padding) * width), F.lit(0)), F.greatest(F.floor((rect["y0"] - padding) * height), F.lit(0))
    x1, y1 = F.least(F.ceil((rect["x1"] + padding) * width), width.cast("long")), F.least(F.ceil((rect["y1"] + padding) * height), height.cast("long"))
    w, h = x1 - x0, y1 - y0
    warning = F.when((w < 20) | (h < 20), "too_small").when(w * h > 0.9 * width * height, "nearly_full_page")
    return F.struct(x0.alias("x"), y0.alias("y"), w.alias("w"), h.alias("h"), warning.alias("warning"))


def snap_confidence(overlap: Column) -> Column:
    """M9: trust in a snapped box by its overlap with the rough one."""
    return F.when(overlap < 0.2, F.lit(0.6)).otherwise(F.least(F.lit(1.0), 0.8 + 0.2 * overlap))


def gutter_score(blank: Column, side: Column, width: Column) -> Column:
    """M10."""
    return 0.35 * blank + 0.45 * F.least(F.lit(1.0), side / 0.45) + 0.2 * width


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The shared stretch over the shorter one; 0 if either is empty."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    return F.coalesce(F.try_divide(shared, F.least(a1 - a0, b1 - b0)), F.lit(0.0))


def orphan_caption_score(distance: Column, labelled: Column, patterned: Column) -> Column:
    """M14."""
    s = 0.55 + F.greatest(F.lit(0.0), 1 - 2 * distance) * 0.25 + 0.15 * labelled.cast("int") + 0.15 * patterned.cast("int")
    return F.least(F.lit(1.0), s)
