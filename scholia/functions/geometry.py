"""Boxes as four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = list[Column]


def _span(a0: Column, a1: Column, b0: Column, b1: Column, one: int) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + one, F.lit(0))


def iou(a: Box, b: Box, one: int = 0) -> Column:
    """Intersection over union; ``one`` is 1 for boxes of whole pixels, whose ends belong to them."""
    both = _span(a[0], a[2], b[0], b[2], one) * _span(a[1], a[3], b[1], b[3], one)
    area = lambda x: (x[2] - x[0] + one) * (x[3] - x[1] + one)
    return both / F.nullif((area(a) + area(b) - both).cast("double"), F.lit(0.0))


def iou_pixels(a: Box, b: Box) -> Column:
    return iou(a, b, 1)


def iou_1d(a0: Column, a1: Column, b0: Column, b1: Column, one: int = 1) -> Column:
    both = _span(a0, a1, b0, b1, one)
    return both / F.nullif(((a1 - a0 + one) + (b1 - b0 + one) - both).cast("double"), F.lit(0.0))


def shape(box: Box, ink: Column, line_height: Column) -> Column:
    """Kind of a mark by its aspect and how much of its box is ink."""
    w, h = box[2] - box[0] + 1, box[3] - box[1] + 1
    aspect, fill = w / F.greatest(F.lit(1), h), ink / F.greatest(F.lit(1), w * h)
    return (
        F.when((aspect > 6) & (h <= line_height * 0.3), "underline")
        .when(ink > 300, "correction")
        .when(aspect.between(0.7, 1.4) & fill.between(0.25, 0.75), "circle")
        .when(aspect.between(0.7, 1.5) & fill.between(0.12, 0.5), "cross")
        .when((aspect > 1.5) & (aspect <= 5) & fill.between(0.12, 0.7), "tick")
        .otherwise("unknown")
    )
