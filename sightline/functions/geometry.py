"""Boxes and intervals as column expressions. A box is four flat doubles x1, y1, x2, y2 under a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def normalized(px: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """Pixel corners divided by the frame's size and clamped to [0, 1]."""
    return tuple(clamp01(c / d) for c, d in zip(px, (width, height, width, height)))


def centre(b: tuple[Column, ...]) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def area(b: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def union_box(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def interval_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    union = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when(union > 0, overlap(start_a, end_a, start_b, end_b) / union).otherwise(0.0)


def log_area_ratio(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    tiny = F.lit(1e-6)
    return F.log(F.greatest(area(a), tiny) / F.greatest(area(b), tiny))
