"""Box arithmetic as Columns. A box is a struct of x1, y1, x2, y2 doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), SIDES, strict=True)])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where a box is missing or both are empty."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = wide * high
    union = area(a) + area(b) - both
    return F.coalesce(F.when(union > 0, both / union).otherwise(0.0), F.lit(0.0))


def repaired(b: Column) -> Column:
    """Reversed sides swapped."""
    return box(F.least(b["x1"], b["x2"]), F.least(b["y1"], b["y2"]), F.greatest(b["x1"], b["x2"]), F.greatest(b["y1"], b["y2"]))


def strict(coords: Column, space: Column, width: Column, height: Column) -> Column:
    """struct<box, status> of four coordinates in a source space, on the unit page.

    Statuses: malformed, unsupported_space, reversed_or_degenerate, outside_page, clipped, ok; the box is null unless ok or clipped.
    """
    finite = F.forall(coords, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce((F.size(coords) == 4) & finite, F.lit(False))
    sx = F.when(space == "pixel", width).when(space == "normalized_1000", 1000.0).when(space == "normalized_1", 1.0)
    sy = F.when(space == "pixel", height).when(space == "normalized_1000", 1000.0).when(space == "normalized_1", 1.0)
    at = lambda i, s: F.when(good, F.get(coords, F.lit(i)) / s)
    raw = box(at(0, sx), at(1, sy), at(2, sx), at(3, sy))
    held = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    cut = box(*[held(raw[s]) for s in SIDES])
    empty = lambda b: (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"])
    same = (cut["x1"] == raw["x1"]) & (cut["y1"] == raw["y1"]) & (cut["x2"] == raw["x2"]) & (cut["y2"] == raw["y2"])
    status = (
        F.when(~good, "malformed")
        .when(sx.isNull() | sy.isNull() | (sx <= 0) | (sy <= 0), "unsupported_space")
        .when(empty(raw), "reversed_or_degenerate")
        .when(empty(cut), "outside_page")
        .when(same, "ok")
        .otherwise("clipped")
    )
    return F.struct(F.when(status.isin("ok", "clipped"), cut).alias("box"), status.alias("status"))


def f1(matched: Column, predicted: Column, truth: Column, empty: float | None = 1.0) -> Column:
    """2m / (p + t); ``empty`` if both are none (None: not applicable)."""
    return F.when(predicted + truth == 0, F.lit(empty).cast("double")).otherwise(2 * matched / (predicted + truth))


def around(polygon: Column) -> Column:
    """Bounds of a polygon given as x, y, x, y, ...; null if the count is odd or below four."""
    x, y = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    return F.when((F.size(polygon) >= 4) & (F.size(polygon) % 2 == 0), box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def compact(b: Column) -> Column:
    """Whole thousandths of the unit page."""
    return F.array(*[F.round(b[s] * 1000).cast("int") for s in SIDES])


def pair_score(a: Column, b: Column) -> Column:
    """The larger of the overlap and the nearness of the centres in sizes of the second box."""
    dx, dy = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2, (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    size = F.greatest(F.lit(1e-9), F.hypot(b["x2"] - b["x1"], b["y2"] - b["y1"]))
    return F.greatest(iou(a, b), F.greatest(F.lit(0.0), 1 - F.hypot(dx, dy) / size))
