"""Rectangles, and text widths and fits by the unmeasured-width rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import clamp, half_up, layer, lit

ADVANCE = 0.52


def rect(left, top, width, height) -> Column:
    return F.struct(lit(left).alias("left"), lit(top).alias("top"), lit(width).alias("width"), lit(height).alias("height"))


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["width"]) * F.greatest(F.lit(0.0), r["height"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 without overlap."""
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when((both > 0) & (whole > 0), both / whole).otherwise(0.0)


def to_page(r: Column, page_width, page_height, source_width, source_height) -> Column:
    """Source pixels to page points, sides 0.2 at least."""
    sx, sy = lit(page_width) / F.greatest(lit(source_width), F.lit(1.0)), lit(page_height) / F.greatest(lit(source_height), F.lit(1.0))
    num = {k: F.coalesce(r[k], F.lit(0.0)) for k in ("left", "top", "width", "height")}
    return rect(num["left"] * sx, num["top"] * sy, F.greatest(num["width"] * sx, F.lit(0.2)), F.greatest(num["height"] * sy, F.lit(0.2)))


def moved(base_left, base_top, left, top) -> Column:
    return (F.abs(left - base_left) > 0.5) | (F.abs(top - base_top) > 0.5)


def rounded(r: Column) -> Column:
    """Whole pixels, sides 2 at least."""
    return rect(half_up(r["left"]), half_up(r["top"]), F.greatest(half_up(r["width"]), F.lit(2.0)), F.greatest(half_up(r["height"]), F.lit(2.0)))


def page_width_of(chars: Column, size: Column) -> Column:
    """Unmeasured width of a run on the page: no size below 8."""
    return chars * F.greatest(size, F.lit(8.0)) * ADVANCE


def export_width_of(chars: Column, size: Column) -> Column:
    """Unmeasured width of a run in the export: no size below 1, never narrower than 0.4 of the size."""
    s = F.greatest(size, F.lit(1.0))
    return F.when(chars == 0, 0.0).otherwise(F.greatest(chars * s * ADVANCE, s * 0.4))


def run_width(chars: Column, size: Column, tracking: Column, stretch: Column) -> Column:
    spread = F.greatest(chars - 1, F.lit(0)) * tracking * size
    return F.when(chars == 0, 0.0).otherwise(F.greatest((export_width_of(chars, size) + spread) * stretch, F.lit(0.0)))


def fit_size(chars: Column, size: Column, most: Column, tracking: Column, stretch: Column, floor: float = 0.68, steps: int = 14) -> Column:
    """The largest size, by bisection, at which a run is no wider than ``most``; ``floor`` of the size at least."""
    full = F.greatest(size, F.lit(1.0))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2.0
        wide = run_width(chars, mid, tracking, stretch) > most
        return F.struct(F.when(wide, s["low"]).otherwise(mid).alias("low"), F.when(wide, mid).otherwise(s["high"]).alias("high"))

    start = F.struct(F.greatest(full * floor, F.lit(1.0)).alias("low"), full.alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: F.greatest(s["low"], F.lit(1.0)))
    return F.when((run_width(chars, full, tracking, stretch) <= most) | (most <= 1.0), full).otherwise(found)


def with_fit_size(rows: DataFrame, name: str, chars: Column, size: Column, most: Column, tracking: Column, stretch: Column, floor: float = 0.68, steps: int = 14) -> DataFrame:
    """``rows`` with ``fit_size`` as a column: the halvings are layers of plain columns, so they compile into one loop."""
    kept = rows.columns
    full = F.greatest(size, F.lit(1.0))
    out = rows.withColumns({"__full": full, "__chars": chars, "__most": most, "__tracking": tracking, "__stretch": stretch})
    out = out.withColumns({"__low": F.greatest(F.col("__full") * floor, F.lit(1.0)), "__high": F.col("__full")})
    width = lambda c: run_width(F.col("__chars"), F.col(c), F.col("__tracking"), F.col("__stretch"))
    for _ in range(steps):
        out = out.withColumn("__mid", (F.col("__low") + F.col("__high")) / 2.0)
        out = out.withColumn("__wide", width("__mid") > F.col("__most"))
        out = out.withColumns({"__low": F.when(F.col("__wide"), F.col("__low")).otherwise(F.col("__mid")), "__high": F.when(F.col("__wide"), F.col("__mid")).otherwise(F.col("__high"))})
    fits = (width("__full") <= F.col("__most")) | (F.col("__most") <= 1.0)
    # a layer, so that no filter on the size is copied through the halvings
    out = layer(out, __fit=F.when(fits, F.col("__full")).otherwise(F.greatest(F.col("__low"), F.lit(1.0))))
    return out.select(*[F.col(f"`{c}`") for c in kept if c != name], F.col("__fit").alias(name))


def fit_tracking(chars: Column, size: Column, tracking: Column, stretch: Column, most: Column) -> Column:
    """Tracking drawn in until the run fits, between -0.08 and what it was."""
    width = run_width(chars, size, tracking, stretch)
    less = (width - most) / (F.greatest(chars - 1, F.lit(1)) * F.greatest(size, F.lit(1.0)) * F.greatest(stretch, F.lit(0.1)))
    return F.when((chars < 2) | (width <= most) | (most <= 1.0), tracking).otherwise(clamp(tracking - less, F.lit(-0.08), tracking))


def stretch_to(chars: Column, size: Column, target: Column) -> Column:
    """Horizontal scale that gives a run its target width."""
    measured = page_width_of(chars, size)
    return F.when(measured > 0, clamp(F.greatest(target, F.lit(2.0)) / measured, 0.58, 1.9)).otherwise(1.0)


def own_glyphs(tracking: Column, stretch: Column) -> Column:
    """Whether glyphs are placed one by one."""
    return (F.abs(tracking) > 0.001) | (F.abs(stretch - 1.0) > 0.015)
