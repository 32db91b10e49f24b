"""Ink masks: thresholds, scores, bounds, sampled colours. Masks are arrays of 0 and 1, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..coerce import clamp, half_up, let, within

#: Factors and offsets of the calibration grid.
SIZES = (0.9, 0.94, 0.98, 1.0, 1.02, 1.06, 1.1)
SCALES = (0.86, 0.92, 0.98, 1.0, 1.02, 1.08, 1.14)
ASCENTS = (-0.04, -0.02, 0.0, 0.02, 0.04)
DARK = "#111827"


def darkness(r: Column, g: Column, b: Column, alpha: Column, compat: bool = False) -> Column:
    """255 less the luminance, by opacity (0 to 255). With ``compat`` a channel of 0 counts as 255."""
    ch = [F.when(F.coalesce(x, F.lit(0.0)) == 0, 255.0).otherwise(x) if compat else F.coalesce(x, F.lit(255.0)) for x in (r, g, b)]
    return (255 - (ch[0] * 0.2126 + ch[1] * 0.7152 + ch[2] * 0.0722)) * (F.coalesce(alpha, F.lit(0.0)) / 255)


def threshold(dark: Column) -> Column:
    """Between the mean and the greatest darkness of an array, 18 to 160."""
    mean = F.aggregate(dark, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(dark), F.lit(1))
    most = F.greatest(F.lit(0.0), F.array_max(dark))
    return clamp(mean + (most - mean) * 0.42, 18.0, 160.0)


def ink(dark: Column, above: Column) -> Column:
    return F.transform(dark, lambda x: F.when(x > above, 1).otherwise(0))


def _count(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, x: n + F.when(x > 0, 1).otherwise(0))


def score(reference: Column, candidate: Column) -> Column:
    """1 - IoU plus 0.35 of the relative difference in ink; infinite for masks of other sizes or under 8 points of ink."""
    both = F.aggregate(F.zip_with(reference, candidate, lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    n, m = _count(reference), _count(candidate)
    value = 1 - both / F.greatest(n + m - both, F.lit(1)) + F.abs(m - n) / F.greatest(n, F.lit(1)) * 0.35
    return F.when((F.size(reference) != F.size(candidate)) | (n < 8), float("inf")).otherwise(value)


def bounds(bits: Column, width: Column) -> Column:
    """min_x, min_y, max_x, max_y, width, height of the ink, or null."""
    places = F.filter(F.transform(bits, lambda b, i: F.when(b > 0, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(places, lambda i: (i % width).cast("int")), F.transform(places, lambda i: F.floor(i / width).cast("int"))
    box = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
    names = ("min_x", "min_y", "max_x", "max_y")
    return F.when(F.size(places) > 0, F.struct(*[v.alias(n) for v, n in zip(box, names, strict=True)], (box[2] - box[0] + 1).alias("width"), (box[3] - box[1] + 1).alias("height")))


def lightest(samples: Column, compat: bool = False) -> Column:
    """Background from samples (structs r, g, b, alpha): the lightest, the first of equals; white without any."""
    seen = F.filter(F.transform(samples, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.coalesce(x["s"]["alpha"], F.lit(0.0)) > 0)
    fix = (lambda v: F.when(F.coalesce(v, F.lit(0.0)) == 0, 255.0).otherwise(v)) if compat else (lambda v: F.coalesce(v, F.lit(255.0)))
    best = F.array_min(F.transform(seen, lambda x: F.struct((-(fix(x["s"]["r"]) + fix(x["s"]["g"]) + fix(x["s"]["b"]))).alias("o"), x["i"].alias("i"), fix(x["s"]["r"]).alias("r"), fix(x["s"]["g"]).alias("g"), fix(x["s"]["b"]).alias("b"))))
    return F.when(best.isNull(), "#ffffff").otherwise(_rgb(best))


def _rgb(c: Column) -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(", ", *[c[k].cast("int").cast("string") for k in "rgb"]), F.lit(")"))


def text_colour(samples: Column) -> Column:
    """Ink colour from samples: the darkest, unless it is too light or washed out to be ink."""
    seen = F.filter(F.transform(samples, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: F.coalesce(x["s"]["alpha"], F.lit(0.0)) > 0)
    best = F.array_min(F.transform(seen, lambda x: F.struct((x["s"]["r"] + x["s"]["g"] + x["s"]["b"]).alias("o"), x["i"].alias("i"), x["s"]["r"].alias("r"), x["s"]["g"].alias("g"), x["s"]["b"].alias("b"))))
    spread = F.greatest(best["r"], best["g"], best["b"]) - F.least(best["r"], best["g"], best["b"])
    light = best["r"] * 0.2126 + best["g"] * 0.7152 + best["b"] * 0.0722
    pale = (light > 170) | ((spread < 44) & (light > 118)) | (best["o"] > 640)
    return F.when(best.isNull() | pale, DARK).otherwise(_rgb(best))


def candidates(size: Column, scale: Column, ascent: Column) -> Column:
    """The calibration grid around a box's type: an array of (seq, size, scale, ascent) in order of trial."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(x).alias("x"), F.lit(a).alias("a")) for i, (s, x, a) in enumerate((s, x, a) for s in SIZES for x in SCALES for a in ASCENTS)])
    own = {"base": F.greatest(size, F.lit(8.0)), "sx": clamp(scale, 0.5, 2.2), "up": clamp(ascent, 0.5, 0.95)}
    tried = lambda v: F.transform(grid, lambda g: F.struct(g["i"].alias("seq"), within(v["base"] * g["s"], 6.0, 180.0).alias("size"), within(v["sx"] * g["x"], 0.5, 2.2).alias("scale"), within(v["up"] + g["a"], 0.5, 0.95).alias("ascent")))
    return let(own, tried)


def sample_points(r: Column, canvas_width: Column, canvas_height: Column) -> Column:
    """The four corner points inside a rectangle, on the canvas."""
    xs, ys = (r["left"] + 1, r["left"] + r["width"] - 2), (r["top"] + 1, r["top"] + r["height"] - 2)
    return F.array(*[F.struct(half_up(clamp(x, F.lit(0.0), canvas_width - 1)).alias("x"), half_up(clamp(y, F.lit(0.0), canvas_height - 1)).alias("y")) for y in ys for x in xs])
