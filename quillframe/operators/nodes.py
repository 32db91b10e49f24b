"""A box's mask and text nodes: sizes under scale, placement, scale recalibration; snapshots; typography calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import clamp, number_or
from ..functions import geom, text
from . import masks
from .first_best import first_best

#: What a snapshot keeps of a box.
SNAPSHOT = ("kind", "original_text", "edited_text", "has_edit", "is_deleted", "base_left", "base_top", "base_width", "base_height", "left", "top", "scale_x")


def scaled(size: Column, scale: Column) -> Column:
    """A node's size as it shows, 0 at least."""
    return F.greatest(number_or(size, 0.0) * number_or(scale, 1.0), F.lit(0.0))


def base_dimension(base: Column, size: Column, scale: Column, least: float) -> Column:
    """A group's own base size; its mask's, ``least`` at least, where it has none above 0."""
    known = base.isNotNull() & ~F.isnan(base) & (base > 0) & (base < float("inf"))
    return F.when(known, base).otherwise(F.greatest(scaled(size, scale), F.lit(least)))


def mask_rect(left: Column, top: Column, width: Column, height: Column, scale_x: Column, scale_y: Column) -> Column:
    """The mask in whole pixels."""
    return geom.rounded(geom.rect(F.coalesce(left, F.lit(0.0)), F.coalesce(top, F.lit(0.0)), scaled(width, scale_x), scaled(height, scale_y)))


def text_place(mask_left: Column, mask_top: Column, pad_x: Column, pad_y: Column, ink_x: Column, ink_y: Column, mask_width: Column) -> Column:
    """Where the text node stands in its mask, and the room it has."""
    px, py = F.coalesce(pad_x, F.lit(2.0)), F.coalesce(pad_y, F.lit(1.0))
    at = [F.coalesce(m, F.lit(0.0)) + p + F.coalesce(i, F.lit(0.0)) for m, p, i in ((mask_left, px, ink_x), (mask_top, py, ink_y))]
    return F.struct(at[0].alias("left"), at[1].alias("top"), F.greatest(F.greatest(mask_width, F.lit(6.0)) - px * 2, F.lit(4.0)).alias("width"))


def recalibrated(boxes: DataFrame) -> DataFrame:
    """Horizontal scales worked out from the mask's width; an original scale that is a number stays, blank boxes stay as they are."""
    sample = F.coalesce(F.nullif("original_text", F.lit("")), F.col("edited_text"), F.lit(""))
    target = F.greatest(scaled(F.col("mask_width"), F.col("mask_scale")) - F.coalesce("pad_x", F.lit(2.0)) * 2, F.lit(4.0))
    derived = geom.stretch_to(F.length(sample), number_or(F.col("font_size"), 12.0), target)
    out = boxes.withColumns({"__shown": text.visible(sample), "__derived": derived})
    own = F.col("original_scale_x")
    odd = own.isNull() | F.isnan(own) | (F.abs(own) == float("inf"))
    original = F.when(F.col("__shown") & odd, F.col("__derived")).otherwise(own)
    out = out.withColumn("original_scale_x", original)
    scale = clamp(number_or(F.col("original_scale_x"), number_or(F.col("__derived"), 1.0)), 0.5, 2.2)
    return out.withColumn("scale_x", F.when(F.col("__shown"), scale).otherwise(F.col("scale_x"))).drop("__shown", "__derived")


def comparable(original_text: Column, cached: Column | None = None) -> Column:
    """The original as edits are compared with it; what was kept before goes first."""
    own = text.commit(original_text)
    return own if cached is None else F.coalesce(cached, own)


def snapshot(boxes: DataFrame, keep: tuple[str, ...] = SNAPSHOT) -> Column:
    """A box as JSON: the kept properties alone."""
    return F.to_json(F.struct(*[F.col(c) for c in keep if c in boxes.columns]), {"ignoreNullFields": "false"})


def restored(rows: DataFrame, column: str, like: DataFrame, keep: tuple[str, ...] = SNAPSHOT) -> DataFrame:
    """Boxes of snapshots, with the types they had, and their flags worked out anew."""
    types = dict(like.dtypes)
    read = rows.withColumn("__box", F.from_json(column, ", ".join(f"`{c}` {types[c]}" for c in keep if c in types)))
    out = read.select(*[F.col(c) for c in rows.columns if c != column and c not in keep], "__box.*")
    flags = {"has_edit": F.coalesce("has_edit", F.lit(False)) | F.coalesce("is_deleted", F.lit(False)), "is_deleted": F.coalesce("is_deleted", F.lit(False))}
    return out.withColumns(flags)


def calibrated(boxes: DataFrame, rendered: DataFrame, key: str, reference: str = "mask") -> DataFrame:
    """Boxes with the best of their rendered candidates (seq, size, scale, ascent, candidate): the least score, the first of equals.

    Rendering is outside; candidates come with their masks. Reference masks without ink, or with
    under 8 points of it, take no candidate.
    """
    refs = boxes.select(key, F.col(reference).alias("__ref"))
    # equal masks have equal scores: the first of them stands for all
    first = rendered.groupBy(key, "candidate").agg(F.min(F.struct("seq", "size", "scale", "ascent")).alias("c")).select(key, "candidate", "c.*")
    met = first.join(refs, key).withColumn("score", masks.score(F.col("__ref"), F.col("candidate"))).where(F.col("score") < float("inf"))
    best = first_best(met, [key], [F.col("score"), F.col("seq")], ["seq", "score", "size", "scale", "ascent"])
    return boxes.join(best, key, "left")
