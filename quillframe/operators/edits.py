"""What an edit changes: text, type, place; and what the page shows of it.

A box has original and edit typography (structs family, size, weight, style, char_spacing), texts
original_text and edited_text, flags has_edit and is_deleted, places base_left, base_top, left, top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import clamp, layer, number_or, text_or
from ..functions import font, geom, text
from .first_best import among

TYPE = ("family", "size", "weight", "style", "char_spacing")


def _unlike(a: Column, b: Column, rule) -> Column:
    """Whether ``rule`` gives two texts different values; equal texts aren't looked into."""
    return F.when(a.eqNullSafe(b), F.lit(False)).otherwise(rule(a) != rule(b))


def _family_changed(o: Column, e: Column) -> Column:
    return _unlike(e["family"], o["family"], font.comparable)


def _weight_changed(o: Column, e: Column) -> Column:
    return _unlike(text_or(e["weight"], o["weight"]), o["weight"], font.weight)


def _shape_changed(o: Column, e: Column) -> Column:
    size, spacing = number_or(o["size"], 0.0), F.coalesce(o["char_spacing"], F.lit(0.0))
    slant = _unlike(text_or(e["style"], o["style"]), o["style"], font.comparable)
    return slant | (F.abs(number_or(e["size"], size) - size) > 0.05) | (F.abs(F.coalesce(e["char_spacing"], spacing) - spacing) > 0.01)


def style_changed(o: Column, e: Column) -> Column:
    return _family_changed(o, e) | _weight_changed(o, e) | _shape_changed(o, e)


def with_style_changed(boxes: DataFrame, name: str = "style_changed") -> DataFrame:
    """``boxes`` with ``style_changed`` of their original and edit, a layer for each part of it."""
    o, e = F.col("original"), F.col("edit")
    parts = layer(layer(layer(boxes, __family=_family_changed(o, e)), __weight=_weight_changed(o, e)), __shape=_shape_changed(o, e))
    return layer(parts, **{name: F.col("__family") | F.col("__weight") | F.col("__shape")}).drop("__family", "__weight", "__shape")


def as_original(o: Column) -> Column:
    return F.struct(*[(number_or(o[k], 0.0) if k == "char_spacing" else o[k]).alias(k) for k in TYPE])


def refreshed(boxes: DataFrame, compat: bool = False) -> DataFrame:
    """has_edit worked out anew; what isn't changed goes back to its original.

    An untouched box has no edited text. By the model's own rule (``compat``) that differs from the
    original and counts as an edit that restores it; otherwise it is no edit.
    """
    boxes = layer(with_style_changed(boxes, "__style"), __edited=text.commit(F.col("edited_text")), __original=text.commit(F.col("original_text")))
    edited = F.col("__edited")
    untouched = F.lit(False) if compat else (F.coalesce("edited_text", F.lit("")) == "")
    text_differs = (edited != F.col("__original")) & ~untouched
    deleted = F.coalesce("is_deleted", F.lit(False))
    out = layer(boxes, has_edit=deleted | text_differs | F.col("__style"))
    on = F.col("has_edit")
    fill = F.when(edited == "", F.coalesce("original_text", F.lit(""))).otherwise(F.col("edited_text"))
    return out.withColumns(
        {
            "edited_text": F.when(~on, F.lit("")).when(~deleted, fill).otherwise(F.col("edited_text")),
            "is_deleted": F.when(on, deleted).otherwise(F.lit(False)),
            "edit": F.when(on, F.col("edit")).otherwise(as_original(F.col("original"))),
        }
    ).drop("__style", "__edited", "__original")


def committed(boxes: DataFrame, new_text: Column) -> DataFrame:
    """A new text for each box: blank leaves a tombstone, otherwise the original's type comes back."""
    boxes = layer(boxes, __value=text.commit(new_text), __original=text.commit(F.col("original_text")))
    value, shown = F.col("__value"), F.col("__shown")
    boxes = layer(boxes, __shown=text.visible(value))
    out = boxes.withColumns({"is_deleted": ~shown, "edited_text": F.when(shown, value).otherwise(F.lit("")), "edit": F.when(shown, as_original(F.col("original"))).otherwise(F.col("edit"))})
    return out.withColumn("has_edit", ~shown | (value != F.col("__original"))).drop("__value", "__original", "__shown")


def reset(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"edited_text": F.lit(""), "has_edit": F.lit(False), "is_deleted": F.lit(False), "edit": as_original(F.col("original"))})


def is_moved() -> Column:
    return geom.moved(F.col("base_left"), F.col("base_top"), F.col("left"), F.col("top"))


def effective_type(default_family: str = "Arial, sans-serif", default_size: float = 12.0) -> Column:
    """The typography a box is drawn with."""
    o, e, on = F.col("original"), F.col("edit"), F.col("has_edit")
    base = {"family": text_or(o["family"], default_family), "size": number_or(o["size"], default_size), "weight": text_or(o["weight"], "400"), "style": text_or(o["style"], "normal"), "char_spacing": number_or(o["char_spacing"], 0.0)}
    own = {k: (number_or(e[k], base[k]) if k == "size" else F.coalesce(e[k], base[k]) if k == "char_spacing" else text_or(e[k], base[k])) for k in TYPE}
    return F.struct(*[F.when(on, own[k]).otherwise(base[k]).alias(k) for k in TYPE])


def effective_text(preview: Column | None = None) -> Column:
    """Deleted: nothing; edited: the edit, or the original where that is empty; else the original. A live preview goes first."""
    original = F.coalesce("original_text", F.lit(""))
    plain = F.when(F.col("is_deleted"), F.lit("")).when(F.col("has_edit"), text_or(F.col("edited_text"), original)).otherwise(original)
    return plain if preview is None else F.when(preview.isNotNull(), preview).otherwise(plain)


def mask_size(chars: Column, size: Column, canvas_width: Column) -> Column:
    """Width and height a box takes for its text: as wide as that needs, inside the canvas."""
    pad_x, pad_y = F.coalesce("pad_x", F.lit(2.0)), F.coalesce("pad_y", F.lit(1.0))
    s = F.greatest(size, F.lit(8.0))
    stretch = clamp(number_or(F.col("scale_x"), 1.0), 0.5, 2.2)
    wide = F.greatest(F.col("base_width"), geom.page_width_of(chars, s) * stretch + pad_x * 2 + 4 + F.greatest(F.coalesce("ink_x", F.lit(0.0)), F.lit(0.0)))
    tall = F.greatest(F.col("base_height"), s * 1.2 + pad_y * 2)
    room = F.when(canvas_width > 1, F.greatest(canvas_width - F.col("left") - 2, F.lit(6.0))).otherwise(wide)
    return F.struct(F.when(chars > 0, clamp(wide, F.lit(6.0), room)).otherwise(F.col("base_width")).alias("width"), F.when(chars > 0, F.greatest(tall, F.lit(10.0))).otherwise(F.col("base_height")).alias("height"))


def exportable_pages(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Pages with something to export: any drawing that is no helper, or any box edited or moved."""
    box = F.col("kind") == "text_box"
    own = ~F.col("is_helper") & F.when(box, F.col("has_edit") | is_moved()).otherwise(F.lit(True))
    return objects.groupBy(*keys).agg(F.bool_or(own).alias("exportable"), F.count("*").alias("objects"))


def cleared(objects: DataFrame) -> DataFrame:
    """A page without edits: drawings that aren't helpers go, changed boxes go back."""
    box = F.col("kind") == "text_box"
    kept = objects.where(box | F.col("is_helper"))
    back = box & (F.col("has_edit") | F.col("is_deleted") | is_moved())
    return kept.withColumns({"left": F.when(back, F.col("base_left")).otherwise(F.col("left")), "top": F.when(back, F.col("base_top")).otherwise(F.col("top")), "edited_text": F.when(back, F.lit("")).otherwise(F.col("edited_text")), "has_edit": F.when(back, F.lit(False)).otherwise(F.col("has_edit")), "is_deleted": F.when(back, F.lit(False)).otherwise(F.col("is_deleted"))})


def removed(objects: DataFrame, chosen: Column) -> DataFrame:
    """Chosen boxes become tombstones, other chosen objects go."""
    box = F.col("kind") == "text_box"
    out = objects.where(~(chosen & ~box))
    return out.withColumns({"is_deleted": F.when(chosen, F.lit(True)).otherwise(F.col("is_deleted")), "has_edit": F.when(chosen, F.lit(True)).otherwise(F.col("has_edit")), "edited_text": F.when(chosen, F.lit("")).otherwise(F.col("edited_text"))})


def duplicated(objects: DataFrame, chosen: Column, by: float = 24.0) -> DataFrame:
    """Chosen objects a second time, moved on; boxes aren't duplicated."""
    more = objects.where(chosen & (F.col("kind") != "text_box") & ~F.col("is_helper"))
    return objects.withColumn("copy", F.lit(0)).unionByName(more.withColumns({"left": F.col("left") + by, "top": F.col("top") + by, "copy": F.lit(1)}))


def nudged(objects: DataFrame, chosen: Column, dx: float, dy: float) -> DataFrame:
    return objects.withColumns({"left": F.when(chosen, F.col("left") + dx).otherwise(F.col("left")), "top": F.when(chosen, F.col("top") + dy).otherwise(F.col("top"))})


def spaced(boxes: DataFrame, chosen: Column, spacing: Column, compat: bool = False) -> DataFrame:
    """Letter spacing for chosen boxes, missing edit typography from the original."""
    o, e = F.col("original"), F.col("edit")
    new = F.struct(text_or(e["family"], o["family"]).alias("family"), number_or(e["size"], o["size"]).alias("size"), text_or(e["weight"], text_or(o["weight"], "400")).alias("weight"), text_or(e["style"], text_or(o["style"], "normal")).alias("style"), clamp(spacing, -120.0, 320.0).alias("char_spacing"))
    filled = text_or(F.col("edited_text"), F.coalesce("original_text", F.lit("")))
    hit = boxes.where(chosen).withColumns({"edit": new, "edited_text": F.when(~F.col("is_deleted"), filled).otherwise(F.col("edited_text"))})
    return refreshed(hit, compat).unionByName(boxes.where(~chosen))


def visual_state(editing: Column, edit_mode: Column) -> Column:
    """How a box shows: editing, outlined, changed or hidden; with whether its text does."""
    changed = F.col("has_edit") | is_moved()
    state = F.when(editing, "editing").when(edit_mode, "outlined").when(changed, "changed").otherwise("hidden")
    shows = ~F.col("is_deleted") & (changed | editing)
    return F.struct(state.alias("state"), F.when(state == "hidden", F.lit(False)).otherwise(shows).alias("text_shown"))


def export_state() -> Column:
    """What the export paints of an object: nothing, its mask, mask and text, or a cut-out of the page."""
    box = F.col("kind") == "text_box"
    return (
        F.when(F.col("is_helper"), "hidden").when(~box, "drawn").when(F.col("has_edit") & F.col("is_deleted"), "mask").when(F.col("has_edit"), "mask+text").when(is_moved(), "snapshot").otherwise("hidden")
    )


def origin_masks(boxes: DataFrame) -> DataFrame:
    """A covering rectangle where each moved box stood, sent behind all else."""
    return boxes.where(is_moved()).select(*[c for c in boxes.columns if c.endswith("_id") or c == "page_index"], F.col("base_left").alias("left"), F.col("base_top").alias("top"), F.col("base_width").alias("width"), F.col("base_height").alias("height"), text_or(F.col("mask_color"), "#ffffff").alias("fill"))


def selected(objects: DataFrame, chosen: DataFrame, key: str | list[str]) -> DataFrame:
    """Text boxes among the chosen."""
    return among(objects.where((F.col("kind") == "text_box") & ~F.col("is_helper")), chosen, [key] if isinstance(key, str) else key)


def auto_matched(boxes: DataFrame, compat: bool = False) -> DataFrame:
    """Every box with its original's typography, its scale within limits, and whether it is an edit worked out anew."""
    scale = clamp(number_or(F.col("scale_x"), 1.0), 0.5, 2.2)
    return refreshed(boxes.withColumns({"edit": as_original(F.col("original")), "scale_x": scale}), compat)
