"""Font names: tokens, family lists, canonical stacks, standard fonts.

Rules are ordered; the first that holds wins. ``compat`` on the standard-font resolvers counts the
"serif" inside "sans-serif" as serif, which the model's own rules do; without it only the word alone counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import WS, clamp, leading_int, let, trimmed

#: The generic families.
GENERIC = ("serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui")
#: Family markers, in the order they are tried, and the stack each stands for.
STACKS = (
    (("segoe ui", "segoeui"), "'Segoe UI', Arial, sans-serif"),
    (("arial",), "Arial, 'Helvetica Neue', Helvetica, sans-serif"),
    (("helvetica",), "'Helvetica Neue', Helvetica, Arial, sans-serif"),
    (("calibri",), "Calibri, Arial, sans-serif"),
    (("tahoma",), "Tahoma, 'Segoe UI', Arial, sans-serif"),
    (("verdana",), "Verdana, Arial, sans-serif"),
    (("trebuchet",), "'Trebuchet MS', Arial, sans-serif"),
    (("cambria",), "Cambria, 'Times New Roman', serif"),
    (("times", "garamond", "georgia"), "'Times New Roman', Georgia, serif"),
    (("courier", "consolas", "mono"), "'Courier New', Consolas, monospace"),
)
SANS = "'Helvetica Neue', Arial, sans-serif"
#: Markers of the three standard families, for the page's resolver and for the export's.
TIMES, COURIER = ("times", "georgia", "cambria", "garamond"), ("courier", "consolas", "mono", "vt323")
HELVETICA = ("arial", "helvetica", "calibri", "tahoma", "verdana", "trebuchet", "gaegu", "permanent marker", "caveat", "ibm plex sans")
EXPORT_TIMES, EXPORT_COURIER = ("times", "georgia", "cambria"), ("courier", "mono", "consolas")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _any(value: Column, marks) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(m)) for m in marks])


def unquoted(value: Column) -> Column:
    return F.regexp_replace(trimmed(_text(value)), "^['\"]|['\"]$", "")


def comparable(value: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(_text(value))), f"{WS}+", " ")


def token(value: Column) -> Column:
    """A font's name without quotes and subset prefix, underscores and runs of space one space."""
    raw = unquoted(value)
    return trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^[^+]*\+", ""), "_+", " "), f"{WS}+", " "))


def export_token(value: Column) -> Column:
    """Letters and digits of the name behind its subset prefix."""
    return F.regexp_replace(F.lower(F.regexp_replace(trimmed(_text(value)), r"(?s)^[^+]*\+", "")), "[^a-z0-9]+", "")


def lookup_token(value: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(_text(value), "^['\"]|['\"]$", "")))


def is_generic(value: Column) -> Column:
    return F.lower(_text(value)).isin(*GENERIC)


def quoted(value: Column) -> Column:
    clean = trimmed(_text(value))
    return F.when(clean == "", "").when(clean.rlike("(?i)^[a-z0-9-]+$"), clean).otherwise(F.concat(F.lit("'"), F.replace(clean, F.lit("'"), F.lit("\\'")), F.lit("'")))


def renderable(value: Column) -> Column:
    clean = trimmed(_text(value))
    letters, digits = F.length(F.regexp_replace(clean, "(?i)[^a-z]", "")), F.length(F.regexp_replace(clean, "[^0-9]", ""))
    cryptic = clean.rlike("(?i)^[a-z0-9_-]+$") & ~clean.rlike("(?i)[aeiou]") & (letters < 8)
    return (clean != "") & ~is_generic(clean) & (letters >= 4) & (digits <= letters) & ~cryptic


def is_alias(value: Column) -> Column:
    return trimmed(_text(value)).rlike("(?i)^(g_[a-z0-9_]+|f[0-9]+|tt[0-9]+)$")


def canonical_stack(value: Column) -> Column:
    low = F.lower(_text(value))
    out = F.when(low == "", "")
    for marks, stack in STACKS:
        out = out.when(_any(low, marks), stack)
    return out.otherwise("")


def mapped_family(family: Column, name: Column) -> Column:
    """The stack a font is shown with: its alias, a canonical stack, a generic one, its own name, or sans."""
    values = {"family": token(family), "name": token(name), "raw_family": unquoted(family), "raw_name": unquoted(name), "generic": F.lower(trimmed(_text(family)))}

    def choose(t: Column) -> Column:
        every = F.concat_ws(" ", *[t[k] for k in ("family", "name", "raw_family", "raw_name")])
        out = F
        for k in ("raw_family", "raw_name", "family", "name"):
            out = out.when(is_alias(t[k]), F.concat(quoted(t[k]), F.lit(f", {SANS}")))
        low = F.lower(every)
        for marks, stack in STACKS:
            out = out.when(_any(low, marks), stack)
        out = out.when(t["generic"] == "serif", "'Times New Roman', Georgia, serif").when(t["generic"] == "sans-serif", SANS).when(t["generic"] == "monospace", "'Courier New', Consolas, monospace")
        for k in ("family", "raw_family", "name", "raw_name"):
            out = out.when((t[k] != "") & ~is_generic(t[k]), F.concat(quoted(t[k]), F.lit(", Arial, sans-serif")))
        return out.otherwise(SANS)

    return let(values, choose)


def families(value: Column) -> Column:
    """The families of a list, split at commas outside quotes, unquoted."""
    parts = F.regexp_extract_all(_text(value), F.lit("((?:'[^']*'|\"[^\"]*\"|[^,'\"])+)"), F.lit(1))
    return F.filter(F.transform(parts, unquoted), lambda x: x != "")


def primary_family(value: Column) -> Column:
    return F.coalesce(F.get(F.filter(families(value), lambda x: ~is_generic(x)), 0), F.lit(""))


def embeddable_url(src: Column) -> Column:
    urls = F.transform(F.regexp_extract_all(_text(src), F.lit(r"(?i)url\(([^)]+)\)"), F.lit(1)), unquoted)
    return F.coalesce(F.get(F.filter(urls, lambda u: u.rlike("^(data:|blob:|http://|https://)")), 0), F.lit(""))


def weight(value: Column) -> Column:
    low = F.lower(trimmed(_text(value)))
    whole = leading_int(low)
    return F.when(whole.isNotNull(), clamp(whole.cast("double"), 100.0, 900.0)).when(F.contains(low, F.lit("bold")), 700.0).otherwise(400.0).cast("int")


def _serif(low: Column, compat: bool) -> Column:
    return F.contains(low, F.lit("serif")) if compat else F.replace(low, F.lit("sans-serif"), F.lit("")).rlike(r"\bserif\b")


def _slanted(style: Column) -> Column:
    low = F.lower(_text(style))
    return F.contains(low, F.lit("italic")) | F.contains(low, F.lit("oblique"))


def standard_font(family: Column, weight_: Column, style: Column, compat: bool = False) -> Column:
    """name, label and whether the family was not known, of the page's standard fonts."""
    low = F.lower(_text(family))
    bold, slanted = weight(weight_) >= 600, _slanted(style)
    times, courier = _any(low, TIMES) | _serif(low, compat), _any(low, COURIER)
    key = F.when(times, "Times").when(courier, "Courier").otherwise("Helvetica")
    lean = F.when(key == "Times", "Italic").otherwise("Oblique")
    face = F.when(bold & slanted, F.concat(F.lit("Bold "), lean)).when(bold, "Bold").when(slanted, lean).when(key == "Times", "Roman").otherwise("")
    label = F.rtrim(F.concat_ws(" ", key, face))
    return F.struct(F.replace(label, F.lit(" "), F.lit("")).alias("name"), label.alias("label"), (~(times | courier | _any(low, HELVETICA))).alias("fallback"))


def export_font(family: Column, weight_: Column, style: Column, compat: bool = False) -> Column:
    """Base-14 name by the export's rules."""
    low, w = F.lower(_text(family)), F.lower(_text(weight_))
    bold = F.contains(w, F.lit("bold")) | (w.rlike("^[0-9]+$") & (w.try_cast("bigint") >= 600))
    slanted = _slanted(style)
    times, courier = _any(low, EXPORT_TIMES) | _serif(low, compat), _any(low, EXPORT_COURIER)
    key = F.when(times, "Times").when(courier, "Courier").otherwise("Helvetica")
    lean = F.when(key == "Times", "Italic").otherwise("Oblique")
    face = F.when(bold & slanted, F.concat(F.lit("Bold"), lean)).when(bold, "Bold").when(slanted, lean).when(key == "Times", "Roman")
    return F.concat_ws("-", key, face)


def traits(family: Column, name: Column, weight_: Column) -> Column:
    """family, weight and style a scanned run is shown with."""
    both = F.lower(F.concat_ws(" ", _text(family), _text(name)))
    told = F.lower(_text(weight_))
    whole = leading_int(told)
    bold = F.contains(both, F.lit("bold")) | (told == "bold") | F.coalesce(whole >= 600, F.lit(False))
    heavy = F.when(whole.isNotNull(), F.greatest(F.lit(100), F.least(F.lit(900), whole)).cast("string")).otherwise("700")
    plain = F.when(whole.between(100, 900), whole.cast("string")).otherwise("400")
    style = F.when(F.contains(both, F.lit("italic")) | F.contains(both, F.lit("oblique")), "italic").otherwise("normal")
    return F.struct(mapped_family(family, name).alias("family"), F.when(bold, heavy).otherwise(plain).alias("weight"), style.alias("style"))


def with_face(rows: DataFrame, family: Column, faces: DataFrame) -> DataFrame:
    """``rows`` with the first non-generic family and, where a table of faces (token, url) has it, its url."""
    keyed = rows.withColumn("primary", primary_family(family)).withColumn("__token", lookup_token(F.col("primary")))
    return keyed.join(faces.withColumnRenamed("token", "__token"), "__token", "left").drop("__token")
