"""Text rules: commits, templates, file stems, XML, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..coerce import BLANKS, WHITE, WS, trimmed


def commit(text: Column) -> Column:
    """An edit as it is stored: no carriage returns, line breaks with the white space about them one space."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(""))
    return F.when(F.contains(plain, F.lit("\n")), F.regexp_replace(plain, f"{WS}*\n{WS}*", " ")).otherwise(plain)


def one_line(text: Column) -> Column:
    """As the export draws it: carriage returns dropped, each line feed a space."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))


def item(text: Column) -> Column:
    """A scanned run: no-break spaces are spaces, trailing white space goes."""
    return F.rtrim(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")), F.lit(BLANKS))


def visible(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[^{WHITE}]")


def fill_template(template: Column, values: Column, keep_unknown: bool = True) -> Column:
    """{name} by values[name]; names without a value stay, or go."""
    filled = F.aggregate(F.map_entries(values), F.coalesce(template, F.lit("")), lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return filled if keep_unknown else F.regexp_replace(filled, r"\{[^}]+\}", "")


def stem(name: Column, default: str, suffix: str = r"\.[^.]+$") -> Column:
    """A file's name without its ending; ``default`` where nothing is left."""
    return F.coalesce(F.nullif(trimmed(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)), suffix, "")), F.lit("")), F.lit(default))


def escape_xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def icon_label(text: Column) -> Column:
    """The first word, and what follows."""
    clean = trimmed(F.coalesce(text, F.lit("")))
    form = rf"^([^{WHITE}]+){WS}*(.*)$"
    return F.struct(F.regexp_extract(clean, form, 1).alias("icon"), trimmed(F.regexp_extract(clean, form, 2)).alias("label"))


def one_line_base64(content: Column) -> Column:
    return F.translate(F.base64(content), "\r\n", "")
