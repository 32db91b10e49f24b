"""Coercion rules of the data model: what counts as missing, how numbers are rounded and clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space characters of the model's text rules.
WHITE = "\t\n\x0b\x0c\r \u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits are told apart from white space by two ranges, before the list is gone through.
WS = f"[\\x00-\\x20\u00a0-\uffff&&[{WHITE}]]"
BLANKS = WHITE.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(value, least, most) -> Column:
    """Between least and most; where most < least, least wins. NaN stays NaN."""
    value = lit(value)
    return F.when(F.isnan(value), value).otherwise(F.greatest(lit(least), F.least(lit(most), value)))


def clamp_finite(value, least, most) -> Column:
    """As clamp, but what isn't finite becomes least, and where most < least, most wins."""
    value, inf = lit(value), F.lit(float("inf"))
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == inf)
    return F.when(odd, lit(least)).otherwise(F.least(lit(most), F.greatest(lit(least), value)))


def half_up(value) -> Column:
    """Rounded to a whole number, halves up, as a double."""
    return F.floor(lit(value) + 0.5).cast("double")


def number_or(value, default) -> Column:
    """``value`` unless it is null, NaN or 0. The value stands in the tree once."""
    return F.coalesce(F.nullif(F.nanvl(lit(value).cast("double"), F.lit(0.0)), F.lit(0.0)), lit(default))


def within(value, least, most) -> Column:
    """As clamp for a value that is never NaN: it stands in the tree once."""
    return F.greatest(lit(least), F.least(lit(most), lit(value)))


def text_or(value, *defaults) -> Column:
    """The first of the texts that is neither null nor empty; else the last."""
    found = [F.nullif(lit(v), F.lit("")) for v in (value, *defaults[:-1])]
    return F.coalesce(*found, lit(defaults[-1]))


def leading_int(value) -> Column:
    """The whole number at the start of a text, or null."""
    return F.expr("bigint(null)") if value is None else F.nullif(F.regexp_extract(value, rf"^{WS}*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def trimmed(value) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of ``values``, each worked out once."""
    parts = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.transform(F.array(F.named_struct(*parts)), body)[0]


def layer(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are worked out here, once.

    They come out of a generator of one row, which neither projections nor filters are moved through: a filter on
    them isn't copied, with all they are made of, further down, and each layer is a method of its own, small
    enough for the JVM to compile.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
