"""Registered queries of the layout engine, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from . import colours, document, edits, pages, text

    return {**text.QUERIES, **edits.QUERIES, **colours.QUERIES, **document.QUERIES, **pages.QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import colours, document, edits, pages, text

    return {**text.SQL, **edits.SQL, **colours.SQL, **document.SQL, **pages.SQL}
