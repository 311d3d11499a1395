"""Single-key sorting with a stable tie order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from .grid import number_rows


def sort_key(column: str, profile=None, date_order: str = "text", dayfirst: bool = True) -> Column:
    """Numeric kinds by value; everything else, dates too by default, by collated text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    if profile is not None and profile.is_numeric:
        return parse_number(text, profile.decimal or ".")
    if profile is not None and profile.type == "date" and date_order == "chronological":
        return parse_date(text, dayfirst)
    return F.collate(text, "UNICODE")


def sort_order(
    column: str | None,
    direction: str = "asc",
    profile=None,
    row: str = "row_idx",
    date_order: str = "text",
) -> list[Column]:
    """Ordering columns; ``none`` and ties fall back to the original row order."""
    if direction not in ("asc", "desc", "none"):
        raise ValueError("direction must be asc, desc or none")
    if column is None or direction == "none":
        return [F.col(row)]
    key = sort_key(column, profile, date_order)
    return [key.desc() if direction == "desc" else key.asc(), F.col(row)]


def sort_rows(df: DataFrame, column: str, direction: str = "asc", profile=None, row: str = "row_idx", date_order: str = "text") -> DataFrame:
    return df.orderBy(*sort_order(column, direction, profile, row, date_order))


def positions(df: DataFrame, column: str, direction: str = "asc", profile=None, row: str = "row_idx", date_order: str = "text") -> DataFrame:
    """The sorted rows with their 1-based position in ``pos``."""
    return number_rows(df, sort_order(column, direction, profile, row, date_order))
