"""Chart-ready series from (filtered, ordered) rows; nothing is aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_number


def _number(name: str, profile: dict | None) -> Column:
    p = (profile or {}).get(name)
    return parse_number(F.col(name).cast("string"), p.decimal if p and p.decimal else ".")


def _label(name: str, index: int) -> Column:
    return F.lit(name if name else f"Column {index + 1}")


def chart_series(
    df: DataFrame,
    x: str,
    ys: list[str],
    profile: dict | None = None,
    row: str = "row_idx",
    labels: dict[str, str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``series, row_idx, label, y`` and the ``keep`` columns: one row per input row and y column."""
    label = F.coalesce(F.col(x).cast("string"), F.lit(""))
    points = F.array(
        *[
            F.struct(
                _label((labels or {}).get(y, y), df.columns.index(y)).alias("series"),
                _number(y, profile).alias("y"),
            )
            for y in ys
        ]
    )
    return df.select(F.col(row).alias("row_idx"), *keep, label.alias("label"), F.inline(points)).select(
        "series", "row_idx", *keep, "label", "y"
    )


def scatter_points(
    df: DataFrame,
    x: str,
    ys: list[str],
    profile: dict | None = None,
    row: str = "row_idx",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``series, row_idx, x, y`` and the ``keep`` columns, both coordinates parsed as numbers."""
    points = F.array(
        *[
            F.struct(
                _label(y, df.columns.index(y)).alias("series"), _number(y, profile).alias("y")
            )
            for y in ys
        ]
    )
    return df.select(
        F.col(row).alias("row_idx"), *keep, _number(x, profile).alias("x"), F.inline(points)
    ).select("series", "row_idx", *keep, "x", "y")
