"""Parsed values stored beside the catalogue, so that range filters reach the scan.

A predicate on a *parsed* number or date cannot be pushed into a file of texts.  The sidecar holds one row per
typed cell, sorted by column and value within its files, so a range reads the row groups that can hold it and
gives the keys of the rows that pass.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import is_numeric_kind
from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from .filters import date_range, is_active, numeric_range, predicate
from .grid import KEY, join_null_safe
from .types import attach_profile

#: bytes of a row group: small, so that a range skips most of them
ROW_GROUP = 4 << 20


def write_sidecar(grid: DataFrame, profile: DataFrame, path: str, dayfirst: bool = True, row_group: int = ROW_GROUP) -> None:
    """Store ``KEY, row_idx, col_idx, type, num, dt`` of every body cell of a numeric or date column.

    A cell that a short row lacks counts as blank: 0 for numbers, no date.
    """
    c = F.col("c")
    value = F.get("cells", c["col_idx"])
    number = F.when(is_numeric_kind(c["type"]), parse_number(value, F.coalesce(c["decimal"], F.lit("."))))
    day = F.when(c["type"] == "date", parse_date(value, dayfirst))
    typed = F.filter("cols", lambda x: is_numeric_kind(x["type"]) | (x["type"] == "date"))
    cells = attach_profile(grid, profile).select(*KEY, "row_idx", "cells", F.explode(typed).alias("c"))
    cells = cells.select(*KEY, "row_idx", c["col_idx"].alias("col_idx"), c["type"].alias("type"), number.alias("num"), day.alias("dt"))
    order = ["col_idx", "num", "dt", *KEY, "row_idx"]
    placed = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.option("parquet.block.size", row_group).parquet(path)


def _test(spec: dict) -> Column:
    if spec["type"] == "numeric":
        return numeric_range(F.col("num"), spec.get("min"), spec.get("max"))
    return F.col("dt").isNull() | date_range(F.col("dt"), spec.get("from"), spec.get("to"))


def passing_rows(spark: SparkSession, path: str, index: int, spec: dict) -> DataFrame:
    """``KEY, row_idx`` of the rows whose value in column ``index`` passes a numeric or date filter."""
    stored = spark.read.parquet(path)
    kind = is_numeric_kind(F.col("type")) if spec["type"] == "numeric" else F.col("type") == "date"
    return stored.where((F.col("col_idx") == index) & kind & _test(spec)).select(*KEY, "row_idx")


def filter_with_sidecar(grid: DataFrame, path: str, filters: dict[int, dict]) -> DataFrame:
    """Like ``filter_grid`` for columns that are typed as their filter says; header rows stay.

    Ranges come from the sidecar at ``path``, memberships and texts are tested on the rows that are left.
    Tables whose column has another type keep their header only, where a range is asked for.
    """
    active = {i: s for i, s in filters.items() if is_active(s)}
    ranges = {i: s for i, s in active.items() if s["type"] in ("numeric", "date")}
    tests = [predicate(F.get("cells", F.lit(i)), s) for i, s in active.items() if i not in ranges]
    body = grid.where((F.col("row_idx") > 0) & reduce(and_, tests, F.lit(True)))
    for i, spec in ranges.items():
        body = join_null_safe(body, passing_rows(grid.sparkSession, path, i, spec), [*KEY, "row_idx"], "left_semi")
    return grid.where(F.col("row_idx") == 0).unionByName(body)
