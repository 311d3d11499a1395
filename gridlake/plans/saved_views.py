"""Saved views as data: many views applied to many tables in one plan.

A saved view is a row: an id and its state as JSON (see ``plans.view.ViewSpec``).  Its filters, sort key and stat
choices become rows of their own.  Views meet the tables whose fingerprint they were saved with; predicates meet
the cells of their column by a join, and a row stays if as many predicates are met as the view has.
Nothing about a view is a literal in the plan, so the plan is the same for one view and for a million.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import is_numeric_kind
from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import js_trim
from ..operators.catalogue import table_marks
from ..operators.grid import KEY, attach, dense_grid, join_null_safe, rank_within
from ..operators.stats import column_stats
from .staging import stage

_STATE = (
    "struct<columns: array<string>, types: map<string, string>, formats: map<string, struct<thousand: string, decimal: string>>, "
    "filters: map<string, struct<type: string, `min`: string, `max`: string, `from`: string, `to`: string, selected: array<string>, "
    "text: string>>, sort: struct<`column`: string, direction: string>, stats: map<string, string>, fingerprint: string>"
)
#: a typed-in bound: its leading number
_NUMBER = r"^[\s]*([+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))"


@dataclass
class SavedViews:
    """Views as tables: ``views`` (view_id, fingerprint, column and direction of the sort), and by view and column ``predicates``,
    ``columns`` (type, decimal) and ``choices`` (stat)."""

    views: DataFrame
    predicates: DataFrame
    columns: DataFrame
    choices: DataFrame


def _type(name: Column) -> Column:
    return F.when(name == "percentage", F.lit("rate")).otherwise(name)


def read_saved_views(saved: DataFrame, view_id: str = "view_id", state: str = "state") -> SavedViews:
    """Take states apart.  Filters that say nothing are dropped, as in ``ViewSpec.to_json``; a state that is no JSON has no fingerprint."""
    parsed = saved.select(F.col(view_id).alias("view_id"), F.from_json(F.col(state), _STATE).alias("s"))
    views = parsed.select("view_id", F.col("s.fingerprint").alias("fingerprint"), F.col("s.sort.column").alias("sort_column"), F.col("s.sort.direction").alias("direction"))
    each = parsed.select("view_id", F.explode("s.filters").alias("header", "f"))
    number = {n: F.regexp_extract(F.col(f"f.{n}"), _NUMBER, 1).try_cast("double") for n in ("min", "max")}
    day = {n: F.substring(F.trim(F.col(f"f.{n}")), 1, 10).try_cast("date") for n in ("from", "to")}
    text = js_trim(F.col("f.text"))
    predicates = each.select(
        "view_id",
        "header",
        F.col("f.type").alias("test"),
        *(c.alias(f"low_{i}") for i, c in enumerate((number["min"], day["from"]))),
        *(c.alias(f"high_{i}") for i, c in enumerate((number["max"], day["to"]))),
        F.when(F.size("f.selected") > 0, F.col("f.selected")).alias("selected"),
        F.lower(F.nullif(text, F.lit(""))).alias("text"),
    )
    says = (
        F.when(F.col("test") == "numeric", F.col("low_0").isNotNull() | F.col("high_0").isNotNull())
        .when(F.col("test") == "date", F.col("low_1").isNotNull() | F.col("high_1").isNotNull())
        .when(F.col("test") == "categorical", F.col("selected").isNotNull() | F.col("text").isNotNull())
    )
    types = parsed.select("view_id", F.explode("s.types").alias("header", "type"), "s.formats")
    columns = types.select(
        "view_id", "header", _type(F.col("type")).alias("type"), F.coalesce(F.try_element_at("formats", "header")["decimal"], F.lit(".")).alias("decimal")
    )
    choices = parsed.select("view_id", F.explode("s.stats").alias("header", "stat"))
    return SavedViews(views, predicates.where(says), columns, choices)


def apply_saved_views(grid: DataFrame, saved: DataFrame, view_id: str = "view_id", state: str = "state") -> AppliedViews:
    """Every saved view over every table whose fingerprint it holds."""
    return AppliedViews(grid, read_saved_views(saved, view_id, state))


def matched_views(grid: DataFrame, views: DataFrame) -> DataFrame:
    """``view_id, KEY`` and the sort of every view and table with one fingerprint, with ``last_row`` and the header rows of the table."""
    marks = table_marks(grid).where(F.col("fingerprint") != "")
    return views.join(marks, "fingerprint").drop("fingerprint")


def predicate_met(value: Column, said: Column) -> Column:
    """Whether a cell meets a predicate, given as a struct: the rules of ``operators.filters.predicate``, on columns."""
    number, day = parse_number(value, said["decimal"]), parse_date(value)
    trimmed = F.coalesce(js_trim(value), F.lit(""))

    def inside(x: Column, i: int) -> Column:
        low, high = said[f"low_{i}"], said[f"high_{i}"]
        return (low.isNull() | (x >= low)) & (high.isNull() | (x <= high))

    chosen = said["selected"].isNull() | F.array_contains(said["selected"], trimmed)
    contained = said["text"].isNull() | F.lower(trimmed).contains(said["text"])
    return (
        F.when(said["test"] == "numeric", inside(number, 0))
        .when(said["test"] == "date", F.coalesce(inside(day, 1), F.lit(True)))
        .otherwise(chosen & contained)
    )


def all_met(cells: Column, predicates: Column) -> Column:
    """Whether a row meets every predicate of a list; one on a column that is not there is never met."""
    return F.forall(predicates, lambda p: p["col_idx"].isNotNull() & predicate_met(F.get(cells, p["col_idx"]), p))


class AppliedViews:
    """Saved views over the tables they fit; every result is one plan over all of them.

    What a view asks of a table is one fact row, lists of predicates and choices as long as its state, so that the rows of
    the tables meet their views in one join and are judged where they lie.
    """

    def __init__(self, grid: DataFrame, saved: SavedViews):
        self.grid, self.saved = dense_grid(grid), saved
        self.matched = stage(matched_views(self.grid, saved.views), "matched-views")

    def _placed(self, facts: DataFrame, name: str = "header") -> DataFrame:
        """Facts by view and column name, for every table their view fits: with ``col_idx``, null where there is none."""
        tables = self.matched.select("view_id", *KEY, "last_row", "headers").join(facts.withColumnRenamed(name, "header"), "view_id")
        # a column is named by its header; the first of equal names is meant
        at = F.transform("headers", lambda cells: F.nullif(F.array_position(F.transform(cells, lambda c: F.coalesce(js_trim(c), F.lit(""))), F.col("header")), F.lit(0)))
        return tables.withColumn("col_idx", (F.array_min(at) - 1).cast("int")).drop("headers")

    def _listed(self, facts: DataFrame, name: str) -> DataFrame:
        """Placed facts as one list by view and table."""
        own = [c for c in facts.columns if c not in ("view_id", *KEY, "last_row")]
        return facts.groupBy("view_id", *KEY, "last_row").agg(F.collect_list(F.struct(*own)).alias(name))

    def _cells(self, facts: DataFrame) -> DataFrame:
        """Body rows of the tables with the value of each fact's column; a huge table is split by buckets."""
        return self._body(facts).withColumn("value", F.get("cells", F.col("col_idx"))).drop("cells")

    def _body(self, facts: DataFrame) -> DataFrame:
        rows = self.grid.where(F.col("row_idx") > 0).select(*KEY, "row_idx", "cells")
        return attach(rows, facts)

    def _formats(self, facts: DataFrame) -> DataFrame:
        return facts.join(self.saved.columns, ["view_id", "header"], "left").withColumn("decimal", F.coalesce("decimal", F.lit(".")))

    def _predicates(self) -> DataFrame:
        """``view_id, KEY, last_row, predicates`` of the views that filter."""
        wanted = self._placed(self._formats(self.saved.predicates))
        return self._listed(wanted.drop("header", "type"), "predicates")

    def rows(self) -> DataFrame:
        """``view_id, KEY, row_idx``: body rows that meet all predicates of a view."""
        wanted = self._predicates()
        free = join_null_safe(self.matched.select("view_id", *KEY, "last_row"), wanted, ["view_id", *KEY], "left_anti")
        asked = wanted.unionByName(free.withColumn("predicates", F.array().cast(wanted.schema["predicates"].dataType)))
        return self._body(asked).where(all_met(F.col("cells"), F.col("predicates"))).select("view_id", *KEY, "row_idx")

    def positioned(self) -> DataFrame:
        """The rows of every view with their 1-based place ``pos`` in its order; ties keep the order of the table.

        Numeric kinds sort by value, everything else by collated text, as in ``operators.sorting``.
        """
        kept = stage(self.rows(), "view-rows")
        sorts = self.matched.where(F.col("direction").isin("asc", "desc")).select("view_id", "direction", F.col("sort_column").alias("header")).distinct()
        sorts = self._placed(self._formats(sorts))
        keyed = self._cells(sorts)
        number = F.when(is_numeric_kind(F.col("type")), parse_number("value", F.col("decimal")))
        sign = F.when(F.col("direction") == "desc", F.lit(-1.0)).otherwise(F.lit(1.0))
        text = F.when(F.coalesce(~is_numeric_kind(F.col("type")), F.lit(True)), F.coalesce("value", F.lit("")))
        keyed = keyed.select(
            "view_id",
            *KEY,
            "row_idx",
            (number * sign).alias("_number"),
            F.when(F.col("direction") == "asc", text).alias("_up"),
            F.when(F.col("direction") == "desc", text).alias("_down"),
        )
        rows = join_null_safe(kept, keyed, ["view_id", *KEY, "row_idx"], "left")
        order = [F.col("_number").asc(), F.collate("_up", "UNICODE").asc(), F.collate("_down", "UNICODE").desc(), F.col("row_idx")]
        ranked = rank_within(rows, ["view_id", *KEY], order, "pos")
        return ranked.select("view_id", *KEY, "row_idx", "pos")

    def stats(self) -> DataFrame:
        """The chosen stats of every view over the rows it keeps, by view, table and column."""
        chosen = self._placed(self._formats(self.saved.choices)).where(F.col("col_idx").isNotNull())
        by = ["view_id", *KEY, "col_idx"]
        asked = self._listed(chosen, "choices")
        asked = join_null_safe(asked, self._predicates().drop("last_row"), ["view_id", *KEY], "left")
        kept = self._body(asked).where(F.col("predicates").isNull() | all_met(F.col("cells"), F.col("predicates")))
        cells = kept.select("view_id", *KEY, "row_idx", "cells", F.inline("choices")).withColumn("value", F.get("cells", F.col("col_idx")))
        type_ = F.coalesce("type", F.lit("categorical"))
        typed = cells.select(
            *by, "row_idx", "header", F.col("stat").alias("chosen_stat"), type_.alias("type"), "value",
            F.when(is_numeric_kind(type_), parse_number("value", F.col("decimal"))).alias("num"),
            F.when(type_ == "date", parse_date("value")).alias("dt"),
        )
        return column_stats(typed, by=[*by, "chosen_stat"], chosen=F.col("chosen_stat")).drop("chosen_stat")
