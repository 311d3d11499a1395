"""Statistics count the values of the columns that show them; rows of text are rendered at once."""

from pyspark.sql import functions as F

from gridlake.operators import stats
from gridlake.operators.types import infer_types, typed_cells
from gridlake.sources.render import escape_html, html_row, html_row_of


def test_values_are_counted_for_the_columns_that_show_them(spark, make_grid, monkeypatch):
    grid = make_grid({1: [["k", "v"], ["a", "1"], ["b", "2"], ["a", "2"]]})
    seen = []
    modes = stats.value_modes
    monkeypatch.setattr(stats, "value_modes", lambda cells, by, *more: seen.append(cells) or modes(cells, by, *more))
    panel = stats.stats_panel(typed_cells(grid, infer_types(grid)), {0: "unique", 1: "max"})
    assert {(r.header, r.stat, r.num_value) for r in panel.collect()} == {("k", "unique", 2.0), ("v", "max", 2.0)}
    assert {r.col_idx for r in seen[0].select("col_idx").distinct().collect()} == {0}


def test_rows_are_rendered_the_same_at_once_and_by_cell(spark):
    rows = [["a", "b"], ["a", None], [None, None], [None, ""], ["", ""], [], ["<x>", "y & z"], None]
    df = spark.createDataFrame([(r,) for r in rows], "cells array<string>")
    cell = F.transform("cells", lambda c: F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>")))
    by_cell = F.concat(F.lit("<tr>"), F.array_join(cell, ""), F.lit("</tr>"))
    assert all(r[0] == r[1] for r in df.select(html_row(F.col("cells")), by_cell).collect())
    two = df.where(F.size("cells") == 2).select(html_row_of(F.get("cells", F.lit(0)), F.get("cells", F.lit(1))), by_cell)
    assert two.count() == 6 and all(r[0] == r[1] for r in two.collect())


def test_values_are_counted_for_the_views_that_show_them(spark, monkeypatch):
    """The stat is a column of its own, as in saved views."""
    cells = spark.createDataFrame(
        [("v1", 0, 1, "h", "max", "numeric", "7", 7.0), ("v2", 0, 1, "h", "mode", "numeric", "7", 7.0), ("v3", 0, 1, "h", None, "numeric", "7", 7.0)],
        "view_id string, col_idx int, row_idx long, header string, chosen_stat string, type string, value string, num double",
    ).withColumn("dt", F.lit(None).cast("date"))
    seen = []
    modes = stats.value_modes
    monkeypatch.setattr(stats, "value_modes", lambda cells, by, *more: seen.append(cells) or modes(cells, by, *more))
    found = stats.column_stats(cells, by=["view_id", "col_idx", "chosen_stat"], chosen=F.col("chosen_stat"))
    assert {(r.view_id, r.stat, r.num_value, r.text_value) for r in found.collect()} == {("v1", "max", 7.0, None), ("v2", "mode", None, "7")}
    assert [r.view_id for r in seen[0].collect()] == ["v2"]
