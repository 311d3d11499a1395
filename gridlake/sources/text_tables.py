"""Comma-separated and Markdown tables inside free text, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, js_trim, let

_ESC = "\x01"  # guards commas inside quotes; real occurrences are escaped first


def text_lines(text: Column | str) -> Column:
    return F.split(js_trim(col(text)), "\n")


def _commas(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, ",", ""))


def _csv_counts(counts: Column) -> Column:
    return let(
        F.struct(F.get(counts, F.lit(0)).alias("first"), counts.alias("all")),
        lambda c: (F.size(c["all"]) >= 2)
        & (c["first"] > 0)
        & (
            F.size(F.filter(c["all"], lambda n: F.abs(n - c["first"]) <= 1))
            >= F.size(c["all"]) * F.lit(0.7)
        ),
    )


def looks_like_csv(text: Column | str) -> Column:
    """Two lines or more, commas in the first, and 70 % of lines within one comma of it.

    Every intermediate is bound once: an expression used inside a lambda would be
    worked out again for each line.
    """
    several = col(text).contains(",") & col(text).contains("\n")
    counts = F.transform(text_lines(text), _commas)
    return F.coalesce(several & let(counts, _csv_counts), F.lit(False))


def looks_like_markdown(text: Column | str) -> Column:
    """A line with two pipes, plus a ``---`` line with a pipe or three lines in all."""

    def test(lines: Column) -> Column:
        row = F.exists(lines, lambda x: x.rlike(r"\|[^|]*\|"))
        rule = F.exists(lines, lambda x: x.contains("---") & x.contains("|"))
        return (F.size(lines) >= 2) & row & ((F.size(lines) >= 3) | rule)

    several = col(text).contains("|") & col(text).contains("\n")
    return F.coalesce(several & let(text_lines(text), test), F.lit(False))


def _split_quoted(line: Column) -> Column:
    safe = F.replace(line, F.lit(_ESC), F.lit(_ESC + "a"))
    parts = F.transform(
        F.split(safe, '"'),
        lambda part, i: F.when(i % 2 == 1, F.replace(part, F.lit(","), F.lit(_ESC + "b"))).otherwise(part),
    )
    return F.transform(
        F.split(F.array_join(parts, ""), ","),
        lambda cell: F.replace(
            F.replace(cell, F.lit(_ESC + "b"), F.lit(",")), F.lit(_ESC + "a"), F.lit(_ESC)
        ),
    )


def csv_rows(text: Column | str) -> Column:
    """ARRAY<ARRAY<STRING>>: quotes toggle and vanish, a newline always ends the row."""

    def row(line: Column) -> Column:
        cells = F.when(line.contains('"'), _split_quoted(line)).otherwise(F.split(line, ","))
        return F.transform(cells, js_trim)

    return F.transform(text_lines(text), row)


def markdown_rows(text: Column | str) -> Column:
    """ARRAY<ARRAY<STRING>>: separator lines, blank cells and empty lines are dropped."""
    kept = F.filter(text_lines(text), lambda line: ~line.contains("---"))
    rows = F.transform(
        kept, lambda line: F.filter(F.transform(F.split(line, r"\|"), js_trim), lambda c: c != "")
    )
    return F.filter(rows, lambda r: F.size(r) > 0)


def extract_block_tables(
    blocks: DataFrame, text: str = "text", key: str = "page_id", index: str = "block_idx"
) -> DataFrame:
    """Block mode: a block may yield a csv table and a markdown table as well, in one scan."""
    extra = ["attrs"] if "attrs" in blocks.columns else []
    value = F.col(text)
    found = F.array(
        F.struct(
            F.lit("csv").alias("kind"),
            F.when(looks_like_csv(value), csv_rows(value)).alias("rows"),
        ),
        F.struct(
            F.lit("markdown").alias("kind"),
            F.when(looks_like_markdown(value), markdown_rows(value)).alias("rows"),
        ),
    )
    grid = (
        blocks.where(value.contains("\n") & (value.contains(",") | value.contains("|")))
        .select(
            F.col(key).alias("page_id"),
            F.col(index).cast("int").alias("table_idx"),
            *extra,
            F.inline(found),
        )
        .where(F.size("rows") > 1)
        .select("page_id", "kind", "table_idx", *extra, F.posexplode("rows").alias("row_idx", "cells"))
        .withColumn("row_idx", F.col("row_idx").cast("bigint"))
    )
    if extra:
        grid = grid.withColumn("attrs", F.when(F.col("row_idx") == 0, F.col("attrs")))
    return grid


def extract_text_tables(
    texts: DataFrame, text: str = "text", key: str = "page_id", index: Column | None = None
) -> DataFrame:
    """Free-text mode: one table per text, csv before markdown, in a single scan."""
    tagged = texts.withColumn(
        "kind",
        F.when(looks_like_csv(text), F.lit("csv-selection")).when(
            looks_like_markdown(text), F.lit("markdown-selection")
        ),
    ).where(F.col("kind").isNotNull())
    rows = F.when(F.col("kind") == "csv-selection", csv_rows(text)).otherwise(markdown_rows(text))
    return (
        tagged.select(
            F.col(key).alias("page_id"),
            "kind",
            (index if index is not None else F.lit(0)).cast("int").alias("table_idx"),
            rows.alias("rows"),
        )
        .where(F.size("rows") > 1)
        .select("page_id", "kind", "table_idx", F.posexplode("rows").alias("row_idx", "cells"))
        .withColumn("row_idx", F.col("row_idx").cast("bigint"))
    )
