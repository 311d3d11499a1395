"""Text exports and the multi-table export manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import site_name
from ..plans.staging import stage
from .grid import KEY, attach, join_null_safe, rank_within

# Name limits of the export format.
SOURCE_CHARS, SHEET_CHARS = 20, 31
#: order of table kinds in a page's list
KIND_ORDER = ["html", "csv", "markdown"]


def delimited_line(cells: Column, separator: str) -> Column:
    """Quote a cell only when it holds the separator, a quote or a newline."""

    def cell(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.contains(separator) | text.contains('"') | text.contains("\n"), quoted).otherwise(text)

    return F.array_join(F.transform(cells, cell), separator)


def markdown_line(cells: Column) -> Column:
    def cell(c: Column) -> Column:
        text = F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
        return F.regexp_replace(text, r"\r?\n", " ")

    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def line_of(cells: Column, fmt: str) -> Column:
    if fmt == "csv":
        return delimited_line(cells, ",")
    if fmt == "tsv":
        return delimited_line(cells, "\t")
    if fmt == "md":
        return markdown_line(cells)
    raise ValueError("fmt must be csv, tsv or md")


def rule_of(cells: Column) -> Column:
    return F.concat(
        F.lit("| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |")
    )


def export_lines(grid: DataFrame, fmt: str) -> DataFrame:
    """``KEY, line_no, line``; the header is line 0 and Markdown adds its rule as line 1."""
    line = line_of(F.col("cells"), fmt)
    row = F.col("row_idx").cast("bigint")
    if fmt != "md":
        return grid.select(*KEY, row.alias("line_no"), line.alias("line"))
    body = F.array(F.struct((row + 1).alias("line_no"), line.alias("line")))
    head = F.array(
        F.struct(row.alias("line_no"), line.alias("line")),
        F.struct((row + 1).alias("line_no"), rule_of(F.col("cells")).alias("line")),
    )
    return grid.select(*KEY, F.inline(F.when(row == 0, head).otherwise(body)))


def wide_lines(df: DataFrame, columns: list[str], fmt: str, row: str = "row_idx") -> DataFrame:
    """``line_no, line`` of a wide table's body rows, numbered by ``row`` (1-based)."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    shift = 1 if fmt == "md" else 0
    return df.select((F.col(row).cast("bigint") + shift).alias("line_no"), line_of(cells, fmt).alias("line"))


def write_lines(lines: DataFrame, path: str, folders: bool = True) -> None:
    """Write export lines so that each table's lines stay in order.

    ``folders`` makes one text folder per table, whose files read in name order give the
    table; that suits thousands of tables.  Without it the lines go to one Parquet table
    sorted by (table, line), which suits any number.  Both are range-partitioned, so a
    huge table is written by many tasks.
    """
    order = [*KEY, "line_no"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    if folders:
        placed.select(*KEY, "line").write.partitionBy(*KEY).text(path)
    else:
        placed.write.parquet(path)


def list_positions(tables: DataFrame) -> DataFrame:
    """1-based place of each table in its page's list: ranked html, then text blocks."""
    kind = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")), F.lit(0)),
        F.lit(len(KIND_ORDER) + 1),
    )
    group = F.when(F.col("kind") == "html", F.lit(0)).otherwise(F.lit(1))
    return rank_within(tables, ["page_id"], [group, F.col("rank"), kind, F.col("kind")], "position")


def export_manifest(
    tables: DataFrame, export_date: str, url: str = "url", source: str | None = None
) -> DataFrame:
    """Sheet name of every table with data, and the export's file name.

    ``tables`` carries ``position``.  A name holds the position, so two tables of one
    export can only collide once the position has ten digits and the name is cut; only
    such cut names go through the numbering window.
    """
    n = F.col("position").cast("string")
    base = F.concat(F.lit("Table_"), n)
    if source:
        clean = F.substring(F.translate(F.col(source), "\\/*?:[]", ""), 1, SOURCE_CHARS)
        base = F.when(F.coalesce(clean, F.lit("")) != "", F.concat(clean, F.lit("_"), n)).otherwise(base)
    named = tables.where(F.col("n_rows") > 0).withColumn("_name", base)
    short = named.where(F.length("_name") <= SHEET_CHARS).withColumn("sheet_name", F.col("_name"))
    same = Window.partitionBy("page_id", F.substring("_name", 1, SHEET_CHARS)).orderBy("position")
    k = (F.row_number().over(same) - 1).cast("string")
    suffix = F.when(k == "0", F.lit("")).otherwise(F.concat(F.lit("_"), k))
    cut = named.where(F.length("_name") > SHEET_CHARS).withColumn("_k", suffix)
    cut = cut.withColumn(
        "sheet_name",
        F.concat(F.substring(F.col("_name"), F.lit(1), SHEET_CHARS - F.length("_k")), F.col("_k")),
    ).drop("_k")
    return short.unionByName(cut).select(
        *KEY,
        "position",
        "sheet_name",
        F.concat(site_name(url), F.lit(f"_all_tables_{export_date}")).alias("export_name"),
    )


def export_all(
    grid: DataFrame,
    tables: DataFrame,
    path: str,
    export_date: str,
    fmt: str = "csv",
    source: str | None = None,
    folders: bool = True,
) -> DataFrame:
    """Write every table's lines and the manifest under ``path``; refuse an empty export.

    ``folders`` gives each table a folder of text; otherwise all share one sorted Parquet table,
    the better choice for very many tables.
    """
    manifest = stage(export_manifest(tables, export_date, source=source), "manifest")
    if manifest.isEmpty():
        raise ValueError("no valid table data to export")
    sizes = tables.select(*KEY, (F.col("n_rows") - 1).alias("last_row"))
    facts = join_null_safe(manifest.select(*KEY), sizes, KEY)
    write_lines(export_lines(attach(grid, facts), fmt), f"{path}/tables", folders)
    manifest.write.parquet(f"{path}/manifest")
    return manifest.sparkSession.read.parquet(f"{path}/manifest")
