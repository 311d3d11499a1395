"""From pages to a stored catalogue: one scan of the HTML, then native operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import list_tables
from ..operators.grid import KEY, dense_grid
from ..sources.html import code_blocks, extract_all
from ..sources.text_tables import extract_block_tables
from .staging import stage


def scan_pages(pages: DataFrame) -> DataFrame:
    """One staged scan of the pages: table rows as runs, code blocks, and pages that could not be read."""
    return stage(extract_all(pages), "scan")


def tables_of(found: DataFrame, runs: bool = False) -> DataFrame:
    """Grid rows of every html, csv and markdown table of a scan; ``runs`` leaves blanks out."""
    html = found.where(F.col("kind") == "html")
    text = extract_block_tables(code_blocks(found))
    if not runs:
        html = dense_grid(html)
        return html.unionByName(text.select(*html.columns))
    text = text.select(
        *KEY, "row_idx", F.size("cells").cast("bigint").alias("width"), F.lit(None).cast("array<bigint>").alias("at"),
        F.col("cells").alias("texts"), "attrs",
    )
    return html.unionByName(text.select(*html.columns))


def detect_tables(pages: DataFrame, runs: bool = False) -> DataFrame:
    """Grid rows of every html, csv and markdown table of the pages, from one staged scan."""
    return tables_of(scan_pages(pages), runs)


def write_catalogue(grid: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store grid rows, then the catalogue computed from the stored rows, by kind."""
    spark = grid.sparkSession
    grid.write.mode(mode).partitionBy("kind").parquet(f"{path}/grid")
    tables = list_tables(read_grid(spark, path))
    tables.write.mode(mode).partitionBy("kind").parquet(f"{path}/tables")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/grid")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tables")
