import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("gridlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    return session


GRID = "page_id long, kind string, table_idx int, row_idx long, cells array<string>"


@pytest.fixture(scope="session")
def make_grid(spark):
    """Grid DataFrame from {page_id: [[cell, ...], ...]} (kind html, table 0)."""

    def build(tables, kind="html"):
        rows = [
            (page, kind, 0, i, cells)
            for page, grid in tables.items()
            for i, cells in enumerate(grid)
        ]
        return spark.createDataFrame(rows, GRID)

    return build


def as_tables(grid):
    """{page_id: [[cell, ...], ...]} of a grid DataFrame, checking dense row numbers."""
    out = {}
    for r in sorted(grid.collect(), key=lambda r: (r.page_id, r.row_idx)):
        rows = out.setdefault(r.page_id, [])
        assert r.row_idx == len(rows), (r.page_id, r.row_idx)
        rows.append(list(r.cells))
    return out
