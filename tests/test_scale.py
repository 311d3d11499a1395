"""Work that must not be done twice, or cell by cell where a row will do; and that results stay the same."""

import itertools

from pyspark.sql import functions as F

from conftest import as_tables
from gridlake.functions.dates import parse_date
from gridlake.functions.numbers import parse_number
from gridlake.operators.clean import clean_tables
from gridlake.operators.grid import KEY
from gridlake.operators.types import _core_of, infer_types, typed_rows
from gridlake.plans.staging import stages_listed
from gridlake.sources import html
from gridlake.suite import data


def grids(source):
    page = html.read_page(source)
    return [[list(texts) for _, _, texts in html.grid_rows(page, t)] for t in page.tables]


def test_bare_rows_are_read_as_rows_and_not_tag_by_tag():
    row = "<tr><td>1</td><td> a &amp; b </td><td></td></tr>"
    source = "<table><tr><th>x</th><td>y</td><th>z</th></tr>" + row * 3 + "</table>"
    page = html.read_page(source)
    assert [type(r) for r in page.tables[0].rows] == [html._Texts] * 4 and not page.buf
    assert grids(source) == [[["x", "y", "z"]] + [["1", "a & b", ""]] * 3]


def test_bare_rows_mean_the_same_wherever_they_stand():
    """In spans, blocks, cells, comments and attributes: as when every tag is read by itself."""
    bare = "<tr><td>a</td><td>b</td></tr><tr><th>c</th><td> d</td></tr>"
    parts = ["<table>", "</table>", bare, "<tr><td rowspan=2>s", "<td colspan=2>t</td>", "<pre>", "</pre>", "<!--", "-->", "<p title='", "'>", "<caption>"]
    rows_at_once = html._TAG
    for some in itertools.product(parts, repeat=4):
        source = "<table><tr><td>first</td></tr>" + "".join(some) + "</table>"
        found = [r[:6] + (list(r[6]), r[7]) for r in html._readable(1, None, source, "both")]
        html._TAG = html._EVERY_TAG
        try:
            assert found == list(html._readable(1, None, source, "both")), source
        finally:
            html._TAG = rows_at_once


TABLES = {
    1: [["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"]],
    2: [["a", "", " ", "d"], ["", "", "", ""], ["1", "", "", "x"], [" ", "", "", "\t"], ["2", "", "", ""]],
    3: [["", ""], ["", " "], ["", ""]],
    4: [["a\nb", "é"], ["\n", "c"], ["", "d", ""]],
}


def test_small_tables_are_cleaned_without_a_pass_for_facts(spark, make_grid):
    with stages_listed() as made:
        tidy = clean_tables(make_grid(TABLES))
    assert sum(spark.read.parquet(p).count() for p in made) == 0
    assert as_tables(tidy) == {
        1: TABLES[1],
        2: [["a", "d"], ["1", "x"], ["2", ""]],
        3: TABLES[3],
        4: [["a\nb", "é"], ["\n", "c"], ["", "d"]],
    }


def test_cleaning_is_the_same_in_one_bucket_and_in_many(make_grid):
    wide = [[f"h{i}" if i % 3 else "" for i in range(70)], ["x" if i == 66 else "" for i in range(70)], [""] * 70]
    grid = make_grid(TABLES | {5: wide})
    assert as_tables(clean_tables(grid)) == as_tables(clean_tables(grid, bucket_rows=2))


def test_only_values_with_a_mark_become_cores(spark):
    df = spark.createDataFrame([("12",), ("$1,234.50",), ("a.b",), ("1.5",)], "v string")
    core = _core_of(F.col("v"), F.lit("n"), F.lit(1))
    assert [r[0] for r in df.select(core).collect()] == [None, "1,234.50", None, "1.5"]


def test_pages_hold_neighbours_over_batches(spark, tmp_path):
    """64 rows a page in the order of the scan, also where an Arrow batch ends inside a page."""
    lines = spark.range(1000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"),
        F.lit(1234.5).alias("l_extendedprice"), F.lit(0.04).alias("l_discount"), F.lit("1997-05-03").cast("date").alias("l_shipdate"),
    )
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        pages = {r.page_id: r.html for r in data.shipment_pages(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    read = {p: [row[0] for row in grids(text)[0][1:]] for p, text in pages.items()}
    assert [int(k) for p in sorted(read) for k in read[p]] == list(range(1000))
    assert [len(read[p]) for p in sorted(read)] == [64] * 15 + [40]
    assert "<tr><td>0</td><td>1</td><td>2</td><td>$1,234.50</td><td>4%</td><td>03/05/1997</td></tr>" in pages[0]


def test_common_numbers_and_days_parse_as_before(spark):
    df = spark.createDataFrame([("0012",), ("-0",), ("-5",), ("$1,234.50",), ("1e5",), ("",), (None,), ("31/02/1997",), ("3-5-1997 ",)], "v string")
    found = df.select(parse_number("v"), F.col("v"), parse_date("v").cast("string"), parse_date("v", False).cast("string")).collect()
    assert [str(r[0]) for r in found][:7] == ["12.0", "0.0", "-5.0", "1234.5", "15.0", "0.0", "0.0"]
    assert [tuple(r[2:]) for r in found][-2:] == [(None, None), ("1997-05-03", "1997-03-05")]


def test_typed_rows_follow_the_column_facts(spark, make_grid):
    grid = make_grid({1: [["n", "d", "t", "m"], ["1", "03/05/1997", "x", "$ 1.234,50"], ["2", "04/05/1997", "y", ""]]})
    rows = {r.row_idx: r for r in typed_rows(grid, infer_types(grid)).collect()}
    assert rows[1].nums == [1.0, None, None, 1234.5] and rows[2].nums == [2.0, None, None, 0.0]
    assert [str(x) for x in rows[1].dts] == ["None", "1997-05-03", "None", "None"]
    assert set(KEY) <= set(rows[1].asDict())
