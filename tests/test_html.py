import random

from pyspark.sql import functions as F

from conftest import as_tables
from gridlake.operators.catalogue import table_sizes
from gridlake.operators.clean import clean_tables
from gridlake.operators.grid import dense_grid
from gridlake.operators.types import infer_types
from gridlake.plans.detect import detect_tables, read_grid, read_tables, scan_pages, tables_of, write_catalogue
from gridlake.sources.html import (
    extract_code_blocks,
    extract_html_runs,
    extract_html_tables,
    grid_rows,
    page_errors,
    read_page,
)


def tables(html):
    page = read_page(html)
    return [[laid_out(*row) for row in grid_rows(page, t)] for t in page.tables]


def laid_out(width, at, texts):
    line = [""] * width
    for c, text in zip(range(width) if at is None else at, texts):
        line[c] = text
    return line


def test_plain_and_implied_end_tags():
    assert tables("<TABLE><tr><th>A<th>B &amp; C<tr><td> 1 <td>x<br>y</table>") == [
        [["A", "B & C"], ["1", "xy"]]
    ]


def test_cells_without_row_and_stray_markup():
    html = "<td>no</td><table><thead><td>a</thead><tbody><td>1<td>2</table><tr><td>no"
    assert tables(html) == [[["a", ""], ["1", "2"]]]


def test_scripts_comments_and_quoted_brackets():
    html = (
        "<script>x='<table><tr><td>no</td></tr></table>'</script><!-- <table><tr><td>no -->"
        "<table><tr><td title='a > b'>k<script>var a = '<td>';</script>v</td>"
        "<td>1 < 2</td></tr></table>"
    )
    assert tables(html) == [[["kv", "1 < 2"]]]


def test_rowspan_repeats_and_colspan_blanks():
    html = (
        "<table><tr><th>Name<th colspan=2>Score<th>Total</tr>"
        "<tr><td rowspan='2'>Ann<td>1<td>2<td>3</tr><tr><td>4<td>5<td>9</tr>"
        "<tr><td>Bob<td colspan=2>Absent<td>0</tr></table>"
    )
    assert tables(html) == [
        [
            ["Name", "Score", "", "Total"],
            ["Ann", "1", "2", "3"],
            ["Ann", "4", "5", "9"],
            ["Bob", "Absent", "", "0"],
        ]
    ]


def test_rowspan_past_the_end_adds_rows():
    assert tables("<table><tr><td rowspan=3>a<td>b</table>") == [[["a", "b"], ["a", ""], ["a", ""]]]


def test_malformed_spans_count_as_one():
    html = "<table><tr><td colspan=x rowspan=0>a<td colspan='-2'>b<td colspan='2px'>c</table>"
    assert tables(html) == [[["a", "b", "c", ""]]]


def test_container_sees_inner_rows_and_cells():
    html = "<table><tr><td>out<table><tr><td>1<td>2</table></td><td>z</td></tr></table>"
    outer, inner = tables(html)
    assert inner == [["1", "2"]]
    assert outer == [["out12", "1", "2", "z"], ["1", "2", "", ""]]
    assert [t.nested for t in read_page(html).tables] == [1, 0]


def full_grid(rows):
    """The whole grid at once, the plain way, as a check on the streaming layout."""
    rows = [r for r in rows if r]
    width = max(sum(c[1] for c in r) for r in rows)
    grid = []
    for i, cells in enumerate(rows):
        while len(grid) <= i:
            grid.append([""] * width)
        at = 0
        for text, across, down in cells:
            while at < width and grid[i][at]:
                at += 1
            for r in range(i, i + down):
                while len(grid) <= r:
                    grid.append([""] * width)
                for c in range(at, min(width, at + across)):
                    grid[r][c] = text if c == at else ""
            at += across
    return grid


def test_random_spans_match_the_full_grid():
    rng = random.Random(7)
    for _ in range(300):
        rows = [
            [
                (rng.choice(["", "a", "b", "c"]), rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4]))
                for _ in range(rng.randint(1, 4))
            ]
            for _ in range(rng.randint(1, 6))
        ]
        body = "".join(
            "<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}</td>" for t, a, d in r) + "</tr>"
            for r in rows
        )
        assert tables(f"<table>{body}</table>") == [full_grid(rows)]


PAGES = "page_id long, url string, html string"


def test_extraction_job(spark):
    html = (
        "<table id=one><tr><td>a</td></tr></table>"
        "<table name=two role=x><tr><td>h</td></tr><tr><td>1</td></tr></table>"
    )
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "<p>none</p>"), (3, "w", None)], PAGES)
    rows = extract_html_tables(pages, batch_cells=1).orderBy("row_idx").collect()
    assert [(r.page_id, r.table_idx, r.row_idx, r.cells) for r in rows] == [
        (1, 1, 0, ["h"]), (1, 1, 1, ["1"]),
    ]
    assert rows[0].attrs.element_name == "two" and rows[0].attrs.url == "u" and rows[1].attrs is None


def test_prefilter_and_one_python_stage(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "u", "<table>")], PAGES).withColumn("extra", F.lit("x")).write.parquet(path)
    plan = extract_html_tables(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert plan.index("MapInArrow") < plan.index("Filter") and "extra" not in plan


def test_code_blocks_nested_and_in_cells(spark):
    html = "<pre id=p>\na,b\n1,2</pre><table><tr><td><pre>x<td>y</table><pre><code>t</code></pre>"
    pages = spark.createDataFrame([(1, "u", html)], PAGES)
    got = {r.block_idx: r.text for r in extract_code_blocks(pages).collect()}
    assert got == {0: "a,b\n1,2", 1: "x", 2: "t", 3: "t"}


def test_detect_write_read(spark, tmp_path):
    html = (
        "<table><tr><td>h</td><td>k</td></tr><tr><td>1</td><td>2</td></tr></table>"
        "<pre><code>a,b\n1,2\n3,4</code></pre><code id=md>|x|y|\n|---|---|\n|1|2|</code>"
    )
    pages = spark.createDataFrame([(9, "http://s/p", html)], PAGES)
    write_catalogue(detect_tables(pages), str(tmp_path / "cat"))
    found = read_tables(spark, str(tmp_path / "cat")).collect()
    ids = {(t.kind, t.table_idx): t.table_id for t in found}
    assert set(ids) == {("html", 0), ("csv", 0), ("csv", 1), ("markdown", 2)}
    assert ids["markdown", 2] == "markdown_md_2" and ids["html", 0].startswith("html_")
    assert read_grid(spark, str(tmp_path / "cat")).where("kind = 'csv'").count() == 6


HUGE = "<table><tr><td colspan=200000000>a<td>b<tr><td> <td rowspan=2>c<td colspan=3> d </table>"


def test_huge_spans_stay_runs_until_cells_are_asked_for(spark):
    rows = [(1, "u", HUGE), (2, "u", "<table><tr><td>x<td>y<tr><td>1</table>")]
    runs = extract_html_runs(spark.createDataFrame(rows, PAGES))
    got = {(r.page_id, r.row_idx): (r.width, r["at"], r.texts) for r in runs.collect()}
    assert got == {
        (1, 0): (200_000_001, [0, 200_000_000], ["a", "b"]),
        (1, 1): (200_000_001, [1, 2], ["c", "d"]),
        (1, 2): (200_000_001, [1], ["c"]),
        (2, 0): (2, None, ["x", "y"]),
        (2, 1): (2, None, ["1"]),
    }
    tidy = clean_tables(runs)
    assert {(r.page_id, r.row_idx): r.cells for r in tidy.collect()} == {
        (1, 0): ["a", "", "", "b"], (1, 1): ["", "c", "d", ""], (1, 2): ["", "c", "", ""],
        (2, 0): ["x", "y"], (2, 1): ["1", ""],
    }
    sizes = {r.page_id: (r.n_rows, r.n_cols, r.filled_cells, r.total_cells) for r in table_sizes(runs).collect()}
    assert sizes == {1: (3, 200_000_001, 5, 600_000_003), 2: (2, 2, 3, 4)}
    header = infer_types(runs).where("page_id = 1").collect()
    assert [(r.col_idx, r.header) for r in header] == []  # no column has both a header text and a body cell
    wide = dense_grid(runs.where("page_id = 2")).orderBy("row_idx")
    assert [r.cells for r in wide.collect()] == [["x", "y"], ["1", ""]]


def test_runs_lay_out_as_cells(spark):
    rng = random.Random(8)

    def cell():
        spans = "".join(f" {n}={rng.randrange(1, 5)}" for n in ("colspan", "rowspan") if rng.random() < 0.3)
        return f"<td{spans}>{rng.choice(['', 'x', 'y', ' '])}"

    pages = [(i, "u", "<table>" + "".join("<tr>" + "".join(cell() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(2, 6))) + "</table>") for i in range(150)]
    df = spark.createDataFrame(pages, PAGES)
    want = {i: tables(html)[0] for i, _, html in pages}
    got = as_tables(extract_html_tables(df))
    assert got == want
    assert as_tables(clean_tables(extract_html_runs(df))) == as_tables(clean_tables(extract_html_tables(df)))


def test_unreadable_pages_give_error_rows(spark):
    rows = [
        (1, "u", "<table><tr><td>k<td>v<tr><td>1<td>2</table>"),
        (2, "u", f"<table><tr><td colspan={'9' * 6000}>a<tr><td>b</table>"),
        (3, "u", f"<table><tr><td colspan={1 << 62}>a<td colspan={1 << 62}>b<tr><td>c</table>"),
        (4, "u", "<table><tr><td>k<td>v<tr><td>3<td>4</table>"),
    ]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    found = scan_pages(pages)
    errors = {r.page_id: r.reason for r in page_errors(found).collect()}
    assert set(errors) == {2, 3} and all(x.startswith("ValueError: ") for x in errors.values())
    assert {r.page_id for r in tables_of(found).collect()} == {1, 4}
    assert {r.page_id for r in extract_html_tables(pages).collect()} == {1, 4}


def test_runs_reach_the_catalogue_sizes(spark):
    found = detect_tables(spark.createDataFrame([(1, "u", HUGE + "<pre>a,b\n1,2</pre>")], PAGES), runs=True)
    got = {(r.kind, r.row_idx): r.width for r in found.collect()}
    assert got == {("html", 0): 200_000_001, ("html", 1): 200_000_001, ("html", 2): 200_000_001, ("csv", 0): 2, ("csv", 1): 2}
    assert {r.kind: r.n_cols for r in table_sizes(found).collect()} == {"html": 200_000_001, "csv": 2}
