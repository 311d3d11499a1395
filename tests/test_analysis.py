"""Types, stats, filters, sorting, charts and exports."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridlake.operators import charts, export, filters, sorting, stats
from gridlake.operators import grid as grid_module
from gridlake.operators.types import (
    ColumnProfile,
    detect_column_types,
    infer_types,
    learn_profile,
    profile_wide,
    typed_cells,
    typed_rows,
)

BANK = [
    ["Date", "Text", "Charges", "Deposits", "Balance"],
    ["15/09/2025", "Transfer A", "$ 90.000", "", "$ 5.339.195"],
    ["14/09/2025", "Card B", "$ 1.250,50", "", "$ 5.429.195"],
    ["12/09/2025", "Card B", "", "$ 25.000", "$ 5.430.445,50"],
    ["08/09/2025", "Fee", "$ 4.000", "", "$ 5.405.445"],
]
MIXED = [
    ["ID", "Name", "Price", "Discount", "Launched", "Status", "Growth", "Empty"],
    ["1", "Lamp", "$1,299.00", "10%", "2024-01-15", "N/A", "1,5%", ""],
    ["2", "Desk", "$80.50", "5%", "Mar 3, 2024", "7", "12,25%", " "],
    ["3", "Lamp", "$2,000.00", "0%", "12-Sep-2024", "9", "3,75%", ""],
]


@pytest.fixture(params=[None, 2], ids=["one-bucket", "many-buckets"])
def buckets(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(grid_module, "BUCKET_ROWS", request.param)


def types_of(profile, page):
    return [r.type for r in profile.where(F.col("page_id") == page).orderBy("col_idx").collect()]


def test_infer_types(make_grid):
    profile = infer_types(make_grid({1: BANK, 2: MIXED, 3: [["h"]]}))
    assert types_of(profile, 1) == ["date", "categorical", "money", "money", "money"]
    assert types_of(profile, 2) == [
        "numeric", "categorical", "money", "rate", "date", "numeric", "rate", "categorical",
    ]
    assert types_of(profile, 3) == []
    fmt = {(r.page_id, r.header): r.fmt and tuple(r.fmt) for r in profile.collect()}
    assert fmt[1, "Charges"] == fmt[1, "Balance"] == (".", ",")
    assert fmt[1, "Deposits"] == (".", ",") and fmt[1, "Text"] is None
    assert fmt[2, "Price"] == (",", ".") and fmt[2, "Growth"] == (".", ",") and fmt[2, "ID"] == (",", ".")


def test_overrides(spark, make_grid):
    pins = spark.createDataFrame(
        [(1, "html", 0, 2, "categorical", None, None), (1, "html", 0, 4, "percentage", ",", ",")],
        "page_id long, kind string, table_idx int, col_idx int, type string, thousand string, decimal string",
    )
    profile = infer_types(make_grid({1: BANK}), pins)
    assert types_of(profile, 1) == ["date", "categorical", "categorical", "money", "rate"]
    last = profile.where("col_idx = 4").first()
    assert tuple(last.fmt) == (".", ",")


def test_numeric_with_one_odd_value(make_grid):
    tables = {1: [["v"], ["1"], ["N/A"], ["N/A"]], 2: [["v"], ["1"], ["N/A"], ["n/a"]], 3: [["v"], ["x"], ["x"]]}
    profile = infer_types(make_grid(tables))
    assert [types_of(profile, p) for p in tables] == [["numeric"], ["categorical"], ["categorical"]]


def test_formats_are_read_from_all_rows(make_grid):
    rows = [["v"]] + [["1.234"]] * 60 + [["5.25"]]
    grid = make_grid({1: rows})
    profile = infer_types(grid)
    assert tuple(profile.first().fmt) == (",", ".")
    last = typed_cells(grid, profile).where("row_idx = 61").first()
    assert last.num == 5.25
    assert tuple(infer_types(grid, sample_rows=30).first().fmt) == (".", ",")


def test_header_types_use_all_rows(make_grid):
    rows = [["x"]] + [["word"]] * 55 + [["$1.50"]] * 300
    assert detect_column_types(make_grid({1: rows})).first().type == "money"
    assert detect_column_types(make_grid({1: rows}), sample_rows=50).first().type == "categorical"


def test_typed_values(make_grid, buckets):
    grid = make_grid({1: BANK})
    profile = infer_types(grid)
    cells = typed_cells(grid, profile)
    nums = {(r.row_idx, r.header): r.num for r in cells.collect() if r.num is not None}
    assert nums[2, "Charges"] == 1250.5 and nums[3, "Balance"] == 5430445.5 and nums[1, "Deposits"] == 0.0
    days = {r.row_idx: r.dt for r in cells.where("header = 'Date'").collect()}
    assert days[4] == dt.date(2025, 9, 8)
    rows = {r.row_idx: (r.nums, r.dts) for r in typed_rows(grid, profile).collect()}
    assert rows[2][0] == [None, None, 1250.5, 0.0, 5429195.0] and rows[1][1][0] == dt.date(2025, 9, 15)


def test_ragged_rows(make_grid):
    grid = make_grid({1: [["a", "b"], ["1"], ["2", "x", "extra"]]})
    cells = typed_cells(grid, infer_types(grid))
    got = {(r.row_idx, r.header): r.value for r in cells.collect()}
    assert got == {(1, "a"): "1", (1, "b"): None, (2, "a"): "2", (2, "b"): "x"}


def test_header_aware_types(make_grid):
    rows = [["Price", "Rate", "Created", "Count", "Town", "Code"]] + [["x", "y", "z", "w", "v", "12"]] * 3
    got = {r.header: r.type for r in detect_column_types(make_grid({1: rows})).collect()}
    assert got == {
        "Price": "money", "Rate": "percentage", "Created": "date", "Count": "numeric",
        "Town": "categorical", "Code": "money",
    }
    sparse = [["a", "b"]] + [["5%", "7"]] * 7 + [["", ""]] * 3
    got = {r.header: r.type for r in detect_column_types(make_grid({1: sparse})).collect()}
    assert got == {"a": "categorical", "b": "categorical"}  # 0.7 is not above 0.7


def test_bank_stats(make_grid, buckets):
    grid = make_grid({1: BANK})
    long = stats.column_stats(typed_cells(grid, infer_types(grid))).collect()
    got = {(r.header, r.stat): r for r in long}
    assert got["Charges", "count"].num_value == 3 and got["Charges", "sum"].num_value == 95250.5
    assert got["Charges", "min"].num_value == 1250.5 and got["Deposits", "std"].num_value == 0
    assert got["Date", "range"].num_value == 7 and got["Date", "latest"].date_value == dt.date(2025, 9, 15)
    assert (got["Text", "mode"].text_value, got["Text", "mode"].extra) == ("Card B", 0)
    assert got["Text", "unique"].num_value == 3 and got["Date", "mode"].text_value == "15/09/2025"
    assert got["Date", "mode"].extra == 3


def plain_mode(values):
    counts = {}
    for v in values:
        if v not in (None, ""):
            counts[v] = counts.get(v, 0) + 1
    if not counts:
        return None
    def is_index(v):
        return v.isdigit() and str(int(v)) == v and int(v) < 4294967295
    keys = sorted((k for k in counts if is_index(k)), key=int) + [k for k in counts if not is_index(k)]
    top = [k for k in keys if counts[k] == max(counts.values())]
    return len(counts), top[0], len(top) - 1


def test_modes_match_brute_force(spark):
    rng = random.Random(2)
    pool = ["b", "a", "10", "9", "07", "", None, "4294967295", "4294967294", "-1"]
    data = {g: [rng.choice(pool) for _ in range(rng.randint(1, 12))] for g in range(60)}
    rows = [(g, i, v) for g, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, row_idx long, value string")
    got = {r.g: (r.unique, r.mode, r.mode_extra) for r in stats.value_modes(df, ["g"]).collect()}
    want = {g: plain_mode(v) for g, v in data.items()}
    assert got == {g: w for g, w in want.items() if w}


def wide(spark, rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows[1:])], "row_idx long, " + ", ".join(f"`{h}` string" for h in rows[0]))


def test_wide_profile_and_stats(spark):
    df = wide(spark, BANK)
    profile = learn_profile(df, BANK[0])
    assert profile["Charges"] == ColumnProfile("Charges", "money", ".", ",")
    assert [p.type for p in profile.values()] == ["date", "categorical", "money", "money", "money"]
    full = {(r.header, r.stat): r for r in stats.wide_stats(df, profile).collect()}
    assert full["Charges", "sum"].num_value == 95250.5 and full["Text", "mode"].text_value == "Card B"
    panel = {r.header: (r.stat, r.num_value) for r in stats.wide_stats(df, profile, {"Date": "range"}).collect()}
    assert panel == {"Date": ("range", 7.0), "Text": ("count", 4.0), "Charges": ("count", 3.0), "Deposits": ("count", 1.0), "Balance": ("count", 4.0)}
    pinned = learn_profile(df, BANK[0], overrides={"Charges": {"type": "percentage"}})
    assert pinned["Charges"].type == "rate"


def test_wide_profile_is_one_pass(spark):
    plan = profile_wide(wide(spark, MIXED), MIXED[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") <= 1 and "Join" not in plan


def test_display(make_grid):
    grid = make_grid({1: BANK, 2: MIXED})
    long = stats.column_stats(typed_cells(grid, infer_types(grid)))
    shown = stats.display(
        long.withColumn("thousand", F.when(F.col("page_id") == 1, "."))
        .withColumn("decimal", F.when(F.col("page_id") == 1, ","))
    )
    got = {(r.page_id, r.header, r.stat): r.shown for r in shown.collect()}
    assert got[1, "Charges", "sum"] == "$ 95.251" and got[1, "Charges", "avg"] == "$ 31.750,17"
    assert got[1, "Date", "range"] == "7 days" and got[1, "Date", "earliest"] == "9/8/2025"
    assert got[2, "Discount", "avg"] == "5.00%" and got[2, "ID", "avg"] == "2.00"
    assert got[2, "Name", "mode"] == "Lamp" and got[2, "Empty", "mode"] == " "  # blanks are values
    assert got[1, "Deposits", "count"] == "1" and got[2, "Status", "mode"] == "7 (+2)"


def ids(df):
    return [r.row_idx for r in df.orderBy("row_idx").collect()]


def test_filters(spark):
    df = wide(spark, BANK)
    profile = learn_profile(df, BANK[0])

    def keep(spec):
        return ids(filters.filter_wide(df, spec, profile))

    assert keep({"Charges": {"type": "numeric", "min": "4000"}}) == [1, 4]
    assert keep({"Charges": {"type": "numeric", "max": "4000"}}) == [2, 3, 4]
    assert keep({"Charges": {"type": "numeric", "min": "x"}}) == [1, 2, 3, 4]
    assert keep({"Date": {"type": "date", "from": "2025-09-12", "to": "2025-09-14"}}) == [2, 3]
    assert keep({"Text": {"type": "date", "from": "2025-09-12"}}) == [1, 2, 3, 4]
    assert keep({"Text": {"type": "categorical", "selected": ["Card B"], "text": "cARD"}}) == [2, 3]
    assert keep({"Text": {"type": "categorical"}}) == [1, 2, 3, 4]
    both = {"Text": {"type": "categorical", "text": "card"}, "Deposits": {"type": "numeric", "min": "1"}}
    assert keep(both) == [3]


def test_filter_grid_keeps_header(make_grid):
    got = filters.filter_grid(make_grid({1: BANK}), {4: {"type": "numeric", "min": "5430000"}}, {4: ","})
    assert ids(got) == [0, 3]


def test_distinct(spark):
    df = spark.createDataFrame([(" b",), ("B",), ("b ",), ("",), (None,), ("a",)], "v string")
    assert [r.value for r in filters.distinct_values(df, "v").collect()] == ["B", "a", "b"]


def test_sorting(spark):
    df = wide(spark, BANK)
    profile = learn_profile(df, BANK[0])

    def order(column, direction, **kw):
        return [r.row_idx for r in sorting.sort_rows(df, column, direction, profile[column], **kw).collect()]

    assert order("Charges", "asc") == [3, 2, 4, 1] and order("Charges", "desc") == [1, 4, 2, 3]
    assert order("Text", "asc") == [2, 3, 4, 1] and order("Text", "desc") == [1, 4, 2, 3]
    assert order("Date", "asc") == [4, 3, 2, 1] and order("Text", "none") == [1, 2, 3, 4]
    assert order("Date", "desc", date_order="chronological") == [1, 2, 3, 4]
    got = sorting.positions(df, "Balance", "desc", profile["Balance"]).collect()
    assert sorted((r.pos, r.row_idx) for r in got) == [(1, 3), (2, 2), (3, 4), (4, 1)]


def test_text_sort_is_collated(spark):
    df = wide(spark, [["v"], ["b"], ["B"], ["a"], ["é"], ["e"], ["f"], [""]])
    assert [r.v for r in sorting.sort_rows(df, "v").collect()] == ["", "a", "b", "B", "e", "é", "f"]


def test_chart_data(spark):
    df = wide(spark, BANK)
    profile = learn_profile(df, BANK[0])
    got = charts.chart_series(df, "Text", ["Charges", "Deposits"], profile).collect()
    assert {(r.series, r.row_idx): (r.label, r.y) for r in got}["Deposits", 3] == ("Card B", 25000.0)
    assert len(got) == 8
    points = charts.scatter_points(df, "Balance", ["Charges"], profile).where("row_idx = 2").first()
    assert (points.x, points.y) == (5429195.0, 1250.5)


AWKWARD = [["Name", "Note"], ['say "x"', "a,b"], ["p|q", "two\r\nlines"], ["t\tab", None]]


def lines(make_grid, fmt):
    got = export.export_lines(make_grid({1: AWKWARD}), fmt).orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(len(got)))
    return [r.line for r in got]


def test_export_lines(make_grid):
    assert lines(make_grid, "csv") == ["Name,Note", '"say ""x""","a,b"', 'p|q,"two\r\nlines"', "t\tab,"]
    assert lines(make_grid, "tsv")[1:] == ['"say ""x"""\ta,b', 'p|q\t"two\r\nlines"', '"t\tab"\t']
    assert lines(make_grid, "md") == [
        "| Name | Note |", "| --- | --- |", '| say "x" | a,b |', "| p\\|q | two lines |", "| t\tab |  |",
    ]
    with pytest.raises(ValueError):
        export.export_lines(make_grid({1: AWKWARD}), "xlsx")


def test_export_all(spark, make_grid, tmp_path):
    grid = make_grid({1: [["a", "b"]] + [[str(i), "x"] for i in range(50)], 2: [["k"], ["v"]]})
    tables = grid.groupBy("page_id", "kind", "table_idx").agg(F.count("*").alias("n_rows"))
    tables = tables.withColumn("rank", F.lit(1)).withColumn("url", F.lit("https://www.shop.example.com/x"))
    placed = export.list_positions(tables)
    manifest = export.export_all(grid, placed, str(tmp_path / "out"), "2024-02-01").collect()
    assert {(r.page_id, r.sheet_name, r.export_name) for r in manifest} == {
        (1, "Table_1", "shop_all_tables_2024-02-01"), (2, "Table_1", "shop_all_tables_2024-02-01"),
    }
    folder = tmp_path / "out" / "tables" / "page_id=1" / "kind=html" / "table_idx=0"
    text = "".join(f.read_text() for f in sorted(folder.glob("part-*.txt")))
    assert text.split("\n")[:-1] == ["a,b"] + [f"{i},x" for i in range(50)]
    with pytest.raises(ValueError):
        export.export_all(grid, placed.where("n_rows < 0"), str(tmp_path / "none"), "2024-02-01")


def test_sheet_names(spark):
    rows = [
        (1, "html", i, pos, 3, None, source)
        for i, (pos, source) in enumerate([
            (1, "a/b*c?[d]:e\\f"), (2, None), (3, "////"), (4, "x" * 40),
            (10**10, "y" * 20), (10**10 + 1, "y" * 20), (10**10 + 2, "y" * 20),
        ])
    ]
    df = spark.createDataFrame(rows, "page_id long, kind string, table_idx int, position long, n_rows long, url string, source string")
    got = {r.position: r.sheet_name for r in export.export_manifest(df, "d", source="source").collect()}
    assert got[1] == "abcdef_1" and got[2] == "Table_2" and got[3] == "Table_3" and got[4] == "x" * 20 + "_4"
    assert len(set(got.values())) == 7 and max(map(len, got.values())) <= 31
