import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import as_tables
from gridlake.sources.json_tables import normalize_table_json
from gridlake.sources.pages import page_intervals, select_page_ranges
from gridlake.sources.text_tables import (
    csv_rows,
    extract_block_tables,
    extract_text_tables,
    looks_like_csv,
    looks_like_markdown,
    markdown_rows,
)


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr("v").alias("x")).orderBy("i").collect()]


def test_csv_sniffing(spark):
    cases = {
        "a,b\n1,2": True,
        "a,b": False,
        "ab\n1,2": False,
        "a,b\n1\n2\n3,4": True,
        "a,b,c,d\n1\n2\n3,4,5,6": False,
        "  \na,b,c\n1,2,3\n ": True,
        "": False,
        None: False,
    }
    assert run(spark, list(cases), looks_like_csv) == list(cases.values())


def test_markdown_sniffing(spark):
    cases = {
        "|a|b|\n|---|---|": True,
        "a|b\nc|d": False,
        "|a|b|\nx": False,
        "|a|b|\nx\ny": True,
        "a|b|c\n--- | x": True,
        "|a|b|": False,
    }
    assert run(spark, list(cases), looks_like_markdown) == list(cases.values())


def plain_csv(text):
    out = []
    for line in text.strip().split("\n"):
        row, cell, quoted = [], "", False
        for ch in line:
            if ch == '"':
                quoted = not quoted
            elif ch == "," and not quoted:
                row.append(cell.strip())
                cell = ""
            else:
                cell += ch
        out.append([*row, cell.strip()])
    return out


def test_csv_parsing(spark):
    rng = random.Random(3)
    texts = ['a,"b,c", d \n"x""y",\r\nopen "q,1\n2,3', "\x01a,b\n\"\x01,b\",c"]
    texts += ["".join(rng.choice('ab,"\n \x01') for _ in range(40)) + "z" for _ in range(60)]
    assert run(spark, texts, csv_rows) == [plain_csv(t) for t in texts]


def test_markdown_parsing(spark):
    text = " | a | b |\n|---|---|\n| 1 |  | 2 |\n\n||\n x "
    assert run(spark, [text], markdown_rows) == [[["a", "b"], ["1", "2"], ["x"]]]


def test_block_mode_gives_both_kinds(spark):
    text = "a|b|c,d\n---|x,y\n1|2|3,4\n5|6|7,8"
    blocks = spark.createDataFrame([(1, 4, text)], "page_id long, block_idx int, text string")
    got = extract_block_tables(blocks)
    assert {(r.kind, r.table_idx) for r in got.collect()} == {("csv", 4), ("markdown", 4)}
    assert as_tables(got.where("kind = 'markdown'"))[1][0] == ["a", "b", "c,d"]


def test_free_text_mode_prefers_csv(spark):
    df = spark.createDataFrame(
        [(1, "a|b|c,d\n1|2|3,4\n5|6|7,8"), (2, "|a|b|\n|---|---|\n|1|2|"), (3, "|a|b|\n|---|\n|---|")],
        "page_id long, text string",
    )
    got = extract_text_tables(df)
    assert {(r.page_id, r.kind) for r in got.collect()} == {(1, "csv-selection"), (2, "markdown-selection")}


JSON = {
    1: [{"rows": [["h1", "h2"], ["a", 1.5]], "page": 0, "table_index": 1}],
    2: {"tables": [{"table": {"rows": [["h"], [None]], "page": 2, "table_index": 0}}]},
    3: [{"columns": ["h1", "h2"], "data": [["a", "b"]], "index": 5}],
    4: [{"columns": ["h1"], "rowsData": [["a"]]}],
    5: [{"rows": []}, {"rows": [], "columns": ["c"], "data": [["d"]]}, {"rows": "odd"}],
    6: {"other": 1},
    7: [{"data": [["x"], ["y"]], "page": 3, "table": {"rows": [["no"]], "page": 9}}],
}


def test_service_json(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in JSON.items()], "page_id long, json string")
    got = normalize_table_json(df)
    assert as_tables(got) == {
        1: [["h1", "h2"], ["a", "1.5"]],
        2: [["h"], [""]],
        3: [["h1", "h2"], ["a", "b"]],
        4: [["h1"], ["a"]],
        5: [["c"], ["d"]],
        7: [["x"], ["y"]],
    }
    places = {r.page_id: (r.table_idx, r.service_page, r.service_index) for r in got.collect()}
    assert places == {1: (0, 0, 1), 2: (0, 2, 0), 3: (0, None, 5), 4: (0, None, None), 5: (1, None, None), 7: (0, 3, None)}


RANGES = {
    "1-3,5": [0, 1, 2, 4],
    " 4 - 2 ,, 2": [1, 2, 3],
    "7": [6],
    "3abc": [2],
    ",": [],
    "1-3-9": [0, 1, 2],
    "1-20": list(range(20)),
    "": "Empty input",
    None: "Empty input",
    "0": "Invalid page: 0",
    "x": "Invalid page: x",
    "2,-3,y": "Invalid range: -3",
    "5-": "Invalid range: 5-",
    "1-21": "More than 20 pages specified (21)",
    "1-999999999999,5": "More than 20 pages specified (999999999999)",
    "1-15,10-30,2": "More than 20 pages specified (30)",
}


def test_page_ranges(spark):
    specs = spark.createDataFrame(list(enumerate(RANGES)), "spec_id int, spec string")
    intervals, errors = page_intervals(specs, max_pages=20)
    got = {i: [] for i in range(len(RANGES))}
    for r in intervals.collect():
        got[r.spec_id] += range(r["first"], r["last"] + 1)
    for r in errors.collect():
        assert got[r.spec_id] == []
        got[r.spec_id] = r.error
    assert [sorted(v) if isinstance(v, list) else v for v in got.values()] == list(RANGES.values())


def test_select_pages(spark):
    pages = spark.range(10).select(F.lit(1).alias("spec_id"), F.col("id").alias("page"))
    specs = spark.createDataFrame([(1, "2-3,9")], "spec_id int, spec string")
    chosen, errors = select_page_ranges(pages, specs, max_pages=20)
    assert sorted(r.page for r in chosen.collect()) == [1, 2, 8] and errors.isEmpty()


@pytest.mark.parametrize("limit", [1, 3])
def test_page_limit_is_a_parameter(spark, limit):
    specs = spark.createDataFrame([(1, "1-2"), (2, "1")], "spec_id int, spec string")
    intervals, errors = page_intervals(specs, max_pages=limit)
    assert errors.count() == (1 if limit == 1 else 0)
    assert sorted(map(tuple, intervals.collect())) == ([(2, 0, 0)] if limit == 1 else [(1, 0, 1), (2, 0, 0)])


def test_page_intervals_are_merged_and_never_expanded(spark):
    texts = ["1-999999999999", "5,1-3,4,10-8,9223372036854775807,2-9", "9223372036854775806-9223372036854775807,1", "3,3,3"]
    specs = spark.createDataFrame(list(enumerate(texts)), "spec_id int, spec string")
    intervals, errors = page_intervals(specs)
    assert errors.isEmpty() and "sequence" not in intervals._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, intervals.collect())) == [
        (0, 0, 999_999_999_998), (1, 0, 9), (1, 2**63 - 2, 2**63 - 2), (2, 0, 0), (2, 2**63 - 3, 2**63 - 2), (3, 2, 2)
    ]
    pages = spark.createDataFrame([(0, 7), (0, 999_999_999_999), (1, 9), (1, 10), (3, 2), (4, 0), (None, 0)], "spec_id int, page long")
    chosen, _ = select_page_ranges(pages, specs)
    assert sorted(map(tuple, chosen.collect())) == [(0, 7), (1, 9), (3, 2)]
    _, refused = page_intervals(specs, max_pages=20)
    assert {r.spec_id: r.error for r in refused.collect()}[0] == "More than 20 pages specified (999999999999)"


def test_json_numbers_stay_as_written(spark):
    cells = ["2.50", "-0", "1e5", "0.10", "12345678901234567890.10"]
    tricky = ["a, 5.0, 1: 2", "x\\\\", 'q\\"7.10', "[1, 2]"]
    text = '[{"rows": [[%s, "%s"], [7.00, true]], "index": 3.0, "page":-1}]' % (", ".join(cells), '", "'.join(tricky))
    long = '[{"rows": [[%s 1.50], ["z"]]}]' % ('"t\\n5", ' * 50_000)
    df = spark.createDataFrame([(1, text), (2, long), (3, "{"), (4, None), (5, "7.0")], "page_id int, json string")
    rows = {(r.page_id, r.row_idx): r for r in normalize_table_json(df).collect()}
    assert rows[1, 0].cells == [*cells, "a, 5.0, 1: 2", "x\\", 'q"7.10', "[1, 2]"]
    assert rows[1, 1].cells == ["7.00", "true"]
    assert (rows[1, 0].service_index, rows[1, 0].service_page) == (3, -1)
    assert rows[2, 0].cells[-1] == "1.50" and len(rows[2, 0].cells) == 50_001 and rows[2, 0].cells[0] == "t\n5"
