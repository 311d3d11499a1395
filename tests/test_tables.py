"""Cleaning, catalogue and search, each also with tiny buckets so every table spans several."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import as_tables
from gridlake.operators import catalogue, grid as grid_module
from gridlake.operators.catalogue import (
    fingerprints,
    get_table,
    list_tables,
    merge_tables,
    rank_tables,
    search_tables,
    table_metrics,
)
from gridlake.operators.clean import (
    clean_tables,
    drop_empty_columns,
    pad_rows,
    promote_header,
    set_header_row,
    validate_rectangular,
)
from gridlake.operators.grid import number_rows, rank_within
from gridlake.sources.html import ATTRS


@pytest.fixture(params=[None, 2], ids=["one-bucket", "many-buckets"])
def buckets(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(grid_module, "BUCKET_ROWS", request.param)
    return request.param


def plain_clean(rows):
    width = max(len(r) for r in rows)
    rows = [[c or "" for c in r] + [""] * (width - len(r)) for r in rows]
    keep = [i for i in range(width) if any(r[i].strip() for r in rows)]
    if not keep:
        return rows
    rows = [[r[i] for i in keep] for r in rows]
    return [r for i, r in enumerate(rows) if i == 0 or any(c.strip() for c in r)]


DIRTY = {
    1: [["Name", "", "Age", " "], ["a", "", "1"], ["", None, " "], ["b", "", "2", ""]],
    2: [["", "", ""], ["x", "", ""], ["", "", ""], ["", "", "y"]],
    3: [["", " "], ["", ""], [""]],
    4: [["only"]],
}


def test_clean(make_grid, buckets):
    got = as_tables(clean_tables(make_grid(DIRTY)))
    assert got == {k: plain_clean(v) for k, v in DIRTY.items()}


def test_clean_random(make_grid, buckets):
    rng = random.Random(5)
    tables = {
        p: [
            [rng.choice(["", "", " ", "v", None]) for _ in range(rng.randint(1, 4))]
            for _ in range(rng.randint(1, 9))
        ]
        for p in range(40)
    }
    assert as_tables(clean_tables(make_grid(tables))) == {k: plain_clean(v) for k, v in tables.items()}


def test_drop_columns_and_pad(make_grid, buckets):
    got = as_tables(drop_empty_columns(make_grid(DIRTY)))
    assert got[1] == [["Name", "Age"], ["a", "1"], ["", " "], ["b", "2"]]
    assert got[3] == [["", " "], ["", ""], ["", ""]]
    padded = as_tables(pad_rows(make_grid({1: [["a", "b"], ["c"], []]})))
    assert padded == {1: [["a", "b"], ["c", ""], ["", ""]]}


def test_headers(make_grid, buckets):
    grid = make_grid({1: [["Top"], ["Meta"], ["Year"], ["1"]], 2: [["a"], ["b"]]})
    assert as_tables(promote_header(grid, 2)) == {
        1: [["Year"], ["Top"], ["Meta"], ["1"]],
        2: [["b"], ["a"]],
    }
    assert as_tables(promote_header(grid, -3))[1][0] == ["Top"]
    assert as_tables(set_header_row(grid, 2)) == {1: [["Year"], ["1"]], 2: [["a"], ["b"]]}
    assert as_tables(set_header_row(grid, 2, delete_above=False))[1] == [["Year"], ["Top"], ["Meta"], ["1"]]


def test_rectangular(make_grid, buckets):
    grid = make_grid({1: [["A", "B"], ["C"], ["D", "E"]], 2: [["A"], ["B"]], 3: [[]]})
    got = {r.page_id: (r.is_rectangular, r.first_bad_row) for r in validate_rectangular(grid).collect()}
    assert got == {1: (False, 1), 2: (True, None), 3: (False, None)}


def metrics(spark, rows):
    cols = "page_id long, kind string, table_idx int, is_presentation boolean, is_container boolean, score double"
    return spark.createDataFrame([(p, "html", i, pr, co, s) for p, i, pr, co, s in rows], cols)


RANKED = [
    (1, 0, True, True, 9.0), (1, 1, False, False, 2.0), (1, 2, False, True, 8.0),
    (1, 3, False, False, 3.0), (1, 4, False, False, 3.0),
    (2, 0, True, True, 1.0), (2, 1, True, False, 0.5),  # layout tables only: inner one wins
    (3, 0, True, False, 9.0), (3, 1, False, True, 1.0),  # containers judged on survivors
    (4, 0, True, True, 1.0), (4, 5, True, True, 2.0),  # nothing else: both stay
]


def test_ranking(spark, buckets):
    got = {(r.page_id, r.table_idx): r["rank"] for r in rank_tables(metrics(spark, RANKED)).collect()}
    assert got == {(1, 3): 1, (1, 4): 2, (1, 1): 3, (2, 1): 1, (3, 1): 1, (4, 5): 1, (4, 0): 2}
    top = rank_tables(metrics(spark, RANKED), top_k=1)
    assert {r.page_id: r.table_idx for r in top.collect()} == {1: 3, 2: 1, 3: 1, 4: 5}


def test_rank_within_splits_hot_keys(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else i, rng.randint(0, 5), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, score int, idx int")
    order = [F.col("score").desc(), F.col("idx")]
    numbered = F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint")
    plain = {tuple(r) for r in df.withColumn("rank", numbered).collect()}
    split = {tuple(r) for r in rank_within(df, ["k"], order).select("k", "score", "idx", "rank").collect()}
    assert plain == split
    expected = sorted((r for r in rows if r[0] == 0), key=lambda r: (-r[1], r[2]))
    assert [r[2] for r in expected] == [r[2] for r in sorted((r for r in split if r[0] == 0), key=lambda r: r[3])]


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id"))
    got = sorted((r.pos, r.a, r.id) for r in number_rows(df, [F.col("a").desc(), F.col("id")]).collect())
    assert [g[0] for g in got] == list(range(1, 1001))
    assert [(-g[1], g[2]) for g in got] == sorted((-(i % 7), i) for i in range(1000))


def test_metrics_and_catalogue(make_grid):
    wide = [["h"] + [""] * 24, ["x"] * 3 + [""] * 22]
    grid = make_grid({1: [["A", "B"], ["1", " "], ["", None]], 2: wide, 3: [["a", "b", "c", "d"]] + [["w" * 16, "x", "y", "z"]] * 3})
    got = {r.page_id: r for r in table_metrics(grid).collect()}
    assert (got[1].density, got[1].avg_row_fill, got[1].is_presentation) == (0.5, 1.0, False)
    assert got[2].is_presentation and got[3].score == 4.0
    listed = {r.page_id: r for r in list_tables(grid).collect()}
    assert listed[3].preview == "a | b | c\n" + "\n".join(["w" * 12 + "... | x | y"] * 2) + "\n..."
    assert listed[1].preview == "A | B\n1 |  \n | "
    assert listed[3].header == ["a", "b", "c", "d"] and listed[3].n_rows == 4
    assert get_table(grid, 3, 0).count() == 4


def test_fingerprint(make_grid):
    grid = make_grid({1: [["Full name", "Age"], ["A b", "3"]], 2: [["Full name", "Age"], ["A b", "3"]], 3: [["x"]]})
    got = {r.page_id: r.fingerprint for r in fingerprints(grid).collect()}
    assert got == {1: "Fullname|Age_1x2_Ab|3", 2: "Fullname|Age_1x2_Ab|3", 3: "x_0x1_"}


def test_search_matches_brute_force(make_grid):
    rng = random.Random(11)
    tables = {
        p: [[rng.choice(["ab", "B c", "", "x\n y", "d"]) for _ in range(2)] for _ in range(rng.randint(2, 5))]
        for p in range(30)
    }
    grid = make_grid(tables)
    listed = list_tables(grid)
    for q in ["ab b", " B C ", "", "d \n ab", "x\n y \n x", "y \n  d", "zz", "d d \n d d \n d"]:
        want = {
            p for p, rows in tables.items()
            if q.strip().lower() in " \n ".join(" ".join(r) for r in rows).lower()
        }
        assert {r.page_id for r in search_tables(listed, grid, q).collect()} == want, q


def test_search_without_rows_uses_preview(make_grid):
    grid = make_grid({1: [["Alpha"], ["1"]], 2: [["Beta"], ["1"]]})
    listed = list_tables(grid)
    got = search_tables(listed, grid.where("page_id = 2"), "alpha")
    assert [r.page_id for r in got.collect()] == [1]


def test_merge_keeps_first(spark):
    cols = "table_id string, v string, position long"
    old = spark.createDataFrame([("a", "old", 0), ("b", "old", 1)], cols)
    new = spark.createDataFrame([("b", "new", 2), ("c", "late", 4), ("c", "early", 3)], cols)
    assert sorted(tuple(r) for r in merge_tables(old, new).collect()) == [
        ("a", "old", 0), ("b", "old", 1), ("c", "early", 3),
    ]


def test_no_cross_join_anywhere(make_grid):
    plan = list_tables(make_grid(DIRTY))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert catalogue.ROW_FILL_CAP == 10


def test_null_page_ids_stay(spark):
    rows = [(p, "html", 0, i, [f"h{i}", "x"]) for p in (None, 1) for i in range(3)]
    grid = spark.createDataFrame(rows, "page_id long, kind string, table_idx int, row_idx long, cells array<string>")
    assert clean_tables(grid).count() == 6
    assert {r.page_id for r in table_metrics(grid.withColumn("attrs", F.lit(None).cast(ATTRS))).collect()} == {None, 1}


def test_merge_picks_one_row_of_equal_positions(spark):
    schema = "table_id string, origin string, position long"
    old = spark.createDataFrame([("a", "old", 1)], schema)
    new = [("b", "first", 5), ("b", "second", 5), ("c", "only", None), ("a", "again", 2)]
    first = {tuple(r) for r in merge_tables(old, spark.createDataFrame(new, schema).repartition(4)).collect()}
    again = {tuple(r) for r in merge_tables(old, spark.createDataFrame(new[::-1], schema).coalesce(1)).collect()}
    assert first == again and len(first) == 3 and ("c", "only", None) in first
