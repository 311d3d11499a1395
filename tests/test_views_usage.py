import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlake.operators.retention import expire, keep_latest, upsert_by_key
from gridlake.operators.usage import monthly_usage, quota_status
from gridlake.operators.filters import filter_wide
from gridlake.plans.staging import stage, stages_removed, staging_root
from gridlake.plans.view import ViewSpec, apply_view, open_table, wide_fingerprint, with_row_index

SALES = [
    ["Product", "Q1", "Sold on"],
    ["Lamp", "$ 1.200,50", "03/02/2024"],
    ["Desk", "$ 900,00", "01/02/2024"],
    ["Lamp", "$ 15,25", "20/01/2024"],
    ["Rug", "", "05/03/2024"],
]


@pytest.fixture
def sales(make_grid):
    return open_table(make_grid({5: SALES}), 5, 0)


def test_open_table(make_grid, sales):
    assert sales.columns == ["row_idx", "Product", "Q1", "Sold on"] and sales.count() == 4
    odd = open_table(make_grid({1: [["a", "", "a"], ["1", "2", "3"]]}), 1, 0)
    assert odd.columns == ["row_idx", "a", "Column 2", "a (3)"]
    with pytest.raises(ValueError):
        open_table(make_grid({1: SALES}), 2, 0)


def test_view_end_to_end(sales):
    spec = ViewSpec(
        filters={"Product": {"type": "categorical", "text": "a"}, "Q1": {"type": "numeric"}},
        sort={"column": "Q1", "direction": "desc"},
        stats={"Q1": "sum", "Sold on": "range"},
        series={"x": "Product", "ys": ["Q1"]},
        fingerprint="Product|Q1|Soldon_4x3_Lamp|$1.200,50|03/02/2024",
    )
    spec = ViewSpec.from_json(spec.to_json())
    assert "Q1" not in spec.filters  # an empty filter is not kept
    view = apply_view(sales, spec)
    assert [r["Q1"] for r in view.sorted().collect()] == ["$ 1.200,50", "$ 15,25"]
    assert sorted((r.pos, r.row_idx) for r in view.positioned().collect()) == [(1, 1), (2, 3)]
    got = {r.header: r.num_value for r in view.stats.collect()}
    assert got == {"Product": 2.0, "Q1": 1215.75, "Sold on": 14.0}
    assert {(r.label, r.y) for r in view.series.collect()} == {("Lamp", 1200.5), ("Lamp", 15.25)}
    assert view.fingerprint.first().matches


def test_view_reports_a_foreign_fingerprint(sales):
    view = apply_view(sales, ViewSpec(fingerprint="other"))
    assert not view.fingerprint.first().matches and view.rows.count() == 4
    assert [r.row_idx for r in view.sorted().collect()] == [1, 2, 3, 4]


def test_view_with_given_types_runs_no_profile(sales):
    spec = ViewSpec(
        types={"Product": "categorical", "Q1": "percentage", "Sold on": "date"},
        formats={"Q1": {"thousand": ",", "decimal": ","}},
        stats={"Q1": "max"},
        series={"kind": "scatter", "x": "Q1", "ys": ["Q1"]},
    )
    view = apply_view(sales, spec)
    assert {r.header: r.num_value for r in view.stats.collect()}["Q1"] == 1200.5
    assert view.series.columns == ["series", "row_idx", "pos", "x", "y"]


def test_row_index(spark):
    df = spark.createDataFrame([("b", 2), ("a", 3), ("a", 1)], "k string, v int")
    got = with_row_index(df, ["k", "v"]).collect()
    assert sorted((r.row_idx, r.k, r.v) for r in got) == [(1, "a", 1), (2, "a", 3), (3, "b", 2)]
    mark = wide_fingerprint(with_row_index(df, ["k", "v"]), ["k", "v"]).first().fingerprint
    assert mark == "k|v_3x2_a|1"


def test_stage_writes_under_the_shared_folder(spark):
    kept = stage(spark.range(5), "t")
    assert sorted(r.id for r in kept.collect()) == list(range(5))
    assert all(f.split(":", 1)[1].lstrip("/").startswith(staging_root(spark).lstrip("/")) for f in kept.inputFiles())


VIEWS = "id string, name string, position long, saved_at long, state string"


def test_upsert(spark):
    old = spark.createDataFrame([("1", "a", 1, 10, "A"), ("2", "b", 2, 11, "B")], VIEWS)
    new = spark.createDataFrame(
        [("9", "a", 1, 20, "A2"), ("8", "a", 2, 21, "A3"), ("7", "c", 3, 22, "C"), ("6", "c", 4, 23, "C2")], VIEWS
    )
    got = sorted((tuple(r) for r in upsert_by_key(old, new).collect()), key=lambda r: r[2])
    assert got == [("1", "a", 1, 21, "A3"), ("2", "b", 2, 11, "B"), ("7", "c", 5, 23, "C2")]
    first = upsert_by_key(old.limit(0), new)
    assert sorted((r.name, r.position) for r in first.collect()) == [("a", 1), ("c", 3)]


@pytest.mark.parametrize("n", [3, 1500])
def test_keep_latest(spark, n):
    df = spark.range(4000).select((F.col("id") % 5 == 0).alias("g"), F.col("id").alias("position"))
    got = keep_latest(df, n, ["g"]).collect()
    for g in (True, False):
        have = sorted(r.position for r in got if r.g == g)
        assert have == sorted((i for i in range(4000) if (i % 5 == 0) == g))[-n:]


def test_keep_latest_trims_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("position"))
    plan = keep_latest(df, 50, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # before each of the two exchanges and after
    assert {r.position for r in keep_latest(df, 4).collect()} == {96, 97, 98, 99}


def test_expire(spark):
    now = dt.datetime(2024, 1, 2, 12)
    ages = [23, 24, 25]
    df = spark.createDataFrame([(a, now - dt.timedelta(hours=a)) for a in ages], "age int, saved_at timestamp_ntz")
    got = expire(df, F.lit(str(now)).cast("timestamp_ntz"))
    assert sorted(r.age for r in got.collect()) == [23, 24]


def test_usage_and_quota(spark):
    def at(m, d):
        return dt.datetime(2024, m, d)

    rows = [
        ("u", "scan", at(1, 1), 2, False), ("u", "scan", at(1, 31), 1, False), ("u", "scan", at(1, 5), 0, False),
        ("u", "scan", at(2, 1), 1, False), ("p", "scan", at(1, 1), 1, True), ("u", "save", at(1, 1), 1, False),
    ]
    events = spark.createDataFrame(rows, "user_id string, action string, ts timestamp_ntz, found int, premium boolean")
    used = monthly_usage(events, found=F.col("found"), premium=F.col("premium"))
    assert {(r.user, r.action, r.month): r.used for r in used.collect()} == {
        ("u", "scan", "2024-01"): 2, ("u", "scan", "2024-02"): 1, ("u", "save", "2024-01"): 1,
    }
    status = {(r.action, r.month): r for r in quota_status(used, {"scan": 2, "save": None}).collect()}
    jan, feb, save = status["scan", "2024-01"], status["scan", "2024-02"], status["save", "2024-01"]
    assert (jan.allowed, jan.near_limit, jan.remaining) == (False, False, 0)
    assert (feb.allowed, feb.near_limit, feb.resets_on) == (True, True, dt.date(2024, 3, 1))
    assert save.max is None and save.allowed and not save.near_limit


def test_zero_is_a_bound_and_blank_text_is_none(spark):
    df = spark.createDataFrame([("-5", "a"), ("0", "b"), ("7", None)], "v string, t string")
    assert [r.v for r in filter_wide(df, {"v": {"type": "numeric", "min": 0}}).collect()] == ["0", "7"]
    assert filter_wide(df, {"t": {"type": "categorical", "text": "  "}}).count() == 3
    assert filter_wide(df, {"t": {"type": "categorical", "text": " B "}}).count() == 1


def test_month_of_an_instant_is_that_of_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT 1 AS user_id, 'a' AS action, timestamp_seconds(1706752800) AS ts")  # 2024-02-01 02:00 UTC
        assert monthly_usage(df).first().month == "2024-02"
        plain = spark.sql("SELECT 1 AS user_id, 'a' AS action, TIMESTAMP_NTZ '2024-01-31 23:00:00' AS ts")
        assert monthly_usage(plain).first().month == "2024-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_upsert_offsets_new_keys_wherever_positions_start(spark):
    schema = "id string, name string, position long, saved_at long"
    old = spark.createDataFrame([("a", "x", 1, 0)], schema)
    new = spark.createDataFrame([("b", "y", 0, 1), ("c", "z", 1, 1), ("d", "w", None, 1)], schema)
    got = {r.name: r.position for r in upsert_by_key(old, new).collect()}
    assert got == {"x": 1, "y": 2, "z": 3, "w": 4}


def test_stages_are_removed_and_need_a_shared_folder(spark):
    import os

    with stages_removed(spark):
        path = stage(spark.range(3), "gone").inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging_root(spark) == root.rstrip("/")
