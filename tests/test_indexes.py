"""Stored indexes and saved views: the same results as without them, less read."""

import json
import random

import pytest
from gridlake.operators import search, sidecar
from gridlake.operators.catalogue import fingerprints, list_tables, merge_tables, search_tables
from gridlake.operators.export import export_all
from gridlake.operators.filters import filter_grid
from gridlake.operators.grid import KEY
from gridlake.operators.types import infer_types
from gridlake.plans import saved_views
from gridlake.plans.saved_views import apply_saved_views
from gridlake.plans.view import ViewSpec, apply_view, open_table

GRID = "page_id long, kind string, table_idx int, row_idx long, cells array<string>"


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    names = ["Ánna", "bob", "Carla", "dee", "x", "", "two\nlines", "household", "1 row", None]
    rows = []
    for page in [None, *range(60)]:
        header = ["Key", "Name", f"Col {page}"]
        body = [[str(rng.randrange(200)), rng.choice(names), rng.choice(names)] for _ in range(rng.randrange(1, 7))]
        rows += [(page, "html", 0, i, cells) for i, cells in enumerate([header, *body])]
    return spark.createDataFrame(rows, GRID)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "index")
    search.write_search_index(corpus, path)
    return path


QUERIES = ["ánna", " CARLA ", "household \n 1", "ld \n 17", "two\nlines", "key name", "o", "9 ", "\n", "nowhere at all", "", "x \n", "bob \n 1 \n "]


@pytest.mark.parametrize("query", QUERIES)
def test_indexed_search_is_the_same_search(spark, corpus, index, query):
    tables = list_tables(corpus)
    want = sorted(str(r.page_id) for r in search_tables(tables, corpus, query).collect())
    got = sorted(str(r.page_id) for r in search.search_index(spark, index, tables, query).collect())
    assert got == want


def test_search_finds_tables_without_rows(spark, corpus, index):
    other = list_tables(spark.createDataFrame([(999, "html", 0, i, c) for i, c in enumerate([["Lonely", "b"], ["v", "w"]])], GRID))
    tables = list_tables(corpus).unionByName(other)
    assert [r.page_id for r in search.search_index(spark, index, tables, "lonely").collect()] == [999]


def test_search_reads_candidate_tables_only(spark, index):
    grams = search.query_trigrams("carla")
    rows = search.candidate_rows(spark, index, search.candidate_tables(spark, index, grams))
    plan = plan_of(rows)
    assert "PartitionFilters: [" in plan and "In(no, [" in plan  # both reach the scan of the row texts
    lists = plan_of(search.candidate_tables(spark, index, grams))
    assert "In(gram, [" in lists and "share" in lists
    everything = spark.read.parquet(f"{index}/rows")
    assert 0 < rows.select("no").distinct().count() < everything.select("no").distinct().count()


def test_postings_hold_sorted_distinct_tables(spark, index):
    for r in spark.read.parquet(f"{index}/postings").collect():
        assert r.tables == sorted(set(r.tables)) and len(r.gram) == 3


def test_query_trigrams_stop_at_row_ends():
    assert search.query_trigrams("household \n 1 r") == sorted({"hou", "ous", "use", "seh", "eho", "hol", "old", "1 r"})
    assert search.query_trigrams("ab") == [] and search.query_trigrams("a\n\nb") == []


@pytest.fixture(scope="module")
def typed(spark):
    rng = random.Random(9)
    rows = []
    for page in [None, *range(30)]:
        table = [["Price", "Day", "What"]]
        for _ in range(rng.randrange(1, 40)):
            day = "not yet" if page == 7 and rng.random() < 0.2 else f"{rng.randrange(1, 29):02d}/0{rng.randrange(1, 10)}/{rng.randrange(2015, 2025)}"
            row = [rng.choice(["$ 1.200,50", "$ 15,00", "$ 99.000,00", ""]), day, rng.choice("abc")]
            table.append(row[: rng.choice([3, 3, 3, 0])])
        rows += [(page, "html", 0, i, cells) for i, cells in enumerate(table)]
    return spark.createDataFrame(rows, GRID)


SPECS = [
    {0: {"type": "numeric", "min": "1000"}},
    {0: {"type": "numeric", "max": 15}, 2: {"type": "categorical", "selected": ["a", "b"]}},
    {1: {"type": "date", "from": "2019-01-01", "to": "2021-06-30"}},
    {0: {"type": "numeric", "min": "0"}, 1: {"type": "date", "to": "2018-01-01"}, 2: {"type": "categorical", "text": "C"}},
    {0: {"type": "numeric", "min": ""}},
]


@pytest.fixture(scope="module")
def stored(typed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sidecar") / "typed")
    sidecar.write_sidecar(typed, infer_types(typed), path, row_group=1024)
    return path


def fitting(typed, spec):
    """Tables whose columns are typed as the filter says, where both ways of filtering mean the same."""
    kinds = {(r.page_id, r.col_idx): r.type for r in infer_types(typed).collect()}
    wanted = {"numeric": ("numeric", "money", "rate"), "date": ("date",)}
    pages = {r.page_id for r in typed.select("page_id").distinct().collect()}
    return {p for p in pages if all(kinds.get((p, i)) in wanted[s["type"]] for i, s in spec.items() if s["type"] in wanted)}


@pytest.mark.parametrize("spec", SPECS, ids=range(len(SPECS)))
def test_sidecar_filters_as_parsing_does(typed, stored, spec):
    pages = fitting(typed, spec)
    want = {(r.page_id, r.row_idx) for r in filter_grid(typed, spec, {0: ","}).collect() if r.page_id in pages}
    got = {(r.page_id, r.row_idx) for r in sidecar.filter_with_sidecar(typed, stored, spec).collect()}
    assert {x for x in got if x[0] in pages} == want
    assert {x for x in got if x[0] not in pages} == {(r.page_id, 0) for r in typed.where("row_idx = 0").collect() if r.page_id not in pages} or spec == SPECS[4]


def test_sidecar_ranges_reach_the_scan(spark, typed, stored):
    rows = sidecar.passing_rows(spark, stored, 0, {"type": "numeric", "min": "50000"})
    plan = plan_of(rows)
    assert "EqualTo(col_idx,0)" in plan and "GreaterThanOrEqual(num,50000.0)" in plan
    rows.collect()

    def scanned(node):
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        return scanned(node.children().apply(0))

    executed = rows._jdf.queryExecution().executedPlan()
    executed = executed.executedPlan() if executed.nodeName().startswith("Adaptive") else executed
    assert 0 < rows.count() <= scanned(executed) < spark.read.parquet(stored).count() / 2


STATES = {
    "a": ViewSpec(filters={"Price": {"type": "numeric", "min": "10"}, "What": {"type": "categorical", "selected": ["a", "c"]}}, sort={"column": "Price", "direction": "desc"}, stats={"Price": "sum", "What": "mode"}),
    "b": ViewSpec(filters={"Day": {"type": "date", "from": "2018-05-01"}}, sort={"column": "What", "direction": "desc"}, stats={"Day": "range"}),
    "c": ViewSpec(sort={"column": "What", "direction": "asc"}, stats={"What": "unique"}),
    "d": ViewSpec(filters={"What": {"type": "categorical", "text": " B "}, "Price": {"type": "numeric", "max": ""}}),
}


def test_saved_views_do_what_single_views_do(spark, typed):
    marks = {r.page_id: r.fingerprint for r in fingerprints(typed).collect()}
    pages = [3, 12, None]
    saved = []
    for page in pages:
        for name, spec in STATES.items():
            spec.types = {"Price": "money", "Day": "date", "What": "categorical"}
            spec.formats, spec.fingerprint = {"Price": {"thousand": ".", "decimal": ","}}, marks[page]
            saved.append((f"{name}{page}", spec.to_json()))
    saved += [("none", json.dumps({"fingerprint": "no such table"})), ("broken", "{"), ("null", None)]
    applied = apply_saved_views(typed, spark.createDataFrame(saved, "view_id string, state string"))
    rows = {}
    for r in applied.positioned().collect():
        rows.setdefault((r.view_id, r.page_id), []).append((r.pos, r.row_idx))
    stats = {(r.view_id, r.page_id, r.header, r.stat): (r.num_value, r.text_value) for r in applied.stats().collect()}
    expected = {}
    for page in pages:
        twins = [p for p in marks if marks[p] == marks[page]]
        assert twins == [page]
        for name, spec in STATES.items():
            if page is None:
                continue
            view = apply_view(open_table(typed, page, 0), spec)
            got = sorted((r.pos, r.row_idx) for r in view.positioned().collect())
            assert sorted(rows.get((f"{name}{page}", page), [])) == got, (name, page)
            if got:
                expected.update({(f"{name}{page}", page, r.header, r.stat): (r.num_value, r.text_value) for r in view.stats.collect() if r.header in spec.stats})
    assert any(page is None for _, page in rows)
    for key, (number, text) in expected.items():
        mine = stats.pop(key)
        assert mine[1] == text and (mine[0] == number or abs(mine[0] - number) < 1e-9 * abs(number)), key
    assert all(page is None for _, page, *_ in stats)


def test_one_plan_for_any_number_of_views(spark, typed):
    plans = []
    for n in (1, 50):
        saved = spark.createDataFrame([(f"v{i}", STATES["a"].to_json()) for i in range(n)], "view_id string, state string")
        plan = apply_saved_views(typed, saved).rows()._jdf.queryExecution().optimizedPlan().toString()
        plans.append(plan.count("Join"))
    assert plans[0] == plans[1]


def test_rows_meet_their_views_in_one_join(spark, typed, monkeypatch):
    """No pass over the rows for each predicate, and none that groups them by row."""
    marks = {r.page_id: r.fingerprint for r in fingerprints(typed).collect()}
    saved = []
    for page in (3, 12):
        for name, spec in STATES.items():
            spec.fingerprint = marks[page]
            saved.append((f"{name}{page}", spec.to_json()))
    applied = apply_saved_views(typed, spark.createDataFrame(saved, "view_id string, state string"))
    attached = []
    attach = saved_views.attach
    monkeypatch.setattr(saved_views, "attach", lambda rows, facts: attached.append(facts) or attach(rows, facts))
    plan = applied.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert len(attached) == 1 and not [line for line in plan.splitlines() if "Aggregate" in line and "row_idx" in line]
    applied.stats()
    assert len(attached) == 2
    for facts in attached:
        assert facts.count() == facts.select("view_id", *KEY).distinct().count()


def test_views_and_rows_that_come_twice(spark, make_grid):
    """A view saved twice keeps a row once for its predicates; without predicates, once for each; its stats count both."""
    grid = make_grid({1: [["k", "k", "v"], ["a", "x", "1"], ["b", "a", "2"], ["a", "y", "30"]]})
    mark = fingerprints(grid).first().fingerprint
    some = ViewSpec(filters={"k": {"type": "categorical", "selected": ["a"]}, "v": {"type": "numeric", "max": "9"}}, stats={"v": "count", "k": "unique"}, types={"v": "numeric"}, fingerprint=mark)
    none = ViewSpec(filters={"gone": {"type": "numeric", "min": "1"}}, stats={"v": "count"}, fingerprint=mark)
    every = ViewSpec(stats={"v": "max"}, types={"v": "numeric"}, fingerprint=mark)
    saved = [("some", some), ("some", some), ("none", none), ("every", every), ("every", every), (None, some)]
    applied = apply_saved_views(grid, spark.createDataFrame([(i, v.to_json()) for i, v in saved], "view_id string, state string"))
    assert sorted(((r.view_id or "", r.row_idx) for r in applied.rows().collect())) == [("", i) for i in (1, 2, 3)] + [("every", i) for i in (1, 1, 2, 2, 3, 3)] + [("some", 1)]
    found = {(r.view_id, r.header, r.stat): r.num_value for r in applied.stats().collect()}
    assert found == {("some", "v", "count"): 8.0, ("some", "k", "unique"): 1.0, ("every", "v", "max"): 30.0}


def test_null_keys_are_keys(spark, corpus, tmp_path):
    tables = list_tables(corpus)
    found = search_tables(tables, corpus, "col none").collect()
    assert [r.page_id for r in found] == [None]
    ids = spark.createDataFrame([(None, 1), ("a", 2)], "table_id string, position int")
    assert merge_tables(ids, ids).count() == 2
    pins = spark.createDataFrame([(None, "html", 0, 0, "categorical", None, None)], "page_id long, kind string, table_idx int, col_idx int, type string, thousand string, decimal string")
    pinned = infer_types(corpus, overrides=pins).where("page_id IS NULL AND col_idx = 0").first()
    assert pinned.type == "categorical"
    listed = tables.withColumn("position", tables["rank"])
    manifest = export_all(corpus, listed, str(tmp_path / "out"), "2024-01-31", folders=False)
    lines = spark.read.parquet(str(tmp_path / "out" / "tables"))
    assert manifest.where("page_id IS NULL").count() == 1
    assert lines.where("page_id IS NULL").count() == corpus.where("page_id IS NULL").count()
