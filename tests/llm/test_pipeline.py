"""The pipeline stage by stage, and every numbered query over whole tables."""

import re
from collections import Counter

import pytest
from gridlake.llm import pii, queries

import corpus_pipeline

from .conftest import prose
from .test_duplicates import components, shingles, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(awkward, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    awkward.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "personal_data", "packing"]


def test_stages_on_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder)  # only neutral labels: nothing goes
    assert clean.columns == columns and clean.count() == docs.count()
    assert Counter(clean.collect()) == Counter(docs.collect())

    kept = stages["near_duplicates"](spark, clean, folder)
    rows = [r for r in clean.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    least = components(sets, links)
    assert {r.doc_id for r in kept.collect()} == {d for d in sets if least[d] == d} | {None}
    assert kept.columns == columns

    thinned = stages["substring_dedup"](spark, kept, folder)
    assert thinned.columns == columns
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (kept, thinned))
    seen = Counter(tuple(w[i : i + 35]) for t in (r.text for r in kept.collect()) for w in [words(t)] for i in range(len(w) - 34))
    for doc_id, text in before.items():
        w = words(text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert after[doc_id] == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else text)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in thinned.collect())

    masked = stages["personal_data"](spark, thinned, folder)
    assert masked.columns == columns
    finder = pii.Finder()
    for r in masked.collect():
        text = after[r.doc_id] or ""
        assert (r.text or "") == pii.redact(text, finder.find(text))
        assert not re.search(r"[a-z]@[a-z]+\.[a-z]", r.text or "")

    packed = stages["packing"](spark, masked, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked.collect()}


def test_one_row_of_each_group_of_near_duplicates_stays(spark, awkward, folder):
    """Repeated rows, copies without an id and ids with several texts, by rows and not by ids."""
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, awkward, folder)
    assert Counter(r.doc_id for r in kept.collect())[9] == 1

    one, two, three, four = (prose(i, 130) for i in (301, 302, 303, 304))
    rows = [(None, one), (None, one), (5, two), (None, two), (6, three), (6, three), (6, four), (3, four), (None, ""), (None, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = stages["near_duplicates"](spark, docs, folder)
    want = Counter([(None, one), (5, two), (6, three), (3, four), (None, ""), (None, ""), (8, None)])
    assert Counter(map(tuple, kept.collect())) == want
    thinned = stages["substring_dedup"](spark, kept, folder)
    assert Counter(map(tuple, thinned.collect())) == want


def test_run_over_no_rows(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    rows = [(i, f"plain words number {i} {'vexnort' if i % 4 == 0 else 'calm'}", "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 4}


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_queries_cover_whole_tables(spark, name):
    got = queries.REGISTRY[name](spark, SF)
    operator = name.split("_")[0]
    table, key = ("embeddings", "vec_id") if operator in ("op8", "op11", "op13") else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    if operator == "op13":  # a search answers the rows that ask
        key, want = "query_id", {i for i in want if i % 20 == 0}
    rows = [r[0] for r in got.select(key).collect()]
    assert set(rows) == want
    each = {"op11": 8, "op13": 20}.get(operator, 1)
    if operator != "op10":
        assert len(rows) == each * len(want)
