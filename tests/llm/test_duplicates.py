"""Near duplicates, repeated passages and near vectors against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from gridlake.llm import ngram_join, pivots, recompression
from gridlake.llm.components import connected

from .conftest import prose


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def check_near(docs, percent=80):
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = components(ids, links)
    got = ngram_join.near_duplicates(docs, 5, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r.doc_id
    return links


def test_near_duplicates_awkward(awkward):
    check_near(awkward)


def test_near_duplicates_random_edits(spark):
    rng = random.Random(3)
    rows = []
    for group in range(12):
        base = prose(group, rng.choice([6, 30, 80, 200]), 5000).split()
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check_near(docs)


def test_near_duplicates_large_group_and_common_passage(spark):
    """A group above the count that blocks send as occurrences, and a passage in most texts."""
    rng = random.Random(4)
    base = prose(77, 150, 5000).split()
    common = prose(78, 25, 5000)
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, f"{common} {prose(1000 + i, 8, 5000)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(check_near(docs)) > 1000


def test_near_duplicates_of_nothing(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


def check_repeats(docs, size):
    rows = [(r.doc_id, words(r.text)) for r in docs.select("doc_id", "text").collect()]
    seen = Counter(tuple(w[i : i + size]) for _, w in rows for i in range(len(w) - size + 1))
    want = Counter()
    for doc_id, w in rows:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        want[(doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    got = recompression.remove_repeats(docs, size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


def test_repeats_awkward(awkward):
    check_repeats(awkward, 35)


@pytest.mark.parametrize("size", [2, 7, 35])
def test_repeats_random_passages(spark, size):
    rng = random.Random(size)
    passages = [prose(900 + i, rng.randrange(size - 1, 3 * size), 3000) for i in range(10)]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randrange(0, 60), 3000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(1000 * i, rng.randrange(0, 20), 3000)]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a " * 3 * size), (101, "a " * (size + 1)), (102, "b " * size), (103, "a b " * size)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), size)


def test_symbols_depend_on_their_words_only():
    rng = np.random.default_rng(8)
    passage = rng.integers(0, 5, 80).astype(np.uint64) + np.uint64(9)
    left = np.concatenate([rng.integers(50, 99, 30).astype(np.uint64), passage, rng.integers(50, 99, 40).astype(np.uint64)])
    right = np.concatenate([rng.integers(50, 99, 57).astype(np.uint64), passage, rng.integers(50, 99, 3).astype(np.uint64)])
    names = [recompression.anchors(x, np.zeros(len(x), np.int64), 35)[0] for x in (left, right)]
    assert (names[0][30 : 30 + 46] == names[1][57 : 57 + 46]).all()


def test_repeats_keep_columns_and_nothing(spark, no_docs, awkward):
    keep = [c for c in awkward.columns if c != "text"]
    out = recompression.remove_repeats(awkward, keep=keep)
    assert out.columns == ["text", *keep, "n_words", "n_removed", "kept"]
    assert out.count() == awkward.count()
    assert recompression.remove_repeats(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 620)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(links)
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = []
    for c in centres:
        for _ in range(rng.integers(1, 12)):
            rows.append((c + rng.normal(size=24) * rng.choice([0.01, 0.1, 0.2])).tolist())
    rows += [rows[0]] * 5 + [[3 * x for x in rows[1]]]
    table = [(i, v, "x") for i, v in enumerate(rows)]
    special = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf"), *[1.0] * 23], [None, *[1.0] * 23], [1.0] * 7]
    table += [(1000 + i, v, "x") for i, v in enumerate(special)] + [table[3]]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, kept string").repartition(4)
    x = np.array([v for _, v, _ in table if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)])
    ids = [i for i, v, _ in table if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = components({i for i, _, _ in table}, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = pivots.near_vectors(df).collect()
    assert len(got) == len(table)
    links = defaultdict(int, {i: int(n) for i, n in zip(ids, near.sum(axis=1))})
    right = sum(r.n_links for r in got)
    assert right >= 0.9 * near.sum()
    assert all(r.n_links <= links[r.vec_id] for r in got)
    if right == near.sum():
        assert all(r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id >= 1000)


def test_near_vectors_of_several_lengths_and_without_ids(spark):
    rng = np.random.default_rng(12)
    table = []
    for width, groups in ((16, 40), (32, 30), (5, 3), (1, 1)):
        for centre in rng.normal(size=(groups, width)):
            for _ in range(4):
                near = centre if width == 1 else centre + rng.normal(size=width) * 0.01
                table.append((len(table), near.tolist()))
    table += [(None, [x * 1.001 for x in v]) for _, v in table[:3]]
    table += [(None, [1000.0 + x for x in range(9)]), (None, [1000.0 + x for x in range(9)]), (None, [1000.5 + x for x in range(9)])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(4)

    def near(a, b):
        return len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95

    links = [[j for j, (_, b) in enumerate(table) if j != i and near(a, b)] for i, (_, a) in enumerate(table)]
    root = components(range(len(table)), [(i, j) for i, own in enumerate(links) for j in own])
    least = {}
    for i, (vec_id, _) in enumerate(table):
        if vec_id is not None:
            least[root[i]] = min(vec_id, least.get(root[i], vec_id))
    want = Counter((vec_id, len(links[i]), least.get(root[i])) for i, (vec_id, _) in enumerate(table))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()) == want


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivots.near_vectors(empty).count() == 0


