"""Exact inner-product search by a vector-approximation file.

Components become integers, ``floor(scale * x)``.  Equal vectors are one class.  The file holds each class
as one cell number per dimension; a cell is a range of integers, so the cells of a vector bound its inner product
with a query from above and below.  Cell borders come from a bounded sample, but the outer cells of a block
reach to the block's own extremes, so the bounds hold for every vector.

Each block of queries scans the cells of a stripe of the file and keeps, per query, what can still be among its best: its
upper bound reaches the lower bound of enough others.  The highest such threshold of all stripes
holds everywhere.  Exact vectors are then read in the order of their bounds, in two waves: the first few of each
query, whose scores fix the ``k``-th result, and whatever else is bounded above it.  What is left out is certain
not to be a result, so the answer is exact whatever the sample.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do vectors with a component
so large (beyond the root of 2**62 over the length) that scores would not fit a long; vectors of different lengths have no score and
never meet.  Ties go to the smaller id, a null id comes last; a row without an id is no query.  A query's own row is left out, rows that
repeat it are not.  Repeated queries are answered each.  An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: cells per dimension are 2 ** BITS at most; vectors sampled to place their borders
BITS, SAMPLED = 6, 16_384
#: classes in a block of the file, blocks in a stripe, queries in a block
BLOCK, STRIPE, QUERIES = 4096, 16, 512
#: partitions for the grid of turns and stripes at most
GRID = 100_000

FILE = "block long, width int, n int, reps binary, cells binary, low binary, high binary"
ASKED = "block long, width int, n int, reps binary, vectors binary"


def cell_borders(sample: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Per dimension the highest integers of all cells but the last, about evenly filled by the sample."""
    at = np.linspace(0, len(sample) - 1, (1 << bits) + 1)[1:-1].astype(np.int64)
    return [np.unique(column[at]) for column in np.sort(sample, axis=0).T]


def cells_of(vectors: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, x, "left") for b, x in zip(borders, vectors.T)], axis=1).astype(np.uint8)


def cell_ranges(
    cells: np.ndarray, borders: list[np.ndarray], low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer of every cell, no wider than the extremes of the block."""
    least, most = np.empty(cells.shape, np.float64), np.empty(cells.shape, np.float64)
    for j, b in enumerate(borders):
        least[:, j] = np.maximum(np.append(low[j], b + 1), low[j])[cells[:, j]]
        most[:, j] = np.minimum(np.append(b, high[j]), high[j])[cells[:, j]]
    return least, most


def score_bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products; widened where sums may not be exact in floating point."""
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    reach = np.maximum(np.abs(least), np.abs(most)).max(initial=0.0) * np.abs(queries).sum(axis=1).max(initial=0.0)
    slack = 0.0
    if reach < 1 << 24:  # integers of this size are exact in single precision
        up, down, least, most = (x.astype(np.float32) for x in (up, down, least, most))
    elif reach >= 1 << 53:
        slack = reach * queries.shape[1] * 2.0**-50
    return up @ least.T + down @ most.T - slack, up @ most.T + down @ least.T + slack


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _by_width(batches: Iterator[pa.RecordBatch], most: int):
    """Classes of one length, around ``most`` together: width, their numbers, their vectors."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        widths = batch.column(1).to_numpy()
        for width in np.unique(widths).tolist():
            part = batch.filter(pa.array(widths == width))
            for k in range(0, part.num_rows, most):
                some = part.slice(k, most)
                held.setdefault(width, []).append((some.column(0).to_numpy(), _rows(some.column(2), width)))
                if sum(len(r) for r, _ in held[width]) >= 2 * most:
                    yield width, *(np.concatenate(x) for x in zip(*held.pop(width)))
    for width, parts in held.items():
        yield width, *(np.concatenate(x) for x in zip(*parts))


def _filer(borders: dict[int, list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for width, reps, vectors in _by_width(batches, BLOCK):
            columns = [
                [number],
                [width],
                [len(reps)],
                [reps.tobytes()],
                [cells_of(vectors, borders[width]).tobytes()],
                [vectors.min(axis=0).tobytes()],
                [vectors.max(axis=0).tobytes()],
            ]
            types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_names(FILE))
            number += 1

    return run


def _asker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for width, reps, vectors in _by_width(batches, QUERIES):
        columns = [[number], [width], [len(reps)], [reps.tobytes()], [vectors.tobytes()]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_names(ASKED))
        number += 1


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _scanner(borders: dict[int, list[np.ndarray]], enough: int):
    """Rows of one block of queries and one stripe, the queries first: a row per query with what its stripe leaves open."""

    def scan(width, asked, blocks) -> pa.RecordBatch:
        reps = np.frombuffer(asked["reps"], np.int64)
        queries = np.frombuffer(asked["vectors"], np.int64).reshape(-1, width).astype(np.float64)
        best = np.full((len(reps), enough), -np.inf)
        found = []
        for row in blocks:
            names = np.frombuffer(row["reps"], np.int64)
            cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, width)
            low, high = (np.frombuffer(row[c], np.int64) for c in ("low", "high"))
            under, over = score_bounds(queries, *cell_ranges(cells, borders[width], low, high))
            best = -np.partition(-np.concatenate([best, under], axis=1), enough - 1, axis=1)[:, :enough]
            q, c = np.nonzero(over >= best.min(axis=1, keepdims=True))
            found.append((q, names[c], over[q, c].astype(np.float64)))
        threshold = best.min(axis=1)
        q, names, bounds = (np.concatenate(x) for x in zip(*found))
        keep = bounds >= threshold[q]
        q, names, bounds = q[keep], names[keep], bounds[keep]
        order = np.argsort(q, kind="stable")
        offsets = pa.array(np.searchsorted(q[order], np.arange(len(reps) + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(reps),
                pa.array(threshold),
                pa.ListArray.from_arrays(offsets, pa.array(names[order])),
                pa.ListArray.from_arrays(offsets, pa.array(bounds[order])),
            ],
            names=["query", "threshold", "reps", "bounds"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, blocks = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            for row in asked:
                same = [b for b in blocks if b["width"] == row["width"]]
                if same:
                    yield scan(row["width"], row, same)

        # a cell of the grid holds STRIPE blocks of the file or so, and a block of queries or two
        for row in (row for batch in batches for row in _each(batch)):
            if key != (row["turn"], row["stripe"]):
                yield from done()
                key, asked, blocks = (row["turn"], row["stripe"]), [], []
            (blocks if row["vectors"] is None else asked).append(row)
        yield from done()

    return run


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def integer_vectors(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null where the vector takes no part."""
    limit = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size(vector)))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= limit))
    return F.when((F.size(vector) > 0) & fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _search_file(classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``query, rep, bound`` of the classes that can be among the ``k + 1`` best of a class that asks."""
    borders = {}
    for row in classes.groupBy("width").count().collect():  # a row per length of vector
        sample = classes.where(F.col("width") == row.width).orderBy(F.xxhash64("vector"), "rep").limit(SAMPLED).select("vector")
        borders[row.width] = cell_borders(np.array([r[0] for r in sample.toLocalIterator()], np.int64))
    columns = ("rep", "width", "vector")
    n_blocks = classes.count() // BLOCK + 1
    filed = stage(classes.select(*columns).repartition(n_blocks).mapInArrow(_filer(borders), FILE), "cells")
    turns = wanted.count() // QUERIES + 1
    asked = stage(wanted.select(*columns).repartition(turns).mapInArrow(_asker, ASKED), "asked")
    # blocks are numbered by the task that wrote them: a grid of turns of queries and stripes of the file
    stripes = (n_blocks - 1) // STRIPE + 1
    task = F.shiftright("block", 32)
    none = F.lit(None).cast("binary")
    cells = filed.select(F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), (task % stripes).cast("int").alias("stripe"), "*")
    cells = cells.select("turn", "stripe", "width", "reps", "cells", "low", "high", none.alias("vectors"))
    ask = asked.select((task % turns).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), "*")
    ask = ask.select("turn", "stripe", "width", "reps", none.alias("cells"), none.alias("low"), none.alias("high"), "vectors")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(turns * stripes, GRID))
    scans = cells.unionAll(ask).repartition(parts, "turn", "stripe").sortWithinPartitions("turn", "stripe")
    found = scans.mapInArrow(_scanner(borders, k + 1), "query long, threshold double, reps array<long>, bounds array<double>")
    holds = Window.partitionBy("query")
    found = stage(found, "found").withColumn("threshold", F.max("threshold").over(holds))
    left = F.filter(F.arrays_zip("reps", "bounds"), lambda x: x.bounds >= F.col("threshold"))
    return found.select("query", F.explode(left).alias("x")).select("query", F.col("x.reps").alias("rep"), F.col("x.bounds").alias("bound"))


def _scored(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs with their exact scores and what the class on the right holds."""
    queries = classes.select(F.col("rep").alias("query"), F.col("vector").alias("asked"))
    product = F.aggregate(F.zip_with("asked", "vector", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = pairs.join(classes.select("rep", "vector", "members"), "rep").join(queries, "query")
    return exact.select("query", "rep", product.alias("score"), "members")


def top_k(
    vectors: DataFrame, asks: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest integer inner product for each row where ``asks`` holds.

    ``asks`` is a condition on ``vec_id``.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.select("vec_id", integer_vectors(F.col("vector"), scale).alias("vector")).where("vector IS NOT NULL")
    # row numbers are fixed once written
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", asks.alias("asks")), "rows")
    # of equal vectors the k + 1 first are enough for any answer: one may be the query itself
    first = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    members = F.sort_array(F.collect_list(F.struct("nth", "vec_id", "row")))
    classes = first.groupBy("vector").agg(members.alias("members"))
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), F.size("vector").alias("width"), "vector", "members")
    classes = stage(classes, "classes")
    asking = rows.where("asks AND vec_id IS NOT NULL").select("vec_id", "row", "vector")
    wanted = asking.select("vector").distinct().join(classes, "vector")
    open_pairs = stage(_search_file(classes, wanted, k), "open")

    in_order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "rep")
    ordered = open_pairs.withColumn("nth", F.row_number().over(in_order))
    first_wave = ordered.where(F.col("nth") <= 2 * (k + 1)).select("query", "rep")
    first_wave = stage(_scored(first_wave, classes), "first_wave")
    kth = Window.partitionBy("query").orderBy(F.col("score").desc())
    certain = first_wave.withColumn("nth", F.row_number().over(kth)).where(F.col("nth") == k + 1).select("query", "score")
    second_wave = open_pairs.join(first_wave.select("query", "rep"), ["query", "rep"], "left_anti")
    second_wave = second_wave.join(certain, "query").where("bound >= score").select("query", "rep")
    every = first_wave.unionAll(_scored(second_wave, classes))

    # the k + 1 classes of highest score hold the k best rows, for each has a row that goes before all of the next
    least = F.col("members")[0]
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), least.vec_id.asc_nulls_last(), least.row)
    best = every.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    one = F.transform("members", lambda m: F.struct((-F.col("score")).alias("down"), m.vec_id.isNull().alias("none"), m.vec_id, m.row))
    answers = best.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list(one))).alias("answers"))
    answers = answers.join(classes.select(F.col("rep").alias("query"), "vector"), "query").select("vector", "answers")
    told = asking.withColumnsRenamed({"vec_id": "query_id", "row": "own"}).join(answers, "vector")
    others = F.slice(F.filter("answers", lambda x: x.row != F.col("own")), 1, k)
    told = told.select("query_id", F.posexplode(others).alias("pos", "x"))
    return told.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.down")).alias("score"))
