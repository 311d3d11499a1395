"""Near copies of vectors by a pivot-permutation index.

Vectors of each length are indexed apart, since only vectors of one length have a cosine.
Reference points (pivots) far from one another come from a bounded sample of the vectors.
Every vector is described by its ``nearest`` pivots, nearest first.  The inverted lists are
keyed by two pivots, so that vectors in one list share at least two: the shared-pivot count
is what admits a pair.  Pairs of a list are verified by cosine in double precision, in
blocks; a pair that meets in several lists counts in the list of its two least shared pivots.

Equal vectors are one class and are indexed once, with their number, under a row number: ids
may be null.  Lengths with at most ``FEWEST`` classes have one list; each other length takes a
sample of its own.  A list longer than
``BLOCK`` is cut into blocks and compared block by block in separate groups, so no list is
gathered whole.  A group returns a row per vector (links and the least vector it reaches
there), not a row per pair.

Defined results: vectors that are null, empty, zero or with null or non-finite components link
with nothing; a null id stays null, its row counts as a link and is never the least id; repeated rows are copies;
an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .components import connected

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: pivots per vector in its description
NEAREST = 6
#: pivots: this many times the root of the number of vectors, within these bounds
PER_ROOT, FEWEST, MOST = 2, 48, 8192
#: vectors sampled for each pivot; sampled ones closer than APART to a pivot are no pivots
SAMPLED, APART = 4, 0.6
BLOCK = 256


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors of the sample, no two with a cosine above ``APART``."""
    chosen: list[int] = []
    for i in range(len(sample)):
        if len(chosen) == count:
            break
        if not chosen or (sample[chosen] @ sample[i]).max() < APART:
            chosen.append(i)
    return sample[chosen]


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _describer(pivots: dict[int, np.ndarray], nearest: int):
    """Nearest pivots of each vector; lengths without two pivots have one list, that of 0 and 1."""

    def describe(part: pa.RecordBatch, width: int) -> pa.RecordBatch:
        known = pivots.get(width)
        if known is None or min(len(known), nearest) < 2:
            order = np.tile(np.array([0, 1], np.int32), (part.num_rows, 1))
        else:
            near = np.argsort(-(_unit(_matrix(part.column(3), width)) @ known.T), axis=1, kind="stable")[:, :nearest]
            order = near.astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                *part.columns,
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel())
                ),
            ],
            names=["rep", "copies", "width", "vector", "pivots"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                widths = part.column(2).to_numpy()
                for width in np.unique(widths).tolist():
                    yield describe(part.filter(pa.array(widths == width)), width)

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component under links a - b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verifier(least: float):
    """Links of each group (one list, two blocks of it): rows of a vector, its links and its root."""

    def group(low, high, ids, copies, vectors, pivots, side) -> tuple | None:
        unit = _unit(vectors)
        near = unit @ unit.T >= least
        if side.any():  # two blocks: only pairs across
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        if not len(a):
            return None
        ranked = np.sort(pivots, axis=1)
        keep = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 16):
            x, y = ranked[a[k : k + (1 << 16)]], ranked[b[k : k + (1 << 16)]]
            shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
            first = shared.argmax(axis=1)
            rows = np.arange(len(x))
            shared[rows, first] = False
            keep[k : k + (1 << 16)] = (x[rows, first] == low) & (x[rows, shared.argmax(axis=1)] == high)
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        order = np.argsort(ids, kind="stable")  # labels by rank of id, so that the root is the least id
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order][_roots(len(ids), rank[a], rank[b])[rank]]
        hit = links > 0
        return ids[hit], links[hit].astype(np.int64), root[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*rows)], names=["rep", "links", "root"]
            )

        held: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            """Whole groups of a table sorted by group; the last one may go on in the next batch."""
            keys = np.stack([table.column(c).to_numpy() for c in range(5)], axis=1)
            edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            stops = np.append(edges[1:], len(keys))
            if not last:
                edges, stops = edges[:-1], stops[:-1]
            done = int(stops[-1]) if len(stops) else 0
            part = table.slice(0, done).combine_chunks()
            found = []
            if done:
                side, ids, copies = (part.column(i).to_numpy() for i in (5, 6, 7))
                vectors, pivots = (part.column(i).combine_chunks() for i in (8, 9))
                numbers, order = np.asarray(vectors.flatten(), np.float64), np.asarray(pivots.flatten())
                first, first_pivot = (np.asarray(x.offsets) - x.offsets[0].as_py() for x in (vectors, pivots))
                for a, b in zip(edges, stops):
                    if b - a > 1:  # the vectors of a group have one length
                        low, high = keys[a][1], keys[a][2]
                        rows = numbers[first[a] : first[b]].reshape(b - a, -1)
                        near = order[first_pivot[a] : first_pivot[b]].reshape(b - a, -1)
                        got = group(low, high, ids[a:b], copies[a:b], rows, near, side[a:b])
                        if got:
                            found.append(got)
            return found, table.slice(done)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            found, held = groups(held, False)
            if found:
                yield flush(found)
        if held is not None and held.num_rows:
            found, _ = groups(held, True)
            if found:
                yield flush(found)

    return run


def near_vectors(
    vectors: DataFrame, least: float = 0.95, nearest: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; ``kept`` marks the least id of a component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    valid = (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    classes = rows.where("valid").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # row numbers are fixed once written
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "least", "copies", F.size("vector").alias("width"), "vector")
    classes = stage(classes, "classes")
    pivots = {}
    for width, n in classes.groupBy("width").count().where(F.col("count") > FEWEST).collect():
        count = min(MOST, max(FEWEST, ceil(PER_ROOT * sqrt(n))))
        sample = classes.where(F.col("width") == width).orderBy(F.xxhash64("least"), "least", F.xxhash64("vector"))
        sample = sample.limit(SAMPLED * count).select("vector").collect()
        pivots[width] = choose_pivots(_unit(np.array([r[0] for r in sample], np.float64)), count)
    kind = classes.schema["vector"].dataType.simpleString()
    described = stage(
        classes.drop("least").mapInArrow(
            _describer(pivots, nearest), f"rep long, copies long, width int, vector {kind}, pivots array<int>"
        ),
        "described",
    )
    most = max(2, nearest)
    pairs = F.array(
        *(
            F.when(
                F.get("pivots", F.lit(j)).isNotNull(),
                F.struct(
                    F.least(F.get("pivots", F.lit(i)), F.get("pivots", F.lit(j))).alias("low"),
                    F.greatest(F.get("pivots", F.lit(i)), F.get("pivots", F.lit(j))).alias("high"),
                ),
            )
            for i in range(most)
            for j in range(i + 1, most)
        )
    )
    pairs = F.filter(pairs, lambda pair: pair.isNotNull())
    listed = described.select("*", F.inline(pairs))
    sizes = listed.groupBy("width", "low", "high").count().where("count > 1")
    sizes = sizes.select("width", "low", "high", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    cells = listed.join(sizes, ["width", "low", "high"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "width",
        "low",
        "high",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "rep",
        "copies",
        "vector",
        "pivots",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ("width", "low", "high", "i", "j")
    cells = cells.repartition(parts, *keys).sortWithinPartitions(*keys)
    links = stage(cells.mapInArrow(_verifier(least), "rep long, links long, root long"), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    members = components.select(F.col("node").alias("rep"), "component")
    named = members.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    classes = (
        classes.join(counts, "rep", "left")
        .join(members.join(named, "component").select("rep", "component_id"), "rep", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least").alias("component_id"),
        )
    )
    linked = rows.where("valid").join(classes, "vector", "left").select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    every = linked.unionAll(alone).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return every.withColumn("kept", F.col("vec_id") == F.col("component_id"))
