"""Near-duplicate texts: an exact Jaccard join of word n-gram sets.

1. A scan turns texts into sets of 48-bit n-gram names and sends them, packed, to the share
   of all names they belong to.  There the number of texts of every name is counted; names in
   one text only go no further.  What is left returns to its block of texts, so that every
   text has its shared names in rare-first order.  A name that a block holds often is sent as
   a count, so a name in a third of all texts costs a few bytes per block.
2. Texts with equal sets are one class and go on once.
3. The first ``n - ceil(t n) + 1`` names of a set are its prefix; two sets that reach
   similarity t share a prefix name.  Pairs that share one pass the length, positional and
   suffix filters, and are verified once.
4. Large groups: for every prefix name, one member is compared with the others, twice, with
   another member each time.  What links joins one component; only pairs across components
   are left to compare.  A group of n near copies so costs about n comparisons, and no link
   between components is lost.

Defined results: null, empty and blank texts have no names and link with nothing; a text of
fewer words than ``n`` is one name; repeated rows are one class; a null id is a row of its
own class like any other, never the smallest id; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage, stages_removed
from .arrow import forget, give_back, slices
from .components import connected
from .words import FOLD, find_words, hash_spans, hash_windows, mix, pack_planes, text_bytes, unpack_planes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2 << 20
NAME = 6
#: a name in this many texts of a block is sent as a count
OFTEN = 16
#: parity bits of a set, for the suffix filter
BITS = 512
TRAVEL = "key long, kind string, block long, payload binary"
COUNTS, SETS, KNOWN = "counts", "sets", "known"
SETS_SCHEMA = "doc_id long, text_name long, row long, n long, node long, tokens array<long>, parity array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 48-bit name) of every distinct word n-gram, sorted; letters A-Z count as a-z."""
    data = FOLD[data]
    starts, ends, text = find_words(data, offsets)
    words = hash_spans(data, starts, ends)
    whole = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
    names = [hash_windows(words, n)[whole]] if len(whole) else []
    owners = [text[whole]]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    firsts = np.cumsum(counts) - counts
    for size in range(1, n):
        few = np.flatnonzero(counts == size)
        if len(few):
            value = np.full(len(few), size, np.uint64)
            for j in range(size):
                value = mix(value * np.uint64(0x9FB21C651E98DF25) + words[firsts[few] + j])
            names.append(value)
            owners.append(few)
    if not names:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.concatenate(owners).astype(np.uint64)
    both = np.unique((owner << np.uint64(48)) | (np.concatenate(names) >> np.uint64(16)))
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, kind, block, payload = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(kind, pa.string()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())],
        names=["key", "kind", "block", "payload"],
    )


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one block as compressed Arrow; names are cut to six planes by the caller."""
    sink = pa.BufferOutputStream()
    table = pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=[str(i) for i in range(len(arrays))])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    batch = next(iter(pa.ipc.open_stream(payload)))
    return [np.frombuffer(batch.column(i)[0].as_buffer(), k) for i, k in enumerate(kinds)]


def _scan(n: int, buckets: int):
    def block_rows(block: int, ids: pa.Array, text_names: pa.Array, owner: np.ndarray, name: np.ndarray) -> Iterator[tuple]:
        texts = len(ids)
        count = np.bincount(owner, minlength=texts)
        first = np.cumsum(count) - count
        one, two = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
        full = np.flatnonzero(count)
        if len(full):
            one[full] = np.add.reduceat(mix(name + np.uint64(1)), first[full])
            two[full] = np.add.reduceat(mix(name ^ np.uint64(0x5851F42D4C957F2D)), first[full])
        node = mix(mix(one) + two + count.astype(np.uint64))
        bits = np.bincount(owner * BITS + (mix(name) % np.uint64(BITS)).astype(np.int64), minlength=texts * BITS) & 1
        parity = np.packbits(bits.astype(np.uint8), bitorder="little")
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(ranked)))
        often = sizes >= OFTEN
        local = np.repeat(often, sizes)
        yield (
            block,
            SETS,
            block,
            _pack(
                ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
                np.array(ids.is_null()).astype(np.uint8),
                text_names.to_numpy(zero_copy_only=False).astype("<i8"),
                count.astype("<u4"),
                node.astype("<u8"),
                parity,
                ranked[local].astype("<u8"),
                owner[order][local].astype("<u2"),
            ),
        )
        light, light_owner = ranked[~local], owner[order][~local]
        heavy, heavy_count = ranked[heads[often]], sizes[often]
        width = (1 << 48) // buckets + 1
        light_edges = np.searchsorted(light, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
        heavy_edges = np.searchsorted(heavy, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
        for bucket in np.flatnonzero((np.diff(light_edges) > 0) | (np.diff(heavy_edges) > 0)).tolist():
            a, b = light_edges[bucket : bucket + 2]
            c, d = heavy_edges[bucket : bucket + 2]
            payload = b"".join(
                [
                    np.array([b - a, d - c], "<u4").tobytes(),
                    pack_planes(light[a:b], NAME),
                    light_owner[a:b].astype("<u2").tobytes(),
                    pack_planes(heavy[c:d], NAME),
                    heavy_count[c:d].astype("<u4").tobytes(),
                ]
            )
            yield bucket, COUNTS, block, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part = TaskContext.get().partitionId() << 24
        for k, batch in enumerate(slices(batches, 1, BLOCK)):
            data, offsets = text_bytes(batch.column(1))
            yield _batch(list(block_rows(part + k, batch.column(0), batch.column(2), *shingles(data, offsets, n))))
        give_back()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of this task's buckets that are in two texts or more, back to their blocks."""
    light, owners, heavy, heavy_counts, blocks = [], [], [], [], []
    for batch in batches:
        others = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if row[1] != COUNTS:
                others.append(row)
                continue
            payload = row[3]
            n, m = (int(x) for x in np.frombuffer(payload, "<u4", 2))
            view, at = memoryview(payload), 8
            light.append(unpack_planes(view[at:], n, NAME))
            at += NAME * n
            owners.append(np.frombuffer(payload, "<u2", n, at))
            at += 2 * n
            heavy.append(unpack_planes(view[at:], m, NAME))
            at += NAME * m
            heavy_counts.append(np.frombuffer(payload, "<u4", m, at).astype(np.int64))
            blocks.append(row[2])
        if others:
            yield _batch(others)
    if not blocks:
        return
    every = np.sort(np.concatenate(light))
    heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    often = np.unique(np.concatenate(heavy))
    sums = np.zeros(len(often), np.int64)
    for name, count in zip(heavy, heavy_counts):
        sums[np.searchsorted(often, name)] += count
    names, counts = every[heads], np.diff(np.append(heads, len(every)))
    del every
    keep = (counts > 1) | np.isin(names, often)
    names, counts = names[keep], counts[keep]
    extra = np.zeros(len(names), np.int64)
    if len(often):
        j = np.minimum(np.searchsorted(often, names), len(often) - 1)
        extra = np.where(often[j] == names, sums[j], 0)
        if len(names):
            k = np.minimum(np.searchsorted(names, often), len(names) - 1)
            sums += np.where(names[k] == often, counts[k], 0)
    counts = counts + extra
    found = defaultdict(list)
    for name, owner, big, block in zip(light, owners, heavy, blocks):
        if len(names) and len(name):
            j = np.minimum(np.searchsorted(names, name), len(names) - 1)
            hit = names[j] == name
        else:
            j, hit = np.zeros(len(name), np.int64), np.zeros(len(name), bool)
        found[block].append((name[hit], counts[j[hit]], owner[hit], big, sums[np.searchsorted(often, big)]))
    rows = []
    for block, parts in found.items():
        name, count, owner, big, big_count = (np.concatenate(x) for x in zip(*parts))
        if len(name) or len(big):
            rows.append(
                (block, KNOWN, block, _pack(name.astype("<u8"), count.astype("<u4"), owner.astype("<u2"), big.astype("<u8"), big_count.astype("<u4")))
            )
    for i in range(0, len(rows), 64):
        yield _batch(rows[i : i + 64])
    del light, owners, found, rows
    give_back()


def _sets_rows():
    """A row per text with its shared names, rarest first; the texts of a block together."""

    def finish(block: int, own: bytes, parts: list[bytes]) -> pa.RecordBatch:
        ids, null, text_names, count, node, parity, often, often_owner = _unpack(own, "<i8", "u1", "<i8", "<u4", "<u8", "<i8", "<u8", "<u2")
        got = [_unpack(p, "<u8", "<u4", "<u2", "<u8", "<u4") for p in parts]
        name, seen, owner, big, big_seen = (
            (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, k) for k in ("<u8", "<u4", "<u2", "<u8", "<u4"))
        )
        order = np.argsort(big)
        big, big_seen = big[order], big_seen[order]
        at = np.searchsorted(big, often)
        name = np.concatenate([name, often])
        seen = np.concatenate([seen, big_seen[at]])
        owner = np.concatenate([owner, often_owner])
        order = np.lexsort((name, seen, owner))
        name, owner = name[order], owner[order]
        shared = np.bincount(owner, minlength=len(ids))
        offsets = np.append(0, np.cumsum(shared)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=null.astype(bool)),
                pa.array(text_names),
                pa.array((block << 16) + np.arange(len(ids))),
                pa.array(count.astype(np.int64)),
                pa.array(node.view("<i8")),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(name.astype(np.int64))),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (BITS // 64)), pa.array(parity)
                ),
            ],
            names=["doc_id", "text_name", "row", "n", "node", "tokens", "parity"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, parts = {}, defaultdict(list)
        for batch in batches:
            for kind, block, payload in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if kind == SETS:
                    blocks[block] = payload
                else:
                    parts[block].append(payload)
        for block in list(blocks):
            yield finish(block, blocks.pop(block), parts.pop(block, []))
        give_back()

    return run


def _prefix(percent: int) -> Column:
    """Length of the prefix that is in shared names: those before it are in one text only."""
    need = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    alone = F.col("n") - F.size("tokens")
    return F.greatest(F.lit(0).cast("long"), F.col("n") - need + 1 - alone)


def _needed(percent: int) -> Column:
    """Shared names of a linked pair: s (100 + p) >= p (n_a + n_b)."""
    total = F.col("a.n") + F.col("b.n")
    return F.floor((total * percent + (100 + percent) - 1) / (100 + percent)).cast("long")


def _passes(percent: int) -> Column:
    """Length and positional filters of two postings of one name."""
    shorter, longer = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (shorter * 100 >= longer * percent) & (F.least("a.pos", "b.pos") + rest >= _needed(percent))


def _parity_columns() -> list[Column]:
    return [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(BITS // 64)]


def _suffix(percent: int) -> Column:
    """Suffix filter: sets whose parity bits differ in d places differ in d names at least."""
    differ = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(BITS // 64)), F.lit(0))
    return F.col("a.n") + F.col("b.n") - differ >= 2 * _needed(percent)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u, v`` whose sets are similar enough."""
    joined = pairs.join(sets.alias("a"), F.col("u") == F.col("a.node")).join(sets.alias("b"), F.col("v") == F.col("b.node"))
    return joined.where(F.size(F.array_intersect("a.tokens", "b.tokens")) >= _needed(percent)).select("u", "v")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What tells rows apart: the id and a hash of the text.  Rows that agree in both are repeats of one row."""
    return F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def similar_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Step 1 of the module: one written row per text, see ``SETS_SCHEMA``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id, text_name = row_key(id_col, text_col)
    source = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), text_name.alias("text_name"))
    sets = (
        source.mapInArrow(_scan(n, 4 * parts), TRAVEL)
        .repartition(parts, "key")
        .mapInArrow(_count, TRAVEL)
        .repartition(parts, "block")
        .mapInArrow(_sets_rows(), SETS_SCHEMA)
    )
    prefix = _prefix(percent)
    return stage(
        sets.withColumn("prefix", F.slice("tokens", F.lit(1), prefix.cast("int")))
        .withColumn("tokens", F.when(F.size("prefix") > 0, F.col("tokens")))
        .withColumn("parity", F.when(F.size("prefix") > 0, F.col("parity"))),
        "sets",
    )


def _with_components(postings: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return postings.withColumn("comp", F.col("node"))
    return postings.join(components, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def links_between(classes: DataFrame, percent: int) -> DataFrame | None:
    """``node, component`` of the classes (``node, n, tokens, parity, prefix, alone``) with a link."""
    sets = classes.select("node", "n", "tokens")
    parity = classes.select("node", *_parity_columns())
    exploded = classes.select("node", "n", "alone", F.posexplode("prefix").alias("at", "name"))
    postings = exploded.select("name", "node", "n", (F.col("alone") + F.col("at")).alias("pos"))
    several = postings.groupBy("name").count().where("count > 1").select("name")
    postings = stage(postings.join(several, "name"), "postings")
    links, components = None, None
    for turn in range(2):
        current = _with_components(postings, components)
        # the text with the fewest names rarer than this one is nearest to all that share it
        central = F.struct((-F.col("pos") if turn == 0 else F.lit(0)).alias("first"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "pos", "comp")
        hub = current.groupBy("name").agg(F.max(central).alias("b"))
        hub = hub.select("name", "b.node", "b.n", "b.pos", "b.comp")
        pairs = (
            current.alias("a")
            .join(hub.alias("b"), F.col("a.name") == F.col("b.name"))
            .where((F.col("a.comp") != F.col("b.comp")) & _passes(percent))
            .select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
            .distinct()
        )
        found = stage(_verify(pairs, sets, percent), "links")
        if links is None:  # hubs are labels enough for the second round
            links = found
            components = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        else:
            links = links.unionAll(found)
            components = connected(links)
    current = stage(_with_components(postings, components), "current")
    sizes = current.groupBy("name", "comp").count()
    main = sizes.groupBy("name").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"))
    main = main.where("comps > 1").select(F.col("name"), F.col("top.comp").alias("main"))
    mixed = current.join(main, "name").join(parity, "node")
    pairs = (
        mixed.where("comp != main").alias("a")
        .join(mixed.alias("b"), F.col("a.name") == F.col("b.name"))
        .where(
            (F.col("a.comp") != F.col("b.comp"))
            & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
            & _passes(percent)
            & _suffix(percent)
        )
        .select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
        .distinct()
    )
    return connected(links.unionAll(_verify(pairs, sets, percent)))


def _grouped(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_name, n`` of every row, and ``class_id, component_id, first`` of rows with names.

    ``first`` is the key of the first row of the component: least id, a null one last, and then least text name.
    """
    sets = similar_sets(docs, n, percent, id_col, text_col)
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_name")
    with stages_removed(docs.sparkSession):
        classes = sets.where("n > 0").groupBy("node")
        classes = classes.agg(F.min("doc_id").alias("class_id"), F.min("row").alias("row"), F.min(key).alias("first"))
        classes = stage(classes, "classes")
        reps = (
            sets.where(F.size("prefix") > 0)
            .join(classes.select("row"), "row")
            .select("node", "n", "tokens", "parity", "prefix", (F.col("n") - F.size("tokens")).alias("alone"))
        )
        components = links_between(stage(reps, "reps"), percent)
        known = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = known.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min("first").alias("least"))
        members = known.join(least, "component").select("node", "class_id", "component_id", F.col("least").alias("first"))
        members = stage(members, "members", outlives=True)
    return sets.select("doc_id", "text_name", "n", "node").join(members, "node", "left")


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row.

    Rows link when 100 times the common n-grams reach ``percent`` times all n-grams of both.
    ``component_id`` is the least id reachable by links, ``class_id`` the least id with the same set.
    """
    own = F.when(F.col("n") == 0, F.col("doc_id"))
    return _grouped(docs, n, percent, id_col, text_col).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(own, "class_id").alias("class_id"),
        F.coalesce(own, "component_id").alias("component_id"),
    )


def surplus_rows(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_name, first`` of the row keys (see ``row_key``) that keep less than all their rows.

    Where ``first`` is true, one row of the key is its component's; where it is false, none is.
    """
    rows = _grouped(docs, n, percent, id_col, text_col).where("n > 0")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_name") == F.col("first.text_name"))
    keys = rows.select("doc_id", "text_name", first.alias("first")).groupBy("doc_id", "text_name")
    keys = keys.agg(F.min("first").alias("first"), F.count("*").alias("rows"))
    return keys.where("NOT first OR rows > 1").drop("rows")
