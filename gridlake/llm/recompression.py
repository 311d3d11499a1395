"""Passages that occur more than once, found by recompression and removed.

Every text is a word sequence.  In each round runs of one symbol become a symbol, and then
neighbours of which the first is on the left side and the second on the right side of that
round's split of all symbols become a symbol.  Names are hashes of what they stand for, so
equal passages get equal symbols inside, anywhere in the corpus, without an exchange per
round.  For each symbol the words that decided it are known.  A window of 35 words belongs
to the first symbol of the highest round that its own words decide; equal windows therefore
belong to equal symbols at the same distance.  One exchange brings the windows of equal
symbols together, where hashes of the whole window verify them; a second brings repeated
windows back to the block of texts they came from.

Hot passages: a block sends at most two occurrences of a window, however often it holds it,
since more prove nothing new.  Work in a task is bounded by a block of texts or by a share
of all windows.

Defined results: null and empty texts have no words; a repeated row repeats all its windows;
texts shorter than a window are left alone; an empty table gives no rows; ``keep`` columns
come back unchanged, clashing names included, since inner columns never meet them.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import forget, give_back, slices
from .words import find_words, hash_spans, hash_windows, mix, pack_planes, text_bytes, unpack_planes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 7
#: bytes of text in a block
BLOCK = 2 << 20
#: bytes of a symbol's name and of a window's hash that travel
NAME, HASH = 5, 6
TRAVEL = "key long, kind string, block long, payload binary"
WINDOWS, TEXTS, RANGES = "windows", "texts", "ranges"


class Level:
    """Symbols of one round: name, first and last word + 1 that decided them, and text."""

    def __init__(self, name, low, high, text):
        self.name, self.low, self.high, self.text = name, low, high, text

    def _merged(self, heads: np.ndarray, name: np.ndarray) -> Level:
        """Symbols that start at ``heads``; each was decided by itself and its two neighbours."""
        n = len(self.name)
        tails = np.append(heads[1:], n)
        text = self.text[heads]
        before = np.maximum(heads - 1, 0)
        after = np.minimum(tails, n - 1)
        open_left = (heads == 0) | (self.text[before] != text)
        open_right = (tails == n) | (self.text[after] != text)
        low = np.where(open_left, -1, self.low[before])
        high = np.where(open_right, np.iinfo(np.int64).max, self.high[after])
        return Level(name, low, high, text)

    def next(self, turn: int) -> Level:
        n = len(self.name)
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        heads = np.flatnonzero(new)
        length = np.diff(np.append(heads, n)).astype(np.uint64)
        name = self.name[heads]
        runs = self._merged(heads, np.where(length > 1, mix(name + length * np.uint64(0xA24BAED4963EE407)), name))
        side = (mix(runs.name ^ np.uint64(turn + 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(runs.name), bool)  # with the symbol after it
        joins[:-1] = ~side[:-1] & side[1:] & (runs.text[:-1] == runs.text[1:])
        heads = np.flatnonzero(~np.append(False, joins[:-1]))
        left = runs.name[heads]
        right = runs.name[np.minimum(heads + 1, len(runs.name) - 1)]
        name = np.where(joins[heads], mix(left * np.uint64(0x9FB21C651E98DF25) + right), left)
        return runs._merged(heads, name)


def anchors(words: np.ndarray, text: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Per window start: the name of its symbol, and a number that tells symbols at hand apart."""
    n = len(words) - size + 1
    level = Level(words, np.arange(len(words)), np.arange(1, len(words) + 1), text)
    levels = [level]
    for turn in range(rounds):
        levels.append(level := level.next(turn))
    name, number = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    left = np.arange(n)
    base = 0
    for turn in range(rounds, -1, -1):
        level = levels[turn]
        decided = np.flatnonzero((level.low >= 0) & (level.high <= len(words)))
        low, high = level.low[decided], level.high[decided]
        j = np.searchsorted(low, left)
        inside = j < len(low)
        inside[inside] = high[j[inside]] <= left[inside] + size
        hit = j[inside]
        name[left[inside]] = mix(level.name[decided[hit]] + np.uint64(turn))
        number[left[inside]] = base + hit
        left = left[~inside]
        base += len(low)
    return name, number


def _message(key: int, kind: str, block: int, payload) -> tuple:
    return key, kind, block, payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, kind, block, payload = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(kind, pa.string()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())],
        names=["key", "kind", "block", "payload"],
    )


def _ranges(starts: np.ndarray, size: int) -> bytes:
    """Sorted window starts as (first word, word after the last) of what they cover."""
    if not len(starts):
        return b""
    new = np.append(True, starts[1:] > starts[:-1] + size)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + size
    return np.stack([first, last]).astype("<u4").tobytes()


def _window_rows(words, text, size, buckets, block) -> Iterator[tuple]:
    """Windows by bucket of their symbol, at most two of a kind, and those repeated right here."""
    whole = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
    if not len(whole):
        return
    name, number = anchors(words, text, size)
    name, number = name[whole] & np.uint64((1 << 8 * NAME) - 1), number[whole]
    full = hash_windows(words, size)[whole] & np.uint64((1 << 8 * HASH) - 1)
    key = mix(name + mix(full))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    third = np.zeros(len(key), bool)
    third[order[2:][same[1:] & same[:-1]]] = True
    if repeated.any():
        yield _message(block, RANGES, block, _ranges(whole[repeated], size))
    sent = ~third
    at, name, number, full = whole[sent], name[sent], number[sent], full[sent]
    head = np.append(True, (number[1:] != number[:-1]) | (at[1:] != at[:-1] + 1))
    heads = np.flatnonzero(head)
    count = np.diff(np.append(heads, len(at)))
    bucket = (name[heads] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        mine = order[a:b]
        n = count[mine]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        steps = np.diff(at[heads[mine]], prepend=0)  # starts rise within a bucket
        width = max(1, (int(steps.max()).bit_length() + 7) // 8)
        payload = b"".join(
            [
                np.array([len(mine), n.sum(), width], "<u4").tobytes(),
                pack_planes(name[heads[mine]], NAME),
                n.astype(np.uint8).tobytes(),
                pack_planes(steps, width),
                pack_planes(full[np.repeat(heads[mine], n) + inner], HASH),
            ]
        )
        yield _message(int(bucket[mine[0]]), WINDOWS, block, payload)


def _scan(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part = TaskContext.get().partitionId() << 24
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for k, batch in enumerate(slices(batches, 0, BLOCK)):
            block = part + k
            data, offsets = text_bytes(batch.column(0))
            starts, ends, text = find_words(data, offsets)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                writer.write_batch(batch)
            rows = [_message(block, TEXTS, block, sink.getvalue().to_pybytes())]
            rows += _window_rows(hash_spans(data, starts, ends), text, size, buckets, block)
            yield _batch(rows)
        give_back()

    return run


def _match(size: int):
    """Repeated windows of the buckets in this task, as ranges by block; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, blocks = [], [], []
        for batch in batches:
            others = []
            for key, kind, block, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind != WINDOWS:
                    others.append((key, kind, block, payload))
                    continue
                records, n, width = (int(x) for x in np.frombuffer(payload, "<u4", 3))
                view, at = memoryview(payload), 12
                name = unpack_planes(view[at:], records, NAME)
                at += NAME * records
                count = np.frombuffer(payload, np.uint8, records, at).astype(np.int64)
                at += records
                first = np.cumsum(unpack_planes(view[at:], records, width).astype(np.int64))
                at += width * records
                full = unpack_planes(view[at:], n, HASH)
                keys.append(mix(np.repeat(name, count) + mix(full)))
                inner = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
                starts.append((np.repeat(first, count) + inner).astype(np.uint32))
                blocks.append(block)
            if others:
                yield _batch(others)
        if not keys:
            return
        every = np.sort(np.concatenate(keys))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        del every
        found = defaultdict(list)
        if len(twice):
            for key, start, block in zip(keys, starts, blocks):
                j = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
                hit = start[twice[j] == key]
                if len(hit):
                    found[block].append(hit)
        rows = [_message(b, RANGES, b, _ranges(np.sort(np.concatenate(x)).astype(np.int64), size)) for b, x in found.items()]
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256])
        del keys, starts, found, rows
        give_back()

    return run


def _removed(ranges: list[bytes], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for payload in ranges:
        first, last = np.frombuffer(payload, "<u4").reshape(2, -1).astype(np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


def _clean(schema: pa.Schema):
    """Texts of the blocks in this task without the words in their ranges."""

    def finish(payload: bytes, ranges: list[bytes]) -> Iterator[pa.RecordBatch]:
        for batch in pa.ipc.open_stream(payload):
            words = [t.split() for t in (b"" if t is None else t for t in batch.column(0).cast(pa.binary()).to_pylist())]
            counts = np.array([len(w) for w in words], np.int64)
            gone = _removed(ranges, int(counts.sum()))
            ends = np.cumsum(counts)
            kept, removed = [], []
            for own, end in zip(words, ends):
                mask = gone[end - len(own) : end]
                k = int(mask.sum())
                removed.append(k)
                kept.append(b" ".join([w for w, m in zip(own, mask.tolist()) if not m] if k else own))
            columns = [*batch.columns, pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ranges = {}, defaultdict(list)
        for batch in batches:
            for kind, block, payload in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if kind == TEXTS:
                    blocks[block] = payload
                else:
                    ranges[block].append(payload)
        for block in list(blocks):
            yield from finish(blocks.pop(block), ranges.pop(block, []))
        give_back()

    return run


def remove_repeats(docs: DataFrame, size: int = 35, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``text``, the ``keep`` columns, ``n_words``, ``n_removed`` and ``kept`` (the words left, one space between).

    A word goes if it is in ``size`` neighbouring words of its text that also start anywhere else.
    """
    if not 1 < size < 256:
        raise ValueError("size must be from 2 to 255 words")
    source = docs.select(F.col(text_col).alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep, 1)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [*source.schema.fields, *(T.StructField(c, T.LongType()) for c in ("w", "r")), T.StructField("k", T.StringType())]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    cleaned = (
        source.mapInArrow(_scan(size, 4 * parts), TRAVEL)
        .repartition(parts, "key")
        .mapInArrow(_match(size), TRAVEL)
        .repartition(parts, "block")
        .mapInArrow(_clean(to_arrow_schema(out)), out)
    )
    return cleaned.toDF("text", *keep, "n_words", "n_removed", "kept")
