"""Alignment of two tokenizers' tokens by the bytes they cover.

Both tokenizers read the same string, a space and the text.  Their spans (character offsets of the
byte-level tokenizer, byte spans of the piece tokenizer's proto) are coarse cuts: a token whose span is as
long as its decoded bytes ends where the span ends; tokens that share a character, or stand for a single byte of
one, are cut inside it by their decoded lengths.  Offsets at which tokens of both end cut them into groups.

A text is split into units, each a run of white space and what follows it, where no token of either
tokenizer reaches across.  New units are encoded many at a time, and recent ones are remembered, ``UNITS`` per worker at
most.  Documents are gathered into blocks of ``BLOCK`` bytes of text; a block knows its distinct units, their links, and in how
many of its documents each pair of ids is linked.  Spark sums these counts over all blocks by pair, finds the
highest count of each first id, and brings the values back to the blocks, where documents add them up.
A pair has at most one row per block, so no key is hot; exchanges carry pairs of a block, not links.

Defined results: texts that are null, empty or that a tokenizer changes (its joined bytes are not those of the
space and the text) have no tokens: zeros and an empty hash.  Equal counts are all best.  Repeated rows
are documents of their own and count as often as they occur; a null id stays null; an empty table gives no rows; other
columns are never read.  A text without white space is one unit however long.  Links of a group are counted from the distinct ids
on either side, so a long group costs no more than its distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .arrow import forget, give_back, process_memo, slices, texts
from .bpe import WHITE
from .words import pack_planes, unpack_planes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: units a worker remembers, in two generations
UNITS = 800_000
#: bytes of text in a block, about
BLOCK = 4 << 20
#: characters of new units that are encoded together
TOGETHER = 1 << 12
#: a unit that ends where no unit of the text does, put before others: its end is a boundary
LEAD = " a"
#: letters after which a text may be cut before punctuation, if no piece holds the two side by side; the byte-level
#: pattern always cuts there
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: what stands between ids: more of the same side, the other side, the next group, the next unit
MARKS = np.frombuffer(b",|;\n", np.uint8)
COMMAS = bytes.maketrans(b"|;\n", b",,,")
#: links of a group that are written out one by one; longer groups count distinct ids first
SMALL = 4096

BLOCKS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, n_units int, doc_units binary, doc_counts binary, n_doc_units int, unit_pairs binary, "
    "pair_counts binary, n_unit_pairs int, a array<int>, b array<int>, docs array<int>"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable ones as they are, the rest from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_ends(begins: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where tokens end: at the end of a span that is as long as the token, else after its bytes."""
    cuts = ends.copy()
    whole = ends - begins == lengths
    if not whole.all():
        total = np.cumsum(lengths)
        anchor = np.maximum.accumulate(np.where(whole, np.arange(len(ends)), -1))
        known = anchor >= 0
        at = np.where(known, ends[np.maximum(anchor, 0)] - total[np.maximum(anchor, 0)], begins[0] if len(begins) else 0)
        cuts = np.where(whole, ends, at + total)
    return cuts


def common_ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rising offsets in both of two rising arrays."""
    return np.intersect1d(a, b, assume_unique=True)


class _Coder:
    """Both tokenizers and the units this worker remembers."""

    def __init__(self, a_source: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_source)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_names = np.array([[f"{i}{c}" for i in range(len(self.a_bytes))] for c in ",|"], object)
        self.b_names = np.array([[f"{i}{c}" for i in range(len(self.b_bytes))] for c in ",;\n"], object)
        self.units = self._splitter(json.loads(a_source), pieces)
        self.known: dict[str, str | None] = {}
        self.older: dict[str, str | None] = {}
        self.changed: set[str] = set()

    @staticmethod
    def _splitter(a: dict, pieces: list[str]):
        """Units of a text: cut before white space that no token of either tokenizer holds after another character."""
        pre = a.get("pre_tokenizer") or {}
        by_pattern = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not a.get("normalizer")
        if not by_pattern or any("▁" in p.lstrip("▁") for p in pieces):
            return lambda text: [text]
        white = re.compile(f"[{WHITE}]")
        glue = re.escape("".join(sorted({c for p in pieces for c in p if c != " " and white.match(c)})))
        cut = "".join(c for c in punctuation if c != "_" and not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in pieces))
        stop = WHITE + re.escape(cut)
        rest = f"[^{stop}]*+" + (f"(?:(?<![{LETTERS}])[{re.escape(cut)}][^{stop}]*+)*+" if cut else "")
        more = f"(?:[{glue}][{WHITE}]*+{rest})*+" if glue else ""
        return re.compile(f"[{WHITE}]*+[^{WHITE}]{rest}{more}|[{WHITE}]++").findall

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends of both tokenizers over ``text``, which starts with the space that the second adds; none if changed."""
        data = text.encode()
        coded = self.a.encode(text, add_special_tokens=False)
        a = np.array(coded.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        pieces = [(p.id, p.begin, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces]
        b, begins, ends = np.fromiter(chain.from_iterable(pieces), np.int64, 3 * len(pieces)).reshape(-1, 3).T
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return None
        char_at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        a_ends = byte_ends(char_at[spans[:, 0]], char_at[spans[:, 1]], self.a_length[a])
        begins, ends = begins + 1, ends + 1  # the space in front is in no span
        if len(begins):
            begins[0] = 0
        b_ends = byte_ends(begins, ends, self.b_length[b])
        return a, a_ends, b, b_ends

    def _groups(self, parts: list[str], lead: str) -> list[str] | None:
        """The groups of each part of one string, if every part ends with a token of either."""
        coded = self._encode(lead + "".join(parts))
        if coded is None:
            return None
        a, a_ends, b, b_ends = coded
        ends = np.cumsum([len(p.encode()) for p in parts]) + len(lead)
        common = common_ends(a_ends, b_ends)
        bounds = np.append(len(lead), ends) if lead else ends
        if not np.isin(bounds, common).all():
            return None
        if lead:
            a, b = (x[np.searchsorted(e, len(lead), "right") :] for x, e in ((a, a_ends), (b, b_ends)))
            a_ends, b_ends, common = (x[np.searchsorted(x, len(lead), "right") :] for x in (a_ends, b_ends, common))
        return self._names(a, a_ends, b, b_ends, common, ends)

    def _names(self, a, a_ends, b, b_ends, common, ends) -> list[str]:
        """The groups of every part as text, ``a1,a2|b1;a3|b2,b3``: tokens in order, each with what follows it."""
        group_a, group_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        all_a, all_b = np.cumsum(n_a), np.cumsum(n_b)
        last_of_part = np.isin(common, ends)
        out = np.empty(len(a) + len(b), object)
        last_a = np.arange(len(a)) + 1 == all_a[group_a]
        last_b = np.arange(len(b)) + 1 == all_b[group_b]
        out[np.arange(len(a)) + (all_b - n_b)[group_a]] = self.a_names[last_a.astype(int), a]
        out[np.arange(len(b)) + all_a[group_b]] = self.b_names[last_b.astype(int) + (last_b & last_of_part[group_b]), b]
        return "".join(out.tolist()).split("\n")[:-1]

    def _encode_units(self, units: list[str]) -> list[str | None]:
        found = self._groups(units, LEAD)
        if found is not None:
            return found
        if len(units) == 1:
            return [None]
        half = len(units) // 2  # one of them is changed, or reaches across: look for it
        return self._encode_units(units[:half]) + self._encode_units(units[half:])

    def whole(self, text: str) -> str | None:
        """A text as one unit, encoded on its own."""
        found = self._groups([text], "")
        return found[0] if found else None

    def learn(self, units: set[str]) -> None:
        if len(self.known) > UNITS // 2:
            self.older, self.known = self.known, {}
            self.changed.clear()
        known, older = self.known, self.older
        together, size, last = [], 0, []
        for u in units:
            if u in known:
                continue
            if u in older:
                known[u] = older[u]
                if older[u] is None:
                    self.changed.add(u)
            elif u[-1].isspace():
                last.append([u])  # white space at the end of a text: nothing may follow it
            else:
                if size > TOGETHER or not together:
                    together.append([])
                    size = 0
                if not u[0].isspace():
                    together[-1].append(LEAD)  # it follows a letter
                together[-1].append(u)
                size += len(u)
        for some in together + last:
            names = self._encode_units(some)
            known.update(zip(some, names))
            self.changed.update(u for u, x in zip(some, names) if x is None)


def _coder(a_source: str, b_model: bytes) -> _Coder:
    memo = process_memo("alignment")
    if memo.get("key") != (a_source, b_model):
        forget()
        memo.update(key=(a_source, b_model), coder=_Coder(a_source, b_model))
    return memo["coder"]


def _pack(values: np.ndarray) -> bytes:
    """Rising or small numbers as byte planes of the width they need."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + pack_planes(values.astype(np.uint64), width)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return unpack_planes(memoryview(data)[1:], n, data[0]).astype(np.int64)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with how often each occurs or the sum of its weights."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], np.append(0, np.cumsum(weights[order]))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], sums[np.append(first[1:], len(keys))] - sums[first]


def group_links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair (first id in the high half) and number of links, from the ids of groups in order."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    group = np.repeat(np.arange(len(links)), np.where(links <= SMALL, links, 0))
    start = np.cumsum(np.where(links <= SMALL, links, 0)) - np.where(links <= SMALL, links, 0)
    nth = np.arange(len(group)) - start[group]
    pair = a[first_a[group] + nth // n_b[group]] << 32 | b[first_b[group] + nth % n_b[group]]
    found = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(links > SMALL).tolist():
        x, cx = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, cy = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pairs = (x[:, None] << 32 | y[None, :]).ravel()
        found.append((np.full(len(pairs), g), pairs, np.outer(cx, cy).ravel()))
    return tuple(np.concatenate(column) for column in zip(*found))


class _Block:
    def __init__(self, coder: _Coder):
        self.coder = coder
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.ids: list = []
        self.units: list[np.ndarray] = []
        self.hashes: list[str] = []
        self.size = 0

    def add(self, ids: list, strings: list[str]) -> None:
        coder, index = self.coder, self.index
        found = [coder.units(" " + t) if t else [] for t in strings]
        every = set().union(*found)
        coder.learn(every)
        known = coder.known
        if not coder.changed.isdisjoint(every):
            known = dict(known)
            for i, units in enumerate(found):
                if not coder.changed.isdisjoint(units):  # the whole text decides
                    text = " " + strings[i]
                    known[text] = coder.whole(text)
                    found[i] = [text] if known[text] else []
            every = set().union(*found)
        new = [u for u in every if u not in index]
        index.update(zip(new, range(len(self.names), len(self.names) + len(new))))
        self.names.extend(map(known.__getitem__, new))
        at, named = index.__getitem__, self.names.__getitem__
        for i, t, units in zip(ids, strings, found):
            numbers = list(map(at, units))
            self.ids.append(i)
            self.units.append(np.array(numbers, np.int32))
            self.hashes.append(hashlib.sha256(";".join(map(named, numbers)).encode()).hexdigest() if numbers else "")
            self.size += len(t)

    def tables(self) -> tuple[np.ndarray, ...]:
        """Of all units in order: ids of either side, tokens of either side of each group, groups of each unit."""
        data = np.frombuffer(("\n".join(self.names) + "\n").encode() if self.names else b"", np.uint8)
        marks = np.flatnonzero(np.isin(data, MARKS))
        sort = data[marks]
        numbers = np.fromstring(data.tobytes().translate(COMMAS), np.int64, sep=",") if len(data) else np.zeros(0, np.int64)
        ends_group = (sort == MARKS[2]) | (sort == MARKS[3])
        bars, groups = np.cumsum(sort == MARKS[1]), np.cumsum(ends_group)
        on_b = bars - (sort == MARKS[1]) > groups - ends_group
        group = groups - ends_group
        n = int(groups[-1]) if len(groups) else 0
        n_a, n_b = (np.bincount(group[x], minlength=n) for x in (~on_b, on_b))
        per_unit = np.diff(groups[sort == MARKS[3]], prepend=0)
        return numbers[~on_b], numbers[on_b], n_a, n_b, per_unit

    def packed(self, number: int) -> pa.RecordBatch:
        a, b, n_a, n_b, n_groups = self.tables()
        n_units = len(self.names)
        unit_of = np.repeat(np.arange(n_units), n_groups)
        group, pair, links = group_links(a, b, n_a, n_b)
        pairs, position = np.unique(pair, return_inverse=True)
        n_pairs = max(len(pairs), 1)
        unit_pairs, pair_counts = _counted(unit_of[group] * n_pairs + position, links)
        sums = [_per(unit_of, x, n_units) for x in (n_a, n_b, np.ones(len(n_a), np.int64), n_a * n_b)]

        lengths = np.array([len(x) for x in self.units], np.int64)
        docs = np.repeat(np.arange(len(lengths)), lengths)
        units = np.concatenate(self.units) if self.units else np.zeros(0, np.int64)
        doc_units, doc_counts = _counted(docs * max(n_units, 1) + units)
        doc, unit = np.divmod(doc_units, max(n_units, 1))
        held = np.searchsorted(unit_pairs // n_pairs, np.arange(n_units + 1))
        wide = np.diff(held)[unit] if n_units else np.zeros(0, np.int64)
        nth = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        seen = unit_pairs[np.repeat(held[unit], wide) + nth] % n_pairs
        with_pair = _counted(np.repeat(doc, wide) * n_pairs + seen)[0] % n_pairs
        per_doc = [_per(doc, doc_counts * x[unit], len(lengths)).tolist() if n_units else [0] * len(lengths) for x in sums]
        row = {
            "block": number,
            "doc_id": self.ids,
            **dict(zip(("n_a", "n_b", "n_groups", "n_links"), per_doc)),
            "groups_sha256": self.hashes,
            "n_units": n_units,
            "doc_units": _pack(np.diff(doc_units, prepend=0)),
            "doc_counts": _pack(doc_counts),
            "n_doc_units": len(doc_units),
            "unit_pairs": _pack(np.diff(unit_pairs, prepend=0)),
            "pair_counts": _pack(pair_counts),
            "n_unit_pairs": len(unit_pairs),
            "a": pairs >> 32,
            "b": pairs & 0xFFFFFFFF,
            "docs": np.bincount(with_pair, minlength=len(pairs)) if len(pairs) else pairs,
        }
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK_TYPES)


def _per(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of ``values`` by rising ``group``."""
    sums = np.append(0, np.cumsum(values))
    at = np.searchsorted(group, np.arange(n + 1))
    return sums[at[1:]] - sums[at[:-1]]


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK_TYPES = pa.schema(
    [("block", pa.int64()), *((c, _LONGS) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string()))]
    + [("n_units", pa.int32()), ("doc_units", pa.binary()), ("doc_counts", pa.binary()), ("n_doc_units", pa.int32())]
    + [("unit_pairs", pa.binary()), ("pair_counts", pa.binary()), ("n_unit_pairs", pa.int32())]
    + [(c, _INTS) for c in ("a", "b", "docs")]
)


def _aligner(a_source: str, b_model: bytes, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(a_source, b_model)
        number = TaskContext.get().partitionId() << 32
        block = _Block(coder)
        for batch in slices(batches, 1, min(block_bytes, 1 << 20)):
            block.add(batch.column(0).to_pylist(), texts(batch.column(1)))
            if block.size >= block_bytes:
                yield block.packed(number)
                number, block = number + 1, _Block(coder)
        if block.ids:
            yield block.packed(number)
        del block
        give_back()

    return run


def _sums(blocks: pa.Table, values: pa.Table) -> pa.Table:
    """Documents of a block with the values of its pairs added up."""
    row = blocks.to_pylist()[0]
    n_docs, n_units, n_pairs = len(row["doc_id"]), row["n_units"], max(len(row["a"]), 1)
    at = values.column("pos").to_numpy()
    count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    count[at] = values.column("count").to_numpy()
    best[at] = values.column("is_best").to_numpy(zero_copy_only=False)
    unit, pair = np.divmod(np.cumsum(_unpack(row["unit_pairs"], row["n_unit_pairs"])), n_pairs)
    links = _unpack(row["pair_counts"], row["n_unit_pairs"])
    doc, held = np.divmod(np.cumsum(_unpack(row["doc_units"], row["n_doc_units"])), max(n_units, 1))
    times = _unpack(row["doc_counts"], row["n_doc_units"])
    out = {c: row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    for name, value in (("n_best", best), ("count_sum", count)):
        of_unit = _per(unit, links * value[pair], n_units)
        out[name] = _per(doc, times * of_unit[held], n_docs) if n_units else np.zeros(n_docs, np.int64)
    return pa.table({**out, "groups_sha256": row["groups_sha256"]}, schema=_RESULT_TYPES)


_RESULT_TYPES = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())]
)


def align_tokenizers(
    docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every text.

    ``a_file`` is a byte-level tokenizer of the tokenizers library, ``b_file`` a piece model with byte fallback that puts a space
    in front.  Both are read once by the driver; a few MB travel with the plan.  ``n_best`` counts links
    whose pair is in as many documents of the whole table as any pair of the same first id; ``count_sum`` adds up
    those numbers of documents over all links.
    """
    with open(a_file, encoding="utf-8") as f:
        a_source = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stage(rows.mapInArrow(_aligner(a_source, b_model, block_bytes), BLOCKS), "aligned")
    pairs = blocks.select(F.col("block").alias("in_block"), F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pos", "pair"))
    pairs = pairs.select("in_block", "pos", "pair.a", "pair.b", "pair.docs")
    counts = stage(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair_counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # a row for each id of a vocabulary at most
    judged = counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("is_best"))
    values = pairs.join(judged, ["a", "b"]).select("in_block", "pos", "count", "is_best")
    return blocks.drop("docs", "b").groupBy("block").cogroup(values.groupBy("in_block")).applyInArrow(_sums, RESULT)
