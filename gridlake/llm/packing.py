"""Order-preserving packing of tokenised documents into training sequences.

Documents keep the order in which their table is read.  A dynamic programme picks the
ends of sequences among document ends, sentence ends and, inside a stretch without
either, evenly spaced positions.  Its cost is padding plus a penalty by the kind of cut;
padding is linear in the start of a sequence, so the best start within reach is the front
of a monotone queue.  The scan is the only stage: no exchange, memory bounded by
``CHUNK`` ids and the longest document.

Special strings of the tokenizer in a text become their ids, as the library codes them.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` stays null;
repeated rows are packed as often as they occur; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, process_memo, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ids held before a piece of the stream is packed
CHUNK = 1 << 20
#: words whose ids a Python worker remembers, in two generations
WORDS = 600_000
#: new words encoded in one call
TOGETHER = 512
#: penalties in ids of padding: a cut at a sentence end, a cut elsewhere, one more sequence
SENTENCE, INSIDE, SEQUENCE = 16, 96, 8
#: stretches without a sentence end get a cut at every so many ids
STEP = 512
#: a single comma or stop after a letter or digit, before white space or the end
MARK = re.compile(rb"[,.](?<=[A-Za-z0-9].)(?=[ \n]|\Z)")
SENTENCE_ENDS = (".", "!", "?", "…", "。")

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def _tokenizer(source: str):
    memo = process_memo("packing")
    if memo.get("source") != source:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(source)
        # special strings are split out before; words that are like one after lower-casing are words
        tok.encode_special_tokens = True
        pattern, special = special_strings(source)
        vocab = tok.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        last = np.zeros(len(ends), bool)
        for piece, i in vocab.items():
            ends[i] = piece.removesuffix("</w>").endswith(SENTENCE_ENDS)
            last[i] = piece.endswith("</w>")
        between = Tokenizer.from_str(source)  # reads the special strings that keep words apart
        memo.clear()
        memo.update(source=source, tok=tok, between=between, ends=ends, last=last, pattern=pattern, special=special, words={}, older={})
    return memo


def encode_apart(memo: dict, words: list[bytes]) -> list[bytes]:
    """Little-endian ids of each word, ``TOGETHER`` words encoded in one call.

    Words of letters alone are one piece each, so the ids that end a piece tell them apart.  Others are kept apart by a
    special string between them.
    """
    letters = [x for x in map(bytes.decode, words) if x.isalpha() and x.lower().isalpha()]
    known = dict(_in_turn(memo, letters, " ", memo["last"]))
    rest = [x for x in map(bytes.decode, words) if x not in known]
    mark = next(iter(memo["special"]), b"")[1:]
    plain = [x for x in rest if mark and not memo["pattern"].search(x.encode())]
    only_mark = np.zeros(len(memo["last"]), bool)
    if mark:
        only_mark[np.frombuffer(memo["special"][b" " + mark], "<u4")] = True
    known.update(_in_turn(memo, plain, mark.decode(), only_mark))
    odd = [x for x in rest if x not in known]  # words that look like a special string, once in lower case
    for x, c in zip(odd, memo["tok"].encode_batch_fast(odd, add_special_tokens=False)):
        known[x] = struct.pack(f"<{len(c.ids)}I", *c.ids)
    return [known[w.decode()] for w in words]


def _in_turn(memo: dict, words: list[str], between: str, ends: np.ndarray) -> Iterator[tuple[str, bytes]]:
    """Words with their ids, from calls on many joined by ``between``; ``ends`` marks the ids that end one, of it or after it."""
    for i in range(0, len(words), TOGETHER):
        some = words[i : i + TOGETHER]
        coded = memo["between"].encode_batch_fast([between.join(some)], add_special_tokens=False)[0]
        ids = np.array(coded.ids, "<u4")
        after = 0 if between == " " else 4  # the string between words has an id of its own
        stops = np.flatnonzero(ends[ids])
        if not after:
            stops = stops[:-1] + 1
        if len(stops) + 1 == len(some):
            cuts, data = (stops * 4).tolist(), ids.tobytes()
            yield from zip(some, (data[a:b] for a, b in zip([0, *(c + after for c in cuts)], [*cuts, len(data)])))


def special_strings(source: str) -> tuple[re.Pattern | None, dict[bytes, bytes]]:
    """A pattern of the tokenizer's special strings, and the ids of their parts (see ``split_words``)."""
    added = json.loads(source).get("added_tokens") or []
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special strings must be matched as they stand")
    strings = sorted((t["content"].encode() for t in added), key=len, reverse=True)
    pattern = re.compile(b"(" + b"|".join(map(re.escape, strings)) + b")") if strings else None
    return pattern, {b" " + t["content"].encode(): struct.pack("<I", t["id"]) for t in added}


def split_words(text: bytes, special: re.Pattern | None = None) -> list[bytes]:
    """Parts of a text that the tokenizer codes by themselves, A-Z as a-z.

    It drops white space, never joins across it, and keeps a mark after a letter apart.  A special string
    is a part of its own, told from words by a space before it.
    """
    if special is None or not special.search(text):
        return MARK.sub(rb" \g<0>", text).lower().split()
    words = []
    for i, part in enumerate(special.split(text)):
        words += [b" " + part] if i % 2 else split_words(part)
    return words


def encode_words(memo: dict, documents: list[list[bytes]]) -> list[bytes]:
    """Little-endian ids of each document, its words encoded once per worker."""
    known, older = memo["words"], memo["older"]
    if len(known) > WORDS // 2:
        memo["older"] = older = known
        memo["words"] = known = {}
    new = []
    for w in set().union(*documents):
        if w not in known:
            if w in memo["special"]:
                known[w] = memo["special"][w]
            elif w in older:
                known[w] = older[w]
            else:
                new.append(w)
    known.update(zip(new, encode_apart(memo, new)))
    return [b"".join(map(known.__getitem__, words)) for words in documents]


def choose_ends(cuts: np.ndarray, penalty: np.ndarray, most: int) -> list[int]:
    """Ends of the sequences that cover ``0 .. cuts[-1]`` at least cost.

    ``cuts`` are rising positions from 0, neighbours at most ``most`` apart; ``penalty[i]``
    is paid for ending at ``cuts[i]``.  A length that is a power of two needs no padding.
    """
    at = cuts.tolist()
    pay = penalty.tolist()
    exact = []
    for size in (most // 2, most // 4):
        j = np.searchsorted(cuts, cuts - size)
        exact.append(np.where((cuts >= size) & (cuts[np.minimum(j, len(cuts) - 1)] == cuts - size), j, -1).tolist())
    half, quarter = exact
    cost, back = [0.0] * len(at), [0] * len(at)
    queue = deque([(0.0, 0, 0)])  # cost plus position, position, index; rising
    for i in range(1, len(at)):
        c = at[i]
        while c - queue[0][1] > most:
            queue.popleft()
        value, _, j = queue[0]
        value += most - c
        for k in (half[i], quarter[i]):
            if k >= 0 and cost[k] < value:
                value, j = cost[k], k
        value += pay[i] + SEQUENCE
        cost[i], back[i] = value, j
        key = value + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c, i))
    ends, i = [], len(at) - 1
    while i:
        ends.append(at[i])
        i = back[i]
    return ends[::-1]


def _rising(positions: np.ndarray) -> np.ndarray:
    """Distinct positions in order; sorting beats hashing here."""
    positions = np.sort(positions)
    return positions[np.append(True, positions[1:] != positions[:-1])]


def _candidates(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    soft = _rising(np.concatenate([[0], doc_ends, sentence_ends, [total]]).astype(np.int64))
    gaps = np.flatnonzero(np.diff(soft) > 2 * STEP)
    hard = [np.arange(soft[g] + STEP, soft[g + 1], STEP) for g in gaps]
    cuts = _rising(np.concatenate([soft, *hard])) if hard else soft
    penalty = np.full(len(cuts), float(INSIDE))
    penalty[np.searchsorted(cuts, sentence_ends)] = SENTENCE
    penalty[np.searchsorted(cuts, doc_ends)] = 0
    penalty[np.searchsorted(cuts, total)] = 0
    return cuts, penalty


class _Stream:
    """Ids not yet packed, and where documents start in them."""

    def __init__(self, most: int, ends: np.ndarray, first_id: int):
        self.most, self.is_end, self.next_id = most, ends, first_id
        self.ids = np.zeros(0, "<u4")
        self.docs: list[tuple] = []  # doc_id, ids in all, ids packed before, ids here
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.docs.append((doc_id, len(ids), 0, len(ids)))
        self.size += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch | None:
        ids = np.concatenate([self.ids, *self.waiting])
        self.waiting = []
        lengths = np.array([d[3] for d in self.docs], np.int64)
        doc_ends = np.cumsum(lengths)
        flags = np.zeros(len(ids), bool)
        inside = ids < len(self.is_end)
        flags[inside] = self.is_end[ids[inside]]
        cuts, penalty = _candidates(len(ids), doc_ends, np.flatnonzero(flags) + 1)
        ends = choose_ends(cuts, penalty, self.most)
        if last:
            start = ends[-2] if len(ends) > 1 else 0
            rest = ends.pop() - start
            if self.most - rest <= INSIDE:
                ends.append(start + rest)
            else:  # nothing follows: powers of two, which need no padding
                for size in (self.most >> k for k in range(self.most.bit_length())):
                    if rest & size:
                        start += size
                        ends.append(start)
        else:
            ends.pop()  # what follows may fill it
        if not ends:
            self.ids = ids
            return None
        stop = ends[-1]
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        doc_starts = doc_ends - lengths
        pieces = _rising(np.concatenate([starts, doc_starts[doc_starts < stop]]))
        doc = np.searchsorted(doc_starts, pieces, "right") - 1
        seq = np.searchsorted(starts, pieces, "right") - 1
        until = np.append(pieces[1:], stop)
        before = np.array([d[2] for d in self.docs], np.int64)
        in_all = np.array([d[1] for d in self.docs], np.int64)
        data = ids[:stop].tobytes()
        offsets = np.append(pieces, stop) * 4
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in self.docs], pa.int64()).take(pa.array(doc)),
                pa.array(before[doc] + pieces - doc_starts[doc]),
                pa.array(until - pieces),
                pa.array(in_all[doc]),
                pa.array(self.next_id + seq),
                pa.array(pieces - starts[seq]),
                pa.Array.from_buffers(
                    pa.binary(), len(pieces), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)]
                ),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        self.next_id += len(ends)
        first = int(np.searchsorted(doc_ends, stop, "right"))
        rest_docs = self.docs[first:]
        if rest_docs:
            cut = max(0, stop - int(doc_starts[first]))
            d = rest_docs[0]
            rest_docs[0] = (d[0], d[1], d[2] + cut, d[3] - cut)
        self.docs, self.ids, self.size = rest_docs, ids[stop:], len(ids) - stop
        return out


def _packer(source: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _tokenizer(source)
        end = np.array([end_id], "<u4").tobytes()
        stream = _Stream(most, memo["ends"], TaskContext.get().partitionId() << 32)
        for batch in slices(batches, 1, 2 << 20):
            words = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
            coded = encode_words(memo, [split_words(w, memo["pattern"]) for w in words])
            for doc_id, data in zip(batch.column(0).to_pylist(), coded):
                stream.add(doc_id, np.frombuffer(data + end, "<u4"))
            if stream.size >= CHUNK and (out := stream.pack(False)):
                yield out
        if stream.size and (out := stream.pack(True)):
            yield out
        give_back()

    return run


def pack_documents(
    docs: DataFrame, tokenizer_file: str, end_id: int = 2, sequence: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document in a sequence; ``ids`` holds little-endian unsigned 32-bit ids.

    ``sequence`` is a power of two.  ``sequence_id`` is unique over the table, ``offset`` counts from 0
    without gaps in each sequence.
    """
    if sequence < 4 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two, 4 at least")
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    source_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source_rows.mapInArrow(_packer(source, end_id, sequence), SCHEMA)
