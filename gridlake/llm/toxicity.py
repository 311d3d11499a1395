"""Toxicity scores from a counterfactually regularised linear classifier.

A text is the set of its words and word beginnings, hashed to a fixed number of features.
The classifier is logistic regression on a bounded sample of labelled texts.  For every
labelled text that names an identity group, a copy with the names swapped for others of
their list is made; the difference between the two scores is penalised, so that naming a
group does not count as toxic.  Features are chosen by how far their share of toxic texts is
from the base rate; then weights are fitted by gradient descent.

``fit`` gathers at most ``SAMPLE`` labelled texts' features to the driver; the model, one
weight per feature, travels with the plan.  ``score`` is a scan without an exchange.

Defined results: null counts as an empty text, whose score is the bias alone; without
labelled rows every score is 0; several labels of one id count as toxic if one is; labels
that are null or of unknown ids are ignored; ``keep`` columns come back unchanged.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import forget, give_back, slices, texts
from .words import FOLD, find_words, hash_spans, mix, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 20
#: bytes of the word beginnings that are features
BEGINNINGS = (4, 5, 6)
#: labelled texts the model is fitted on, those with the least hash of their id
SAMPLE = 20_000
#: a feature is used if it is in so many sampled texts and its share of toxic ones is this
#: many standard errors above or below the base rate
FEWEST, ERRORS = 4, 4.0
STEPS, RIDGE, COUNTERFACTUAL = 400, 1e-4, 1.0
BATCH = 2 << 20

# Names of groups; a swap takes the next of its list.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives"),
    ("africans", "europeans", "americans", "asians"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def swap_identities(text: str) -> str:
    """The text with every group name replaced by the next of its list."""
    following = {w: group[(i + 1) % len(group)] for group in IDENTITIES for i, w in enumerate(group)}
    pattern = re.compile(rf"\b(?:{'|'.join(sorted(following, key=len, reverse=True))})\b", re.IGNORECASE)
    return pattern.sub(lambda m: following[m[0].lower()], text)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every distinct feature, sorted."""
    data = FOLD[data]
    starts, ends, text = find_words(data, offsets)
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    # words without the marks around them: first and last letter of each
    at = np.flatnonzero(letter)
    if not len(starts) or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.searchsorted(at, starts)
    j = np.searchsorted(at, ends) - 1
    some = i <= j
    first, last, text = at[i[some]], at[j[some]] + 1, text[some]
    found = [mix(hash_spans(data, first, last))]
    owners = [text]
    for n in BEGINNINGS:
        long = last - first > n
        found.append(mix(hash_spans(data, first[long], first[long] + n) + np.uint64(n)))
        owners.append(text[long])
    both = np.unique(
        (np.concatenate(owners).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(found) >> np.uint64(64 - BITS))
    )
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _of_texts(values: list[str]) -> list[np.ndarray]:
    owner, feature = features(*text_bytes(pa.array(values, pa.string())))
    return np.split(feature, np.searchsorted(owner, np.arange(1, len(values))))


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, features and, where a group is named, features after the swap."""
    for batch in slices(batches, 1, BATCH):
        values = texts(batch.column(1))
        swapped = [swap_identities(t) for t in values]
        own = [x.astype("<u4").tobytes() for x in _of_texts(values)]
        changed = [i for i, (a, b) in enumerate(zip(values, swapped)) if a != b]
        other: list = [None] * len(values)
        for i, x in zip(changed, _of_texts([swapped[i] for i in changed]) if changed else []):
            other[i] = x.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(own, pa.binary()), pa.array(other, pa.binary())], names=["label", "own", "swapped"]
        )


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(owner, self.weights[feature], n)[:n]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def train(labels: np.ndarray, own: list[tuple[np.ndarray, np.ndarray]], swapped: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Weights that fit ``labels`` and move little between a text and its swapped copy.

    ``own`` and ``swapped`` hold, batch after batch, the number of features of each text and all of
    them in turn; a text without a swapped copy has none there.  Only chosen features are ever put
    together, so memory is that of the batches.
    """
    size = 1 << BITS
    n = len(labels)
    if not n or labels.min() == labels.max():
        return Model(np.zeros(size), 40.0 if n and labels[0] else -40.0)
    seen, toxic = np.zeros(size), np.zeros(size)
    at = 0
    for counts, flat in own:
        mark = np.repeat(labels[at : at + len(counts)], counts)
        seen += np.bincount(flat, minlength=size)
        toxic += np.bincount(flat, mark, size)
        at += len(counts)
    rate = labels.mean()
    error = np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    used = np.flatnonzero((seen >= FEWEST) & (np.abs(toxic - seen * rate) > ERRORS * error))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))

    def chosen(batches):
        owners, features, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for counts, flat in batches:
            found = place[flat]
            owner = np.repeat(np.arange(at, at + len(counts)), counts)
            owners.append(owner[found >= 0])
            features.append(found[found >= 0].astype(np.int64))
            at += len(counts)
        return np.concatenate(owners), np.concatenate(features)

    owner, feature = chosen(own)
    other_owner, other = chosen(swapped)
    has_copy = np.concatenate([counts > 0 for counts, _ in swapped])
    pairs = int(has_copy.sum())
    here = has_copy[owner]
    left_owner, left = owner[here], feature[here]
    weight = np.where(labels > 0, 0.5 / rate, 0.5 / (1 - rate)) / n
    values = np.zeros(len(used) + 1)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, STEPS + 1):
        score = 1 / (1 + np.exp(-np.clip(values[-1] + np.bincount(owner, values[feature], n)[:n], -40, 40)))
        slope = (score - labels) * weight
        gradient = np.bincount(feature, slope[owner], len(values)).astype(float)
        gradient[-1] = slope.sum()
        if pairs:
            gap = np.bincount(left_owner, values[left], n)[:n] - np.bincount(other_owner, values[other], n)[:n]
            gap = gap * (2 * COUNTERFACTUAL / pairs)
            gradient += np.bincount(left, gap[left_owner], len(values))
            gradient -= np.bincount(other, gap[other_owner], len(values))
        gradient[:-1] += RIDGE * values[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        values -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = values[:-1]
    return Model(weights, float(values[-1]))


def _batches(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Number of features of each row, and all features, of every batch; null has none."""
    out = []
    for chunk in column.chunks:
        binary = chunk.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        data = binary.buffers()[2]
        flat = np.frombuffer(data, "<u4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if data else np.zeros(0, "<u4")
        out.append((np.diff(offsets) // 4, flat))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (id and label) and the texts they belong to; ``sample`` bounds both."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(known), "id")  # at most `sample` pairs of numbers
    rows = rows.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")  # and texts
    got = rows.mapInArrow(_sampler, "label double, own binary, swapped binary").toArrow()
    labels = np.asarray(got.column("label").to_numpy(), np.float64)
    return train(labels, _batches(got.column("own")), _batches(got.column("swapped")))


def _scorer(model: Model, schema: pa.Schema, kept: int):
    used = np.flatnonzero(model.weights)
    values, bias = model.weights[used], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        weights = np.zeros(1 << BITS)
        weights[used] = values
        whole = Model(weights, bias)
        for batch in slices(batches, 0, BATCH):
            scores = whole.scores(*features(*text_bytes(batch.column(0))), batch.num_rows)
            columns = [*batch.columns[1 : kept + 1], pa.array(scores)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        give_back()

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score``, 0 to 1, of every text."""
    source = docs.select(F.col(text_col).alias("t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in source.schema.fields[1:]), T.StructField("s", T.DoubleType())])
    return source.mapInArrow(_scorer(model, to_arrow_schema(out), len(keep)), out).toDF(*keep, "score")


def held_out(id_col: str = "doc_id"):
    """Whether an id is kept out of training: crc32 of its text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
