"""Tokens of two tokenizers aligned by bytes, against whole texts encoded one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as tokenizers
import pytest
import sentencepiece
from gridlake.llm import alignment
from tokenizers import Tokenizer

from .conftest import DOCS

A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = dict(zip(map(chr, printable), printable))
    for n, byte in enumerate(x for x in range(256) if x not in printable):
        stand[chr(256 + n)] = byte
    names = {i: bytes(stand[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    return a, b, names


def tokens(text, libraries):
    a, b, names = libraries
    if not text:
        return [], []
    first = [(i, names[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text, return_type="numpy").tolist():
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    if any(b"".join(x for _, x in some) != data for some in (first, second)):
        return [], []
    return first, second


def groups(first, second):
    out, group, at = [], ([], []), [0, 0]
    rows = (iter(first), iter(second))
    while True:
        side = 0 if at[0] <= at[1] else 1
        token = next(rows[side], None)
        if token is None:
            return out
        group[side].append(token[0])
        at[side] += len(token[1])
        if at[0] == at[1]:
            out.append(group)
            group = ([], [])


def brute(texts, libraries):
    found = [groups(*tokens(t, libraries)) for t in texts]
    links = [Counter((a, b) for x, y in gs for a in x for b in y) for gs in found]
    count = Counter(p for c in links for p in c)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    rows = []
    for gs, c in zip(found, links):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        rows.append(
            (
                sum(len(x) for x, _ in gs),
                sum(len(y) for _, y in gs),
                len(gs),
                sum(c.values()),
                sum(n for p, n in c.items() if count[p] == highest[p[0]]),
                sum(n * count[p] for p, n in c.items()),
                hashlib.sha256(line.encode()).hexdigest() if gs else "",
            )
        )
    return rows


def check(docs, libraries, **options):
    rows = docs.select("doc_id", "text").collect()
    want = Counter(zip((r.doc_id for r in rows), brute([r.text for r in rows], libraries)))
    got = alignment.align_tokenizers(docs, A, B, **options)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((r[0], tuple(r[1:])) for r in got.collect()) == want
    return want


def test_alignment_of_awkward_texts(awkward, libraries):
    check(awkward, libraries)


def test_alignment_in_small_blocks(awkward, libraries):
    check(awkward, libraries, block_bytes=300)


ODD = [
    "日本語の文章、naïve café 🙂🙂🏽‍",
    "<|endoftext|> <s> </s> <0x41> <unk>",
    "a▁b is changed",
    "▁",
    "tabs\t\tand  spaces   \n\n \r\n end \r",
    "x\r\ny\r z\r\r\n q　r s\x85t\x1cu\x0bv\x0cw",
    " ",
    "\n",
    "  leading and trailing  \n ",
    "\x00\x01\x7f﻿\U000f0000",
    "a" * 20_000,
    "日" * 5_000,
    "".join(chr(0x1F300 + i % 300) for i in range(3_000)),
    "don't we'll I'D 1234567 3.14159 foo(bar); }\r\n",
]


def test_alignment_of_odd_characters(spark, libraries):
    check(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string").repartition(3), libraries)


def test_alignment_of_random_texts(spark, libraries):
    rng = random.Random(5)
    alphabet = " \n\t\r  　abcdeé日🙂▁'0.,{}()\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(600)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), libraries)


def test_a_long_group_counts_distinct_ids():
    import numpy as np

    a, b = np.array([1, 2] * 100), np.array([3] * 100 + [4])
    group, pair, links = alignment.group_links(a, b, np.array([200]), np.array([101]))
    assert sorted(zip((pair >> 32).tolist(), (pair & 0xFFFFFFFF).tolist(), links.tolist())) == [
        (1, 3, 10_000), (1, 4, 100), (2, 3, 10_000), (2, 4, 100)
    ]


def test_spans_are_refined_inside_characters():
    import numpy as np

    # a character of four bytes cut 1 + 1 + 2 between whole ones
    begins, ends = np.array([0, 1, 1, 1, 5]), np.array([1, 5, 5, 5, 7])
    assert alignment.byte_ends(begins, ends, np.array([1, 1, 1, 2, 2])).tolist() == [1, 2, 3, 5, 7]


def test_alignment_of_nothing(no_docs, spark):
    assert alignment.align_tokenizers(no_docs, A, B).count() == 0
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_tokenizers(blank, A, B).collect()), key=str) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")
    ]


def test_clashing_columns(spark, libraries):
    rows = [(1, "one two", 5, "x", 2), (2, "one", 5, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, pos string, count int")
    check(docs, libraries)
    assert DOCS
