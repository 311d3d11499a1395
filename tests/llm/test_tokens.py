"""Byte-level BPE against tiktoken, packing against the tokenizers library."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from gridlake.llm import bpe, packing
from tokenizers import Tokenizer

RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_tiktoken(awkward, coder):
    got = bpe.encode_documents(awkward, RANKS, tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in awkward.collect())
    for row in got:
        ids = coder.encode_ordinary(texts[row.doc_id])
        assert row.ids == ",".join(map(str, ids)), row.doc_id
        assert row.n_tokens == len(ids)
        assert bytes(row.decoded).decode() == texts[row.doc_id]


def test_bpe_long_pieces_and_small_batches(spark, coder):
    texts = ["a" * 3000, "ab" * 700, "strasse" * 90 + "!" * 257, "é" * 500, "9" * 333 + "x" * 49, " \n" * 60 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(docs, RANKS, tokenizers.PATTERN, batch_bytes=64).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(map(str, coder.encode_ordinary(t)))


def test_bpe_white_space_is_that_of_the_library(spark, coder):
    texts = [f"a{chr(c)}{chr(c)}b {chr(c)} c" for c in [*range(1, 48), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x202F, 0x3000, 0x180E, 0xFEFF]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode_documents(docs, RANKS, tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(map(str, coder.encode_ordinary(t))), repr(t)


def test_bpe_of_nothing(no_docs):
    assert bpe.encode_documents(no_docs, RANKS, tokenizers.PATTERN).count() == 0


def test_bpe_decodes_the_ids_of_the_document(coder):
    """A fault in the remembered ids of a unit shows in the decoded bytes."""
    import pyarrow as pa

    rank_file = open(RANKS, "rb").read()
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["one two one"])], names=["doc_id", "text"])
    run = bpe._encoder(rank_file, tokenizers.PATTERN, 1 << 20)
    (got,) = run(iter([batch]))
    assert got.column("decoded").to_pylist() == [b"one two one"]
    held = bpe._coder(rank_file, tokenizers.PATTERN)
    try:
        ids = ",".join(map(str, coder.encode_ordinary(" three"))).encode()
        was = held.known[" two"]
        held.known[" two"] = ids if isinstance(was, bytes) else (ids, *was[1:])
        (got,) = run(iter([batch]))
        assert got.column("decoded").to_pylist() == [b"one three one"]
    finally:
        held.known[" two"] = was


def check_packing(rows, expected, most=4096):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for doc_id, ids in expected.items():
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert all(r.doc_tokens == len(ids) and r.length * 4 == len(r.ids) for r in own)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert 0 < at <= most
        total += at
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding / max(1, total)


def test_packing_keeps_every_id(awkward):
    tok = Tokenizer.from_file(WORDS)
    docs = awkward.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    expected = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack_documents(docs, WORDS).collect()
    assert check_packing(rows, expected) < 0.05
    assert [r.length for r in rows if r.doc_id == 4] == [1]  # a null text is the end id


def test_packing_repeated_rows_and_null_ids(awkward):
    rows = packing.pack_documents(awkward, WORDS).collect()
    assert sum(r.start == 0 for r in rows if r.doc_id == 9) == 2
    assert any(r.doc_id is None for r in rows)


def test_packing_codes_special_strings_as_the_library(spark):
    tok = Tokenizer.from_file(WORDS)
    ends = ("<|endoftext|>", "<|startoftext|>")
    texts = ["one <|endoftext|> two", "One<|endoftext|>two, <|ENDOFTEXT|>", "<|endoftext|>", "a.<|startoftext|>, b", "<|endof text|>"]
    texts += [f"{a}{x}{b}" for x in ends for a in ("", "é", "9.", "it'", " \n") for b in (".5", "s,", "\u0301", ends[1], "  ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert expected[0] == [637, 49407, 1237, 2]
    check_packing(packing.pack_documents(docs, WORDS).collect(), expected)


def test_packing_of_nothing(no_docs):
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_cuts_match_a_plain_dynamic_programme():
    rng = np.random.default_rng(5)
    for _ in range(30):
        cuts = np.unique(np.append(0, rng.integers(1, 400, 60)))
        penalty = rng.integers(0, 20, len(cuts)).astype(float)
        most = 128
        cost = [0.0] + [np.inf] * (len(cuts) - 1)
        for i in range(1, len(cuts)):
            for j in range(i):
                n = int(cuts[i] - cuts[j])
                if n <= most:
                    pad = 0 if n in (most, most // 2, most // 4) else most - n
                    cost[i] = min(cost[i], cost[j] + pad + penalty[i] + packing.SEQUENCE)
        ends = packing.choose_ends(cuts, penalty, most)
        paid, at = 0.0, 0
        for e in ends:
            n = int(e - at)
            assert n <= most
            paid += (0 if n in (most, most // 2, most // 4) else most - n) + penalty[np.searchsorted(cuts, e)] + packing.SEQUENCE
            at = e
        assert at == cuts[-1] and paid == pytest.approx(cost[-1])


def test_crc_is_that_of_the_ids(awkward):
    from pyspark.sql import functions as F

    for r in packing.pack_documents(awkward, WORDS).withColumn("crc", F.crc32("ids")).limit(5).collect():
        assert r.crc == zlib.crc32(bytes(r.ids))


def test_empty_text_digest(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for r in bpe.encode_documents(docs, RANKS, tokenizers.PATTERN).collect():
        assert (r.n_tokens, r.ids, bytes(r.decoded)) == (0, "", b"")
        assert hashlib.sha256(bytes(r.decoded)).hexdigest().startswith("e3b0c442")


def test_packing_codes_random_words_as_the_library():
    import random

    rng = random.Random(4)
    tok = Tokenizer.from_file(WORDS)
    memo = packing._tokenizer(open(WORDS, encoding="utf-8").read())
    alphabet = "abzABZéÉßİıǅ日한가0٣²Ⅷ'.,-_#<|>\u0301\u200d🙂\xa0\x85\x1c\u3000 \n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    texts += ["<|ENDOFTEXT|>", "a<|Endoftext|>b", "don't I'll x's", "İstanbul", "\u1100\u1161", "." * 3000, "é" * 3000]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        got = packing.encode_words(memo, [packing.split_words(t.encode(), memo["pattern"]) for t in some])
        for t, data in zip(some, got):
            assert np.frombuffer(data, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)
