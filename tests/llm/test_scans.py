"""Secrets, personal data, licences, toxicity and fingerprints against plain Python."""

import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from gridlake.llm import licenses, pii, secrets, toxicity, winnowing
from gridlake.llm.words import text_bytes
from pyspark.sql import functions as F

from .conftest import prose

ASSIGN = re.compile(secrets.ASSIGN)


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[r]}:{s}:{e}" for s, r, e in sorted(out))


def base_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in sorted(out))


def noisy(seed, alphabet, n=400):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_secrets_match_plain_patterns(spark, awkward):
    marks = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", "'", '"', " ", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "x", "é", "🙂", "\n"]
    extra = [(1000 + i, noisy(i, marks, 120), "en", "src9", 1, "s", "r", 1) for i in range(60)]
    docs = awkward.unionAll(spark.createDataFrame(extra, awkward.schema))
    got = secrets.find_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source")).collect()
    texts = Counter((r.doc_id, base_secrets(r.text or "")) for r in docs.collect())
    assert Counter((r.doc_id, r.base) for r in got) == texts
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
        kinds = Counter(s.split(":")[0] for s in r.base.split(",") if s)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])


def test_ownership_separates_copied_from_live(spark):
    shared, own = "password=Zx81Qw72Er63Ty54", "token=Mn19Bv28Cx37Za46"
    generic, spread = "k9QmW2xR7tLp4VbN8sDf3GhJ6", "Zq8WnE5rT2yU9iO4pA7sD1fG6"
    rows = [(i, f"{shared} {spread}", f"s{i % 4}") for i in range(8)] + [(100, f"{own} {generic}", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.find_secrets(docs, F.col("source"), F.col("source")).collect()}
    assert all((got[i].n_copied, got[i].n_live, got[i].spans) == (1, 0, "assign:0:25") for i in range(8))
    assert (got[100].n_live, got[100].n_copied) == (2, 0)
    assert got[100].spans == "assign:0:22,generic:23:48"


def test_many_secrets_in_one_text(spark):
    rng = random.Random(8)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(100_000)]
    mixed = " ".join(f"token={v.replace('a', 'Q')}" for v in values[:20_000])
    docs = spark.createDataFrame([(1, " ".join(values)), (2, mixed)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.find_secrets(docs, F.lit("r"), F.lit("o")).select("doc_id", "base", "n_hex").collect()}
    assert time.time() - began < 30
    assert got[1].n_hex == 100_000 and all(got[i].base == base_secrets(t) for i, t in docs.collect())


def test_private_keys_of_any_heading(spark):
    text = "-----BEGIN VERY LONG AND WELL GUARDED RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.find_secrets(docs, F.lit("r"), F.lit("o")).first().spans == f"provider:0:{len(text)}"


def test_secrets_use_no_python(awkward):
    plan = awkward.select(secrets.candidates(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scans_of_nothing(no_docs):
    assert secrets.find_secrets(no_docs, F.col("source"), F.col("source")).count() == 0
    assert pii.find_personal_data(no_docs).count() == 0
    assert winnowing.compare_edited(no_docs).count() == 0
    assert licenses.scan_licenses(no_docs, F.col("source")).count() == 0


def test_personal_data_matches_plain_patterns(spark, awkward):
    marks = ["a", "b.c", "@", "+", "-", ".", " ", "1", "22", "4111 1111 1111 1111", "10.0.0.1", "+1 (988) 555-2485", "%", "é", "(", "com"]
    extra = [(1000 + i, noisy(i, marks, 150), "en", "src9", 1, "s", "r", 1) for i in range(150)]
    docs = awkward.unionAll(spark.createDataFrame(extra, awkward.schema))
    got = pii.find_personal_data(docs).collect()
    assert Counter((r.doc_id, r.base) for r in got) == Counter((r.doc_id, base_pii(r.text or "")) for r in docs.collect())


def test_personal_data_further_kinds_and_masks():
    find = pii.Finder().find
    text = "See ftp://bob:pw@host/x, IBAN DE89 3704 0044 0532 0130 00 and account no. 12345678; DE00 3704 0044 0532 0130 00."
    spans = find(text)
    assert [(pii.KINDS[r], text[s:e]) for s, r, e in spans if r >= pii.BASE] == [
        ("login", "bob:pw"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("account", "12345678"),
    ]
    assert pii.redact("mail a@b.cd now", find("mail a@b.cd now")) == "mail <EMAIL> now"
    assert pii.redact("clean", []) == "clean"


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("Account Number: 12345678", "12345678"),
        ("Account No. 12345678", "12345678"),
        ("ACCOUNT NO: 12345678.", "12345678"),
        ("Social Security Number 123-45-6789", "123-45-6789"),
        ("sOCIAL sECURITY 123 45 6789", "123 45 6789"),
        ("account 1234 5678 9012, then", "1234 5678 9012"),
        ("account number is 12345678", "12345678"),
        ("Account Is: 123.456.789", "123.456.789"),
        ("\u0130 PassPort ID12345678", "ID12345678"),
        ("account 12-345678-AB", "12-345678-AB"),
        ("account 12345678 2020", "12345678"),
        ("accountant 12345678", None),
        ("account nobody 12345678", None),
        ("account 25 2020", None),
    ],
)
def test_account_numbers_in_their_written_forms(text, number):
    assert [text[s:e] for s, r, e in pii.Finder().find(text) if pii.KINDS[r] == "account"] == ([number] if number else [])


def test_long_runs_of_personal_data_take_linear_time():
    find = pii.Finder().find
    number = "AB" + "1234567890" * 6
    assert [(s, e) for s, r, e in find(f"account {number}, then") if r == 5] == [(8, 8 + len(number))]
    assert [(s, e) for s, r, e in find(f"account {number}-78-xy") if r == 5] == [(8, 11 + len(number))]
    began = time.time()
    assert find("1" * 200_000 + ".2") == [] and find("IBAN" * 50_000) == []
    assert find("IBAN" * 50_000 + "1234") == [(4, 5, 200_004)]
    assert find("IBAN" * 50_000 + "1234x") == [] and find("1.2.3." + "4" * 100_000 + " 7.7.7.7")[-1][1] == 1
    assert time.time() - began < 20


def plain_tokens(text):
    words = re.findall(r"\S+", (text or "").lower(), re.ASCII)
    return [t for word in words for t in ([word] if len(word) <= 16 else word)]


def plain_winnow(text, k, w):
    """Positions kept, and the hash at each, chosen one window after the other."""

    def chained(parts):
        h = 42
        for part in parts:
            h = xxhash.xxh64(part, seed=h).intdigest()
        return h

    found = [struct.pack("<Q", chained([t.encode()])) for t in plain_tokens(text)]
    grams = [chained(found[i : i + k]) >> 32 for i in range(max(1, len(found) - k + 1))] if found else []
    kept = {}
    for start in range(max(1, len(grams) - w + 1)) if grams else []:
        least = min((h, -p) for p, h in enumerate(grams[start : start + w], start))
        kept[-least[1]] = least[0]
    return kept


def plain_likeness(a, b):
    a, b = set(a.values()), set(b.values())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_matches_windows_one_by_one(spark, awkward):
    k, w = 5, 12
    docs = awkward.dropDuplicates(["doc_id"])
    rows = winnowing.compare_edited(docs, k, w).withColumn("positions", winnowing.positions(F.col("kept"))).collect()
    order = sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: -r.doc_id)
    order += [r for r in docs.collect() if r.doc_id is None]
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(order)
    for i, r in enumerate(order):
        text, after = r.text or "", order[(i + 1) % len(order)].text or ""
        n = len(text) // 3
        mine = got[r.doc_id]
        assert mine.edited == text[: len(text) - n] + after[:n]
        own, edited, following = (plain_winnow(t, k, w) for t in (text, mine.edited, after))
        assert mine.positions == sorted(own)
        assert mine.fingerprint == ",".join(f"{own[p]:08x}" for p in sorted(own))
        assert mine.edited_fingerprint == ",".join(f"{edited[p]:08x}" for p in sorted(edited))
        assert mine.near_edited == pytest.approx(plain_likeness(own, edited))
        assert mine.near_next == pytest.approx(plain_likeness(own, following))
    assert got[0].fingerprint == got[1].fingerprint
    assert got[5].fingerprint == "" and got[4].fingerprint == ""


def test_winnowing_sees_shifts_in_texts_without_spaces(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    docs = spark.createDataFrame([(2, text), (1, "x" + text)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in winnowing.compare_edited(docs).collect()}
    assert got[2] > 0.9 and got[1] > 0.9


def test_winnowing_splits_repeated_ids_and_lines_up_sparse_ones(spark):
    """Rows of one id, and of none, are many; each row is followed by one other row, in a single ring."""
    rows = [(7, f"seven {i}") for i in range(200)] + [(None, f"none {i}") for i in range(150)]
    rows += [(i * 10**12, f"far {i}") for i in range(-3, 4)] + [(i, f"near {i}") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = winnowing.with_next(docs, "doc_id", "text", {}).collect()
    after = {r.text: r.next_text for r in got}
    assert len(got) == len(rows) and sorted(after) == sorted(after.values()) == sorted(t for _, t in rows)
    ids, at, ring = dict((t, i) for i, t in rows), "far 3", []
    for _ in rows:
        ring.append(ids[at])
        at = after[at]
    known = [i for i in ring if i is not None]
    assert at == "far 3" and known == sorted(known, reverse=True) and ring[len(known) :] == [None] * 150


def test_winnowing_keeps_the_rightmost_of_equal_hashes(spark):
    row = spark.sql("SELECT 'aa bb aa bb aa bb aa bb aa bb aa bb' AS text").select(winnowing.winnow(F.col("text"), 2, 4).alias("k")).first()
    at = [winnowing._TOP - (v & winnowing._TOP) for v in row.k]
    least = min(v >> winnowing.POSITION_BITS for v in row.k)
    assert {v >> winnowing.POSITION_BITS for v in row.k} == {least}
    assert at[0] in (2, 3) and all(b - a == 2 for a, b in zip(at, at[1:]))


def test_winnowing_finds_shared_passages(spark):
    shared = prose(50, 16)
    rows = [(i, f"{prose(100 + i, 40)} {shared} {prose(200 + i, 30)}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [set(r.h) for r in docs.select(winnowing.hashes(winnowing.winnow(F.col("text"))).alias("h")).collect()]
    assert all(a & b for a in kept for b in kept)


def test_license_scores_match_plain_tf_idf(spark):
    said = ["Licensed under the MIT License.", "licensed under CC BY-NC 4.0", "Copyright 2020 nobody.", "This licence is odd.", "", prose(1, 60)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    tokens = lambda s: re.findall(r"[a-z0-9]+", s.lower().replace("licence", "license"))
    df = Counter(t for s in said for t in set(tokens(s)))
    holders = {}
    for name, text in licenses.TEMPLATES:
        for t in tokens(text):
            holders.setdefault(t, set()).add(name)
    n = len({name for name, _ in licenses.TEMPLATES})

    def vector(s):
        rare = {t: math.log((len(said) + 1) / (df[t] + 1)) + 1 for t in tokens(s)}
        return {t: c * rare[t] * (math.log((n + 1) / (len(holders.get(t, ())) + 1)) + 0.1) for t, c in Counter(tokens(s)).items()}

    def cosine(a, b):
        dot = sum(x * b.get(t, 0) for t, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0

    want = {}
    for i, s in enumerate(said):
        score, name = min((-round(cosine(vector(s), vector(t)), 9), name) for name, t in licenses.TEMPLATES)
        want[i] = (name, -score) if -score >= licenses.COSINE else (None, None)
    got = {r.doc_id: (r.own_license, r.own_score) for r in licenses.scan_licenses(docs, F.lit(None).cast("string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want if want[k][0])
    assert want[0][0] == "MIT" and want[1][0] == "CC-BY-NC-4.0" and want[5][0] is None


def test_licenses_in_their_written_forms(spark):
    grant = licenses._MIT_GRANT
    said = {
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "MIT License": "MIT",
        grant: "MIT",
        "\n".join(grant[i : i + 60] for i in range(0, len(grant), 60)): "MIT",
        "GPL-3.0-or-later": "GPL-3.0",
        "SPDX-License-Identifier: Nobodys-Own-7.3": None,
        "All rights reserved.": "Proprietary",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Released under the MIT Licence.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "The lease may be renewed under the conditions that the owner of the house has set out.": None,
    }
    rows = [(i, text) for i, text in enumerate(said)] + [(100 + i, prose(i, 200)) for i in range(40)]
    rows += [(200, f"{prose(7, 150)}. Released under the MIT License. {prose(8, 90)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(docs, F.lit(None).cast("string")).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
    assert got[200] == "MIT" and {got[100 + i] for i in range(40)} == {None}


def test_license_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", f"{mit} {prose(1, 50)}"),
        (2, "a/b/c/x.txt", "plain"),
        (3, "a/b/COPYING.txt", gpl),
        (4, "a/b/c/d/y.txt", None),
        (5, "z/q.txt", "plain"),
        (6, "a/own.txt", f"{prose(2, 300)}\n{gpl}"),
        (7, None, ""),
        (8, "a/other/w.txt", ""),
        (8, "a/other/w.txt", ""),
        (9, "top.txt", "plain"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = licenses.scan_licenses(files, F.col("path")).collect()
    assert len(got) == len(rows)
    want = {1: ("MIT", "own"), 2: ("GPL-3.0", "inherited"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: (None, "none")}
    want |= {6: ("GPL-3.0", "own"), 7: (None, "none"), 8: ("MIT", "inherited"), 9: (None, "none")}
    assert {r.doc_id: (r.license, r.how) for r in got} == want


def test_toxicity_held_out_and_counterfactual(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = prose(i, rng.randrange(0, 60), 300)
        if rng.random() < (0.5 if toxic else 0.1):
            text += " women"  # a group name that goes with the label in these rows
        if toxic:
            text += rng.choice([" grumblix!", " Vexnort.", " vexnorten"])
        rows.append((i, text, "clash"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "women", "x"), (1003, "men", "x"), (None, "vexnort", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (5, 1), (None, 1), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    wrong = [i for i, t in labels if by_id[i].held and (by_id[i].score >= 0.7) != bool(t)]
    assert len(wrong) <= 4
    assert all(0 <= r.score <= 1 for r in got)
    assert by_id[1000].score == by_id[1001].score
    # naming a group is not toxic: swapping it hardly moves the score
    assert abs(by_id[1002].score - by_id[1003].score) < 0.1 and by_id[1002].score < 0.7


def test_toxicity_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 1e-9 for r in toxicity.score(awkward, toxicity.fit(awkward, none)).collect()} == {True}


def test_swaps_stay_in_their_list():
    assert toxicity.swap_identities("Women and men, immigrants") == "men and women, refugees"
    assert toxicity.swap_identities("omen") == "omen"


def test_features_are_sets_of_words_and_beginnings():
    import pyarrow as pa

    owner, feature = toxicity.features(*text_bytes(pa.array(["Idiotic, idiotic!", None, "...", "idiotic"])))
    assert (feature[owner == 0] == feature[owner == 3]).all() and set(np.unique(owner)) == {0, 3}


def test_logins_of_any_length_are_found(spark):
    user, password = "u" * 70, "p" * 130
    texts = [f"see https://{user}@host.example and ftp://bob:{password}@h/x", "http://" + "a" * 200_000, "https://a:b/c@d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.find_personal_data(docs).collect()}
    found = {i: {texts[i][int(a) : int(b)] for kind, a, b in s if kind not in ("email", "ip", "card", "phone")} for i, s in spans.items()}
    assert {user, f"bob:{password}"} <= found[0] and not found[1] and not found[2]


def test_toxicity_learns_from_one_row_per_id(spark):
    words = ["fine day", "awful idiot"]
    rows = [(i, words[i % 2]) for i in range(40)] + [(1, words[1])] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model, once = (toxicity.fit(d, labels) for d in (docs, docs.dropDuplicates(["doc_id"])))
    assert np.allclose(model.weights, once.weights, atol=1e-6) and abs(model.bias - once.bias) < 1e-6
