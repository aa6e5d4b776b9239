"""Edge cases and brute-force results of the operators on texts."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import bpe, license_scan, line_dedup, mixing, quality_classifier, quality_rules
from quirework.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""))


# -- line dedup


def test_lines_on_many_pages_of_a_host_go(spark):
    rows = [doc(i, f"Menu\nown line {i}\n\n  Menu \n", "big") for i in range(20)] + [doc(100 + i, f"Menu\nother {i}", "small") for i in range(3)] + [doc(200, None, None), doc(None, "Menu\nx", "big")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.5, prior=2).collect()}
    assert got[3].text == "own line 3\n\n" and got[3]._n_lines == 3 and got[3]._n_dropped == 2
    assert got[101].text == "other 1" and got[101]._n_dropped == 1
    assert got[200].text is None and got[200]._n_lines == 0
    assert got[None].text == "x"


def test_line_dedup_of_repeated_rows_and_empty_tables(spark):
    rows = [doc(1, "A\nB")] * 6
    got = line_dedup.drop_boilerplate(docs(spark, rows), ratio=0.5, prior=4).collect()
    assert [r.text for r in got] == [""] * 6
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


def test_line_dedup_equals_brute_force_at_any_size_of_a_host(spark):
    rnd = random.Random(4)
    rows = []
    for host, pages in (("one", 1), ("two", 2), ("nine", 9), ("ten", 10), ("many", 300), (None, 40)):
        for i in range(pages):
            lines = [rnd.choice(["Menu", " Menu\t", "", "é |", f"own {host} {i} {rnd.random()}", rnd.choice("abcdefghijklmnopqrstuvwxyz") * 3]) for _ in range(rnd.randint(0, 12))]
            rows.append(doc(len(rows), "\n".join(lines), host))
    rows += [doc(9000, "long line " * 20_000 + "\nMenu\n" + "\n".join(f"{i}" for i in range(3000)), "many"), doc(9001, None, "many")]
    space = " \t\n\x0b\x0c\r"
    pages, on = {}, {}
    for _, t, _, host, _ in rows:
        pages[host] = pages.get(host, 0) + 1
        for x in {x.strip(space) for x in (t or "").split("\n")} - {""}:
            on[host, x] = on.get((host, x), 0) + 1
    bad = lambda host, x: bool(x.strip(space)) and on[host, x.strip(space)] > (pages[host] + 30) * 0.05
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if not bad(host, x)) for i, t, _, host, _ in rows}
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert got == want and sum(got[i] != t for i, t, *_ in rows) > 100


# -- licences


def test_licence_notices(spark):
    rows = [
        doc(1, "Some words that go before and are no notice at all.\nLicensed under the Apache License, Version 2.0.\nMore."), doc(2, "LICENSED UNDER CC BY-NC 4.0"), doc(3, "licensed to drive"), doc(4, None), doc(5, ""), doc(6, "word " * 50_000),
        doc(7, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ]
    got = {r.doc_id: [(h.license, round(h.dice, 3)) for h in r._hits] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[1] == [("Apache-2.0", 1.0)] and got[2] == [("CC-BY-NC-4.0", 1.0)] and got[7] == [("GPL-3.0-or-later", 1.0)]
    assert got[3] == got[4] == got[5] == got[6] == []
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_licence_notices_within_lines_and_longer_texts(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    code = "\n".join(f"x{i} = call of the thing under version {i}" for i in range(300))
    rows = [
        doc(1, "(c) 2021 Foo Inc. All rights reserved."), doc(2, "Copyright 2021 Foo. Released under the MIT License."), doc(3, f"#!/bin/sh\n# Tool of the year.\n#\n# {gpl}\n#\n{code}"),
        doc(4, "One part is licensed under CC BY 4.0, the other is licensed under CC BY-SA 4.0; all rights reserved, as ever. Licensed under CC BY 4.0!"), doc(5, "all the rights are reserved under the license of the mit"),
        doc(6, f"Some words.\nReleased under the MIT License.\n{code}"), doc(7, code + " and more words that are released\nunder the MIT\nLicense"), doc(8, None),
    ]
    got = {r.doc_id: [(h.license, round(h.dice, 3)) for h in r._hits] for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[1] == [("LicenseRef-proprietary", 1.0)] and got[2] == [("MIT", 1.0)] and got[3] == [("GPL-3.0-or-later", 1.0)] and got[7] == [("MIT", 1.0)]
    assert sorted(got[4]) == [("CC-BY-4.0", 1.0), ("CC-BY-SA-4.0", 1.0), ("LicenseRef-proprietary", 1.0)]
    bound = license_scan.scan(docs(spark, [doc(1, "A.\nAll rights reserved.")])).collect()[0]._hits
    assert [h.dice for h in bound] == [1.0, 0.8]  # the whole text is at the bound itself
    assert got[5] == got[8] == [] and got[6] == [("MIT", 1.0)]  # a notice alone on its line is one hit


def test_whole_licences_and_names(spark):
    by = {}
    for name, text in license_scan.TEMPLATES:
        by.setdefault(name, []).append(text)
    isc, bsd = "\n".join(by["ISC"][:2]).replace(" the ", "\nthe "), "\n".join(f"{i}. {x}" for i, x in enumerate(by["BSD-2-Clause"][:2]))
    rows = [doc(1, isc), doc(2, bsd), doc(3, "// SPDX-License-Identifier: MIT"), doc(4, "One line that says it is licensed under the MIT License, as files are, and goes on with other words after it for long."), doc(5, ("the software and of the work in the " * 20_000) + by["MIT"][-2]), doc(6, "of the and or the in the any purpose with")]
    got = {r.doc_id: sorted({h.license for h in r._hits}) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got == {1: ["ISC"], 2: ["BSD-2-Clause"], 3: ["MIT"], 4: ["MIT"], 5: ["MIT"], 6: []}


# -- quality rules


def brute(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def test_measures_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["a ", "b ", "é ", "c\n", "$ ", "\x0b", "dd | ", "\x1c"]) for _ in range(rnd.randint(0, 150)))
        assert quality_rules.measure(text)[:6] == brute(text)
    assert quality_rules.measure(None)[:6] == brute(None)


def test_verdicts(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) + "." for i in range(5))
    menu = "\n".join(" | ".join(f"m{i}x{j}" for j in range(20)) for i in range(5))
    rows = [doc(1, prose), doc(2, menu), doc(3, None), doc(4, "x " * 100), doc(None, prose), doc(6, prose + "\n" + menu[:200])]
    d = docs(spark, rows).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert [got[i]._kept for i in (1, 2, 3, 4, None, 6)] == [True, False, False, False, True, True]
    assert not got[2]._base_failed and got[4]._base_failed
    assert quality_rules.keep(d).columns == d.columns and quality_rules.keep(docs(spark, [])).count() == 0


def test_failed_lines_of_kept_documents_go(spark):
    rnd = random.Random(7)
    prose = lambda i: " ".join(f"w{i}x{j}" for j in range(20)) + "."
    bad = ["Home | News | Mail", "READ THE NEWS", "## ** $$ a", "Subscribe to our newsletter", " Click here \r"]
    rows = [doc(i, "\n".join(rnd.choice([prose(f"{i}y{k}"), rnd.choice(bad), "", " "]) for k in range(rnd.randint(0, 30)))) for i in range(60)]
    rows += [doc(900, None), doc(901, "Home | News\n" + "\n".join(map(prose, "abc"))), doc(902, "\n".join(map(prose, "abc")) + "\nHome | News\n"), doc(903, "\n".join([prose(x) for x in "abcdd"] + ["Home | News"]))]
    cut = {i: "\n".join(x for x in t.split("\n") if x not in bad and x != "Home | News") for i, t, *_ in rows if t is not None}
    judged = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows), lines=True).collect()}
    for i, t, *_ in rows:
        assert judged[i]._clean == (None if t is None else cut[i])
        assert [t[a:b] for a, b in judged[i]._lost_spans] == [x for x in (t or "").split("\n") if x in bad or x == "Home | News"]
    want = {i: (cut[i], len(cut[i])) for i, t, *_ in rows if quality_rules.measure(t)[-1]}
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality(spark, docs(spark, rows), "").collect()}
    assert got == want and any(cut[i] != t for i, t, *_ in rows if i in want) and {901, 902, 903} <= want.keys()
    # a line that repeats in a text of repeats stays once
    again = "\n".join([prose("a"), prose("b"), prose("c"), prose("d")] + ["x y"] * 9)
    assert quality_rules.examine(again)[0][-1] and quality_rules.without(again, quality_rules.examine(again)[1]) == "\n".join([prose("a"), prose("b"), prose("c"), prose("d"), "x y"])


# -- byte pairs


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


def test_every_token_encodes_to_itself(vocab):
    table = bpe.Vocabulary(vocab[0])
    assert all(table.merge_all(k) == [r] == table.match(k) for k, r in vocab[0].items())


def library(vocab):
    return tiktoken.Encoding("ref", pat_str=vocab[1], mergeable_ranks=vocab[0], special_tokens={})


@pytest.mark.parametrize("leaf", [7, 48, bpe.TEXT_LEAF])
def test_encoding_equals_the_library(vocab, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "TEXT_LEAF", leaf)
    ref, rnd = library(vocab), random.Random(5)
    encoder = bpe.Encoder(bpe.Vocabulary(vocab[0]), vocab[1], memo=500)
    for _ in range(700):
        letters = rnd.choice(["ab", "a", "a b\n", "aé ", "th e\t\n '1", "日本 a", "x0 .!'s", "  a ", " \n", "<|endoftext|> ", "'lvres dmt", "' ", " \xa0a", "the of and 12 "])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 400)))
        before = encoder.joins
        assert encoder.encode(text) == ref.encode_ordinary(text), text
        # the result comes up the tree: a join for every leaf but the first
        assert encoder.joins - before == max(0, -(-len(text) // bpe.TEXT_LEAF) - 1)
    for text in ("a" * 9000, "".join(rnd.choice("abcdefgh") for _ in range(9000)), " " * 5000 + "x", "'l" * 3000, "日本" * 3000, "!" * 3000 + " !" * 50):
        assert encoder.encode(text) == ref.encode_ordinary(text)


def test_joins_of_tokens_equal_encoding_the_whole(vocab):
    table, rnd = bpe.Vocabulary(vocab[0]), random.Random(6)
    for _ in range(1000):
        data = bytes(rnd.choice(rnd.choice([b"ab", b"the and", bytes(range(256))])) for _ in range(rnd.randint(0, 600)))
        cut = rnd.randint(0, len(data))
        assert table.join(table.merge_all(data[:cut]), table.merge_all(data[cut:])) == table.merge_all(data)
        if len(data) > 1:
            singles = [table.single[x] for x in data]
            assert table.merge_long(singles) == table.merge_all(data)


def test_round_trip_and_digests(spark, vocab):
    texts = ["", None, "Hello  world\n\n", "naïve café " * 3000, "日本語<|endoftext|>", "x" * 20000]
    ref = library(vocab)
    rows = [doc(i, t) for i, t in enumerate(texts)] + [doc(2, texts[2]), doc(None, "a null id"), doc(2**63 - 1, "b")]
    d = docs(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("token_ids", F.lit("clash"))
    got = sorted((tuple(r) for r in bpe.digests(d, *vocab).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs(spark, []), *vocab).count() == 0
    there = bpe.encode(d.withColumn("decoded", F.lit("clash")), *vocab)
    assert there.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "decoded", "token_ids"]
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(there, vocab[0]).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}
    odd = spark.createDataFrame([(1, None), (2, [64, None]), (3, [-1]), (4, [10**9]), (5, [])], "i int, token_ids array<int>")
    assert {r.i: r.decoded for r in bpe.decode(odd, vocab[0]).collect()} == {1: b"", 2: None, 3: None, 4: None, 5: b""}


# -- mixing


def water_fill(sizes, weights, budget, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) >= most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
        if not open_:
            return target


def test_targets_equal_water_filling(spark):
    rnd = random.Random(1)
    for _ in range(4):
        sizes = {s: rnd.choice([0, 3, 50, 400, 9000]) for s in [None, "a", "b", "É", "z", "aa", "Z"][: rnd.randint(1, 7)]}
        sizes[next(iter(sizes))] += 1
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()}
        want = water_fill(sizes, (5, 2, 1), 1.5, 2)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mix_takes_near_its_target_and_agrees_with_itself(spark):
    rows = [doc(i, "w " * (1 + i % 7), ["x", "y", "z", None][i % 4]) for i in range(4000)] + [doc(None, None, "y"), doc(7, "w " * 5, "q")]
    d = docs(spark, rows)
    one, two = mixing.mix(d).collect(), mixing.mix(d.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r._copies) for r in one) == sorted((r.doc_id or -1, r._copies) for r in two)
    for s in ("x", "y", "z", None):
        mine = [r for r in one if r.source == s]
        assert abs(sum(r._size * r._copies for r in mine) - mine[0]._target) < 0.1 * mine[0]._target
        assert all(r._copies <= 2 for r in mine)
    assert mixing.repeat(d).count() == sum(r._copies for r in one) and mixing.repeat(d).columns == d.columns
    assert mixing.mix(docs(spark, [])).count() == 0


# -- classifier


def test_scores_of_held_out_labels(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    table = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    scored = quality_classifier.score(table("documents"), quality_classifier.fit(table("documents"), table("labels")))
    held = scored.filter("held_out").join(table("labels").filter("quality IS NOT NULL"), "doc_id").collect()
    assert len(held) > 500
    for label in (0, 1):
        mine = [r for r in held if r.quality == label]
        assert sum(r.predicted == label for r in mine) > 0.97 * len(mine)
    # the score is a dot product of the text's own features, whatever else its row holds
    alone = quality_classifier.score(table("documents").withColumn("source", F.lit("other")).withColumn("lang", F.lit("xx")), quality_classifier.fit(table("documents"), table("labels")))
    assert {r.doc_id: r.score for r in alone.collect()} == {r.doc_id: r.score for r in scored.collect()}


def test_classifier_learns_and_scores_everything(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice("alpha beta gamma delta house tree".split()) for _ in range(30)) + "."
    bad = lambda: " ".join(rnd.choice("alpha beta gamma".split()) + "$$$" for _ in range(30))
    rows = [doc(i, good() if i % 3 else bad()) for i in range(600)] + [doc(9000, None), doc(9001, ""), doc(None, good())]
    d = docs(spark, rows).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    s = quality_classifier.Settings(updates=4000)
    out = quality_classifier.score(d, quality_classifier.fit(d, labels, s), s).collect()
    held = [r for r in out if r.held_out]
    assert 80 < len(held) < 220 and all(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 9000)
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.score(docs(spark, []), quality_classifier.fit(docs(spark, []), labels.limit(0), s), s).count() == 0
