"""The pipeline against brute force, stage by stage on its own input."""

import hashlib
import random

import tiktoken

import corpus_pipeline
from quirework.llm import quality_rules
from quirework.llm.queries import vocabulary
from tests.llm.test_pairs_and_pages import DOCS, near_groups


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("ijklmnop") + str(rnd.randint(0, 300))
    rows = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(15)) + "." for _ in range(rnd.randint(2, 9))]
        if i % 3 == 0:
            lines.insert(0, "The same line everywhere.")
        text = "\n".join(lines)
        if i % 11 == 0 and rows:
            text = rows[-1][1]
        if i % 13 == 0:
            text = "\n".join(" | ".join(word() for _ in range(20)) for _ in range(4))
        rows.append((i, text, "en", ["s", "t", None][i % 3], len(text)))
    rows.append((500, None, None, None, None))
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mix", "encode"]

    kept = {r[0]: r for r in rows if quality_rules.measure(r[1])[-1]}
    got = stages["quality"](spark, spark.createDataFrame(rows, DOCS), folder)
    assert {r.doc_id: tuple(r) for r in got.collect()} == kept and got.columns == [x.split()[0] for x in DOCS.split(", ")]

    pages = {}
    for r in kept.values():
        for x in {x.strip() for x in r[1].split("\n") if x.strip()}:
            pages.setdefault((r[3], x), set()).add(r[0])
    size = {s: sum(r[3] == s for r in kept.values()) for s in {r[3] for r in kept.values()}}
    clean = {}
    for i, r in kept.items():
        text = "\n".join(x for x in r[1].split("\n") if not x.strip() or len(pages[r[3], x.strip()]) <= 0.05 * (size[r[3]] + 30))
        clean[i] = (i, text, r[2], r[3], len(text))
    got = stages["line_dedup"](spark, spark.createDataFrame(list(kept.values()), DOCS), folder)
    assert {r.doc_id: tuple(r) for r in got.collect()} == clean and any(clean[i][1] != kept[i][1] for i in clean)

    groups = near_groups({i: r[1] for i, r in clean.items()})
    single = {i: r for i, r in clean.items() if groups[i][2]}
    got = stages["near_dedup"](spark, spark.createDataFrame(list(clean.values()), DOCS), folder)
    assert {r.doc_id: tuple(r) for r in got.collect()} == single and len(single) < len(clean)

    mixed = stages["mix"](spark, spark.createDataFrame(list(single.values()), DOCS), folder).collect()
    assert all(tuple(r) == single[r.doc_id] for r in mixed)
    total = sum(len(r[1].split()) for r in single.values())
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) < 0.25 * total

    ranks, pattern = vocabulary()
    ref = tiktoken.Encoding("ref", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, ref.encode_ordinary(r.text))).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    out = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want


def test_near_dedup_stage_equals_five_word_brute_force(spark):
    rnd = random.Random(21)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("ijklmnop") + str(rnd.randint(0, 3000))
    texts = {}
    for i in range(0, 120, 3):
        w = [word() for _ in range(rnd.randint(60, 1000))]
        texts[i], texts[i + 1] = w, w[: int(len(w) * rnd.uniform(0.72, 0.95))]
        texts[i + 2] = [word() if x % rnd.choice([29, 40, 60]) == 0 else y for x, y in enumerate(w)]
    texts[200] = [word() for _ in range(1000)]
    texts[201] = texts[200][:830]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in texts.items()], DOCS)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {i for i, r in root.items() if i == r} and 201 not in got
