"""Every operator and stage: ids of 64 bits, nulls, repeated rows, clashing names, very long texts, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import bpe, html_extract, license_scan, line_dedup, minhash, mixing, quality_classifier, quality_rules, topk, warc
from quirework.llm.queries import vocabulary

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), 0, None]
#: Names that the operators use for their own columns, and names that parsers stumble over.
CLASHES = "row of id mark host k keys a b node _node root n _id _text _mark text_ _h _n _s _size _copies _copy _source_size _target _rate _kept _clean _n_lines _n_dropped _lost_spans _hits score held_out token_ids n_tokens decoded bad body clean least first v d block shard x.y Upper".split()
PROSE = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) + "." for i in range(6))


def corpus(spark, clash=True):
    rows = [(i, f"{PROSE}\nLicensed under the MIT License.\nown words of {k} and {k} more", "en", ["s", None][k % 2], 0) for k, i in enumerate(IDS)]
    rows += [rows[0], (7, None, None, None, None), (8, "", "en", "s", 0), (9, "long " * 200_000 + "\n" + "x" * 50_000 + "\nMenu | a | b", "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("clash " + c) for c in CLASHES}) if clash else d


def model(docs):
    labels = docs.sparkSession.createDataFrame([(i, int(k % 2), 0) for k, i in enumerate(IDS)], "doc_id long, quality int, toxic int")
    return quality_classifier.fit(docs, labels, quality_classifier.Settings(updates=50))


OPERATORS = {
    "line_dedup": lambda d: line_dedup.drop_boilerplate(d),
    "license_scan": lambda d: license_scan.scan(d),
    "quality_rules": lambda d: quality_rules.judge(d, lines=True),
    "quality_classifier": lambda d: quality_classifier.score(d, model(d)),
    "bpe.digests": lambda d: bpe.digests(d, *vocabulary()),
    "bpe.round_trip": lambda d: bpe.decode(bpe.encode(d, *vocabulary()), vocabulary()[0]),
    "minhash": lambda d: minhash.near_duplicates(d),
    "mixing": lambda d: mixing.mix(d),
    "html_extract": lambda d: html_extract.extract(d.withColumnRenamed("text", "html")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    d = corpus(spark)
    got = OPERATORS[name](d).cache()
    assert sorted(map(str, (r.doc_id for r in got.select("doc_id").collect()))) == sorted(map(str, (r.doc_id for r in d.select("doc_id").collect())))
    # a clashing column stays as it is or gives way to the operator's own of that name; there are never two
    names = [c.lower() for c in got.columns]
    assert len(names) == len(set(names))
    got.unpersist()
    assert OPERATORS[name](d.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, name):
    d, stage = corpus(spark), dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, d, "").collect()
    ids = [r.doc_id for r in rows]
    assert set(ids) <= {*IDS, 7, 8, 9}
    if name != "encode":
        assert stage(spark, d, "").columns == d.columns
        assert all(r[c] == "clash " + c for r in rows for c in CLASHES)
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None) or name in ("near_dedup", "mix")
    if name == "quality":
        assert {*IDS, 9} >= set(ids) >= set(IDS) and all("Menu" not in r.text for r in rows)
    if name == "line_dedup":
        assert len(ids) == 10 and any(r.text is None for r in rows)
    if name == "near_dedup":
        assert sorted(map(str, ids)) == sorted(map(str, [-(2**63), 7, 8, 9]))
    if name == "mix":
        assert set(ids) >= {i for i in IDS if i is not None} and len(ids) >= 10
    assert stage(spark, d.limit(0), "").count() == 0


def test_ids_of_pairs_and_archives(spark, tmp_path):
    texts = spark.createDataFrame([(2**53 + 1, PROSE), (2**53 + 3, PROSE + " and"), (None, PROSE + " or"), (5, "other")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(texts).collect()}
    assert got == {2**53 + 1: 2**53 + 1, 2**53 + 3: 2**53 + 1, None: 2**53 + 1, 5: 5}
    pages = spark.createDataFrame([(2**53 + 1, "u", "same"), (2**53 + 3, "u", "same"), (None, "u", "own")], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES})
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(pages, str(tmp_path)).collect()} == {(2**53 + 1, 2**53 + 3), (2**53 + 3, None), (None, None)}
    vectors = spark.createDataFrame([(2**53 + 1, [1.0]), (2**53 + 3, [2.0]), (None, [3.0]), (0, [1.0])], "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASHES})
    assert [r.vec_id for r in topk.top_k(vectors).orderBy("rank").collect()] == [2**53 + 3, 2**53 + 1]
