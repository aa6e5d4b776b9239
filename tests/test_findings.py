"""Defects that a review found on larger tables, each on few rows."""

import json
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.operators import operations, propose, reconcile, review, verify
from quirework.plans import catalog
from quirework.sources import documents


@pytest.fixture
def conf(spark):
    """Sets the session's settings for a test."""
    before = {}

    def put(**pairs):
        for k, v in pairs.items():
            k = f"spark.sql.{k.replace('_', '.')}"
            before[k] = spark.conf.get(k, None)
            spark.conf.set(k, v)

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def equals_sql(spark, folder, name, table, d):
    """The query's rows over a table of d's rows, which have to be those of its SQL."""
    d.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    q = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in q.columns)} FROM ({catalog.SQL[name]})").fetchall()
    got = sorted(map(tuple, q.collect()), key=repr)
    assert got == sorted(want, key=repr)
    return got


def test_decimal_heights_are_rounded_once(spark, tmp_path):
    """Two lines of sf0.1 share a twentieth to the last bit, which is no more than that."""
    rows = [(1, 6523, 17, 6, 35.0, 0.1), (1, 19508, 822, 4, 50.0, 0.05), (1, 3926, 107, 1, 47.0, 0.01), (1, 9168, 581, 1, 48.0, 0.02)]
    d = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double")
    got = equals_sql(spark, tmp_path, "rectangle_overlap", "lineitem", d)
    assert (6523, 19508) not in {r[1:3] for r in got}


def test_books_stay_whole_where_aqe_coalesces(spark, conf):
    """The state and the operations of a book come of shuffles by book that differ in size."""
    conf(shuffle_partitions="40", adaptive_advisoryPartitionSizeInBytes="4k", adaptive_coalescePartitions_parallelismFirst="false", adaptive_coalescePartitions_minPartitionSize="1k", autoBroadcastJoinThreshold="-1")
    add = json.dumps({"op": "add", "page": 0, "rect": {"left": 0.1, "top": 0.1, "right": 0.9, "bottom": 0.4}})
    ops = spark.range(6000).select(F.concat(F.lit("b"), F.col("id") % 500).alias("book_id"), (F.col("id") + 1).alias("seq_no"), F.lit(add).alias("payload"))
    state = ops.select("book_id").distinct().withColumns({"frames": F.lit("[]"), "outline": F.lit("[]"), "seq": F.lit(0).cast("long"), "meta": F.lit("{}")})
    got = operations.replay_all(state, ops).collect()
    assert len(got) == 500 and all(r.ok and r.applied == 12 and r.seq == 12 for r in got)


def test_equal_keys_are_one_group_across_batches():
    import pyarrow as pa

    from quirework.functions.grouped import whole_runs

    b = [pa.RecordBatch.from_pydict({"k": pa.array(k, pa.string()), "v": v}) for k, v in ((["a", "a"], [1, 2]), (["a"], [3]), ([], pa.array([], pa.int64())), (["a", "b", None], [4, 5, 6]), ([None, "c"], [7, 8]))]
    got = [x.column("v")[i:j].to_pylist() for x, at in whole_runs(iter(b), ["k"]) for i, j in zip(at, at[1:], strict=False)]
    assert got == [[1, 2, 3, 4], [5], [6, 7], [8]]


def test_many_short_pages_are_folded_in_time(spark):
    """120,000 pages of two items: no work by the group beside the fold itself."""
    d = spark.range(240_000).select(F.lit("b").alias("book_id"), F.expr("cast(id div 2 as int)").alias("page"), "id", *[(low + step * (F.col("id") % 2)).alias(c) for c, low, step in (("top", F.lit(0.1), 0.01), ("left", F.lit(0.0), 0.5), ("bottom", F.lit(0.2), 0.01))])
    began = time.time()
    got = review.item_rows(d).groupBy("row", "row_size").count().collect()
    assert [tuple(r) for r in got] == [(0, 2, 240_000)]
    assert time.time() - began < 12


def test_columns_of_many_sections_are_ordered_in_time(spark):
    """Three numbers in each of 80,000 columns, the last of them too low in every tenth, and as many alone."""
    d = spark.range(320_000).withColumn("k", F.col("id") % 4).select(
        F.lit("b").alias("book_id"), F.concat(F.lit("i"), "id").alias("id"), F.when(F.col("k") < 3, "s").otherwise("alone").alias("section"), F.expr("cast(id div 4 as int)").alias("page"), F.lit(0.1).alias("left"), (F.col("k") * 0.1).alias("top"), F.lit(True).alias("has_answer"),
        F.when((F.col("k") == 2) & (F.expr("id div 4") % 10 == 0), "1").otherwise((F.col("k") + 2).cast("string")).alias("label"),
    )
    sections = spark.createDataFrame([("b", "s", 0, 10**7)], "book_id string, label string, page int, end_page int")
    began = time.time()
    found = verify.check_sequences(d, sections).filter("code = 'order'").groupBy("ref").count().collect()
    assert [tuple(r) for r in found] == [("s:1", 8000)]
    assert time.time() - began < 12


def test_frames_of_a_project_are_streamed(spark, tmp_path, conf):
    """One file longer than a split and a batch, without line ends, beside broken, newer and odd ones: the frames that the whole texts give."""
    frame = lambda i: {"id": f"f{i}", "kind": "exercise", "page": i, "rect": {"left": 0.1, "top": 0.2, "right": 0.5, "bottom": 0.3}, "label": 'a}"{é]\\', "new": [{"x": "}"}]}
    texts = {
        "long": json.dumps({"frames": [frame(i) for i in range(20_000)], "format": 1, "outline": {"entries": []}}),
        "pretty": json.dumps({"format": 1, "frames": [frame(1), None], "seq": 12}, indent=2, ensure_ascii=False) + "\n",
        "newer": json.dumps({"format": 99, "frames": [frame(3)]}), "none": json.dumps({"format": 1, "frames": []}), "formless": json.dumps({"frames": [frame(4)]}),
        "cut": json.dumps({"frames": [frame(5)], "format": 1})[:-1], "broken": '{"format":1,"frames":[{"id":"x"}} ', "empty": "", "list": "[1]", "bare": '{"format":1}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    conf(files_maxPartitionBytes="100k")
    got = sorted(map(str, documents.project_frames(spark, str(tmp_path)).collect()))
    assert len(got) == 20_002 and got == sorted(map(str, documents.frames(documents.projects(spark, str(tmp_path))).collect()))


def test_titles_of_a_common_word_are_matched_in_time(spark):
    """12,000 titles on both sides that all have a word in common, and another each."""
    d = spark.range(12_000).select(F.lit("b").alias("book_id"), F.col("id").alias("block"), F.lit(None).cast("string").alias("marker"), F.concat(F.lit("word"), "id", F.lit(" other")).alias("title"))
    began = time.time()
    got = propose.match_blocks(d, d.select("book_id", F.col("block").cast("string").alias("label"), "title")).filter("cast(block AS string) = section AND how = 'title'").count()
    assert got == 12_000
    assert time.time() - began < 30


def test_matched_titles_equal_brute_force(spark):
    """Titles of few words, some cut, repeated or within others; labels that repeat."""
    rng = random.Random(3)
    title = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(["art", "party", "a", "sun", "the", "theory", "ory", "x1", "1x", "of"]) for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 5])))
    sections = [(f"s{rng.randrange(60)}" if i % 20 else None, title()) for i in range(70)]
    blocks = [(i, title()) for i in range(300)]

    def score(a, b):
        x, y = set(a.split(" ")), set(b.split(" "))
        return (1.0 if a == b else 0.85 if a in b or b in a else len(x & y) / len(x | y)) if x & y else None

    want = []
    for i, t in blocks:
        ranked = sorted(((s, label) for s, label in {(score(t, u), label) for label, u in sections if t is not None and u is not None} if s), key=lambda x: (-x[0], x[1] is not None, x[1] or ""))
        if ranked and ranked[0][0] >= 0.5 and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0.0) >= 0.15:
            want.append((i, ranked[0][1]))
    d = spark.createDataFrame([("b", i, None, t) for i, t in blocks], "book_id string, block long, marker string, title string")
    got = propose.match_blocks(d, spark.createDataFrame([("b", *s) for s in sections], "book_id string, label string, title string"))
    assert len(want) > 20 and sorted((r.block, r.section or "") for r in got.collect()) == sorted((i, s or "") for i, s in want)


def test_repeated_titles_are_compared_once(spark, tmp_path):
    """900 rows of three long names in one brand and size."""
    d = spark.range(900).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_brand"), F.lit(1).alias("p_size"), F.concat(F.repeat(F.lit("long name "), 40), F.col("id") % 3).alias("p_name"))
    d.write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    assert catalog.QUERIES["title_near_duplicates"](spark, str(tmp_path)).groupBy("close").count().collect()[0]["count"] == 900 * 899 // 2
    assert time.time() - began < 15


def test_pairs_of_odd_titles_equal_sql(spark, tmp_path):
    """Names and brands that are null, keys that repeat, and blocks of any size."""
    names = ["red ring", "red ring", "red rings", "bolt", "ring red", "", None, "red"]
    rows = [(i if i % 11 else 5, None if i % 13 == 0 else f"b{i % 2}", 1, names[i * 7 % 8]) for i in range(90)]
    d = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string")
    got = equals_sql(spark, tmp_path, "title_near_duplicates", "part", d)
    small = reconcile.title_pairs(d.withColumn("t", F.lower("p_name")), ["p_brand", "p_size"], "p_partkey", "t", block=2).withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, small.collect()), key=repr) == got
