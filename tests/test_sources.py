"""Sources, sinks and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from quirework import schemas
from quirework.sources import bundles, documents
from quirework.streaming import findings

RECT = {"left": 0.1, "top": 0.1, "right": 0.5, "bottom": 0.2}
FRAMES = [{"id": "b", "kind": "exercise", "page": 0, "rect": RECT | {"top": 0.3, "bottom": 0.4000049}, "unit": "u"}, {"id": "a", "kind": "exercise", "page": 0, "rect": RECT, "section": "s1", "authority": "book", "label": "1"}]
BOOK = {"title": "T", "page_count": 2}


def test_bundles(spark, tmp_path):
    data = bundles.write_bundle(BOOK, FRAMES, [{"id": "s1"}], b"%PDF")
    assert data == bundles.write_bundle(BOOK, FRAMES[::-1], [{"id": "s1"}], b"%PDF") and bundles.check_bundle(data) == []
    canonical = bundles.canonical_frames(FRAMES)
    assert [f["id"] for f in canonical] == ["a", "b"] and "unit" not in canonical[1] and canonical[1]["rect"]["bottom"] == 0.4
    assert bundles.check_bundle(b"no zip") == [(1, "archive-unreadable")]
    assert (5, "section-unknown") in bundles.check_bundle(bundles.write_bundle(BOOK, FRAMES, [], b"%PDF"))
    assert (5, "page-out-of-range") in bundles.check_bundle(bundles.write_bundle(BOOK | {"page_count": 0}, FRAMES, [{"id": "s1"}], b"%PDF"))
    assert (2, "title-missing") in bundles.check_bundle(bundles.write_bundle(BOOK | {"title": " "}, FRAMES, [{"id": "s1"}], b"%PDF"))
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("../evil", "x")
    assert (1, "unsafe-name") in bundles.check_bundle(out.getvalue())
    (tmp_path / "good.zip").write_bytes(data)
    (tmp_path / "bad.zip").write_bytes(data[:50])
    got = {r.path.rsplit("/", 1)[1]: (r.ok, r.first_step) for r in bundles.read_bundles(spark, str(tmp_path)).collect()}
    assert got == {"good.zip": (True, None), "bad.zip": (False, 1)}
    assert {r.path.rsplit("/", 1)[1]: r.codes for r in bundles.read_bundles(spark, str(tmp_path), 100).filter("NOT ok").collect()} == {"good.zip": ["archive-too-large"], "bad.zip": ["archive-unreadable"]}


def test_projects_and_lists(spark, tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"format": 1, "frames": [{"id": "f1", "kind": "exercise", "page": 0, "rect": RECT, "new": 1}], "outline": {"entries": [{"title": "x", "page": 0, "depth": 0}]}}))
    (d / "b.json").write_text(json.dumps({"format": 99}))
    (d / "c.json").write_text("{broken")
    read = documents.projects(spark, str(d))
    assert sorted(r.state for r in read.collect()) == ["newer", "ok", "unreadable"]
    assert [r.id for r in documents.frames(read).collect()] == ["f1"] and documents.outline(read).count() == 1
    r = tmp_path / "r"
    r.mkdir()
    (r / "1.json").write_text(json.dumps({"sections": [{"label": "1", "title": "t", "count": 3}, {"label": "1", "title": "u", "count": 3}]}))
    (r / "2.json").write_text(json.dumps({"chapters": [{"label": "I", "title": "c", "sections": [{"label": "2", "title": "t", "count": 4}]}]}))
    assert sorted((x.label, x.chapter, x.repeated) for x in documents.reference(spark, str(r)).collect()) == [("1", None, True), ("1", None, True), ("2", "I", False)]
    s = tmp_path / "s.json"
    s.write_text(json.dumps([{"from": 1, "to": 3, "kind": "text"}, {"from": 4, "to": 4, "kind": "both", "note": "n"}]))
    assert [(x.place, x["from"], x.kind) for x in documents.lists(spark, str(s), "from int, to int, kind string, note string").orderBy("place").collect()] == [(0, 1, "text"), (1, 4, "both")]
    depth = spark.createDataFrame([('{"a":[{"b":"[["}]}',), ("[]",)], "t string").select(documents.nesting(F.col("t")).alias("n"))
    assert [x.n for x in depth.collect()] == [3, 1]
    assert documents.canonical({"b": [1, {"z": None, "a": "é"}], "a": None}) == '{"b":[1,{"a":"é"}]}'


def run(spark, d, name, mode="append"):
    q = d.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    calls = spark.createDataFrame([("cli", "a", None, True, None, 0), ("cli", "a", None, False, "e", 1), ("mcp", "b", None, True, None, 0)], schemas.CALL_LOG)
    documents.append_log(calls, str(tmp_path / "log"))
    documents.append_log(calls, str(tmp_path / "log"))
    assert documents.call_log(spark, str(tmp_path / "log")).count() == 6
    got = run(spark, findings.failures(findings.call_log(spark, str(tmp_path / "log"))), "failed", "complete")
    assert sorted((r.tool, r.calls, r.failed) for r in got) == [("a", 4, 2), ("b", 2, 0)]
    e = spark.sql("SELECT CAST(id AS bigint) event_id, timestamp_ntz'2026-01-01' + make_interval(0,0,0,0,id) AS ts, id % 2 AS user_id, 'k' AS event_type, CAST(id AS double) AS value FROM range(72)")
    e.union(e).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    assert run(spark, findings.unique(stream).groupBy().count(), "uniq", "complete")[0][0] == 72
    days = run(spark, findings.rates(stream), "rates", "complete")
    assert sorted(r.n for r in days) == [48, 48, 48]
    assert len(run(spark, findings.sessions(stream, gap="90 minutes"), "sess", "complete")) == 72
