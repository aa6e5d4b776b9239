"""Sources of JSON documents and lists, and sinks in canonical JSON."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirework import schemas
from quirework.functions.grouped import changes, gathered
from quirework.session import bound_batches, store

NEWEST_FORMAT = 1
_FRAME = f"struct<id:string,kind:string,page:int,rect:{schemas.RECT},unit:string,continues:array<{schemas.REGION}>,context:array<{schemas.REGION}>,solution:array<{schemas.REGION}>,authority:string,label:string,section:string>"
_CHUNK = 1 << 16


def projects(spark: SparkSession, path: str) -> DataFrame:
    """(path, state, format, project): project files read whole, tolerant of fields that are missing; state is ok, newer or unreadable.

    Fields that the schema doesn't know stay in the raw text.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = f"struct<format:int,revision:int,meta:map<string,string>,pdf:struct<path:string,sha256:string,bytes:bigint,pageCount:int>,frames:array<{_FRAME}>,outline:struct<source:string,entries:array<struct<title:string,page:int,depth:int,id:string,label:string,top:double>>>,seq:bigint>"
    d = raw.withColumn("project", F.from_json("value", kind))
    state = F.when(F.col("project").isNull() | (F.coalesce(F.get_json_object("value", "$.format"), F.lit("")) == ""), "unreadable").when(F.col("project.format") > NEWEST_FORMAT, "newer").otherwise("ok")
    return d.select("path", state.alias("state"), F.col("project.format").alias("format"), "project", F.col("value").alias("raw"))


def members(chunks: Iterator[str], field: str) -> Iterator[tuple[str, str]]:
    """(key, JSON text) of a JSON object's members, those of the list `field` one by one; ValueError where the text is broken.

    Holds one value at a time, and a chunk or, while a value is longer, as much as is held already.
    """
    decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\n\r]*")
    text, at = "", 0

    def more() -> bool:
        nonlocal text, at
        rest, new, n = text[at:], [], 0
        for c in chunks:
            new.append(c)
            n += len(c)
            if n >= max(_CHUNK, len(rest)):
                break
        text, at = rest + "".join(new), 0
        return n > 0

    def peek() -> str:
        nonlocal at
        at = blank.match(text, at).end()
        while at == len(text) and more():
            at = blank.match(text, at).end()
        return text[at : at + 1]

    def skip(wanted: str) -> str:
        nonlocal at
        c = peek()
        if not c or c not in wanted:
            raise ValueError(f"no {wanted}")
        at += 1
        return c

    def value() -> str:
        nonlocal at
        peek()
        while True:
            try:
                end = decoder.raw_decode(text, at)[1]
            except RecursionError as e:
                raise ValueError("nested too deep") from e
            except json.JSONDecodeError as e:
                # what is cut off is told at its end, a string at its start
                if e.pos < len(text) - 16 and not e.msg.startswith("Unterminated string"):
                    raise
                if not more():
                    raise
                continue
            # a number may go on
            if end < len(text) or not more():
                found, at = text[at:end], end
                return found

    skip("{")
    if peek() == "}":
        return
    while True:
        if peek() != '"':
            raise ValueError("no key")
        key = json.loads(value())
        skip(":")
        if key == field and peek() == "[":
            skip("[")
            if peek() == "]":
                skip("]")
            else:
                yield key, value()
                while skip(",]") == ",":
                    yield key, value()
        else:
            found = value()
            if key != field:
                yield key, found
        if skip(",}") == "}":
            return


def project_frames(spark: SparkSession, path: str) -> DataFrame:
    """frames() of project files of any size: read in pieces and parsed as a stream, a task a file, so that no text or list is held whole."""
    bound_batches(spark)
    m = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path).select(m["file_path"].alias("path"), m["file_block_start"].alias("start"), m["file_size"].alias("size"), F.octet_length("value").alias("bytes"), F.make_valid_utf8("value").alias("value"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for b in batches:
            at = [0, *changes(b, ["path", "start"]).tolist(), b.num_rows] if b.num_rows else []
            for i, j in itertools.pairwise(at):
                place += 1
                values = b.column("value")[i:j].to_pylist()
                one = (b.column("path")[i].as_py(), b.column("start")[i].as_py(), place, b.column("size")[i].as_py(), pc.sum(b.column("bytes")[i:j]).as_py() + j - i, "}".join(values) + "}")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, chunk.types, strict=True)], chunk.names)

    chunk_kind = "path string, start long, place long, size long, bytes long, value string"
    chunk = to_arrow_schema(T.StructType.fromDDL(chunk_kind))
    part_kind = "path string, key string, value string"
    part = to_arrow_schema(T.StructType.fromDDL(part_kind))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for name, own in itertools.groupby(rows, key=lambda r: r["path"]):
            out: list[tuple[str, str]] = []
            try:
                for kv in members(_whole(own), "frames"):
                    if kv[0] in ("frames", "format"):
                        out.append(kv)
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([name] * len(out), *zip(*out, strict=True))], part.names)
                        out = []
                out.append(("end", ""))
            except ValueError:
                for _ in own:
                    pass
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([name] * len(out), *zip(*out, strict=True))], part.names)

    found = store(gathered(pieces.mapInArrow(joined, chunk_kind), ["path"], ["start", "place"]).mapInArrow(parsed, part_kind), "frames")
    # a file counts once it is read to its end, and may tell its format behind its frames
    told = F.concat(F.lit('{"format":'), "value", F.lit("}"))
    stated = (F.col("key") == "format") & (F.coalesce(F.get_json_object(told, "$.format"), F.lit("")) != "") & ~F.coalesce(F.from_json(told, "format int")["format"] > NEWEST_FORMAT, F.lit(False))
    sound = found.filter("key <> 'frames'").groupBy("path").agg(F.max(stated).alias("_ok"), F.max(F.col("key") == "end").alias("_end")).filter("_ok AND _end").select("path")
    return found.filter("key = 'frames'").join(sound, "path", "left_semi").select(F.col("path").alias("book_id"), F.from_json("value", _FRAME).alias("f")).select("book_id", "f.*")


def _whole(chunks: Iterator[dict]) -> Iterator[str]:
    """Texts of a file's chunks; the last has a brace too many where the file doesn't end in one."""
    n = 0
    for c in chunks:
        n += c["bytes"]
        yield c["value"][:-1] if n > c["size"] else c["value"]


def write_projects(books: DataFrame, path: str) -> None:
    """A project file for each book_id of books(book_id, id, frame), its frames in the order of id, a line each; a task writes a book without holding it."""
    w = Window.partitionBy("book_id").orderBy("id")
    head = F.when(F.row_number().over(w) == 1, '{"format":1,"frames":[').otherwise(",")
    tail = F.when(F.lead(F.lit(True)).over(w).isNull(), "]}").otherwise("")
    books.select("book_id", F.concat(head, F.to_json("frame"), tail).alias("value")).write.partitionBy("book_id").text(path)


def frames(read: DataFrame) -> DataFrame:
    """Frames of sound projects, a row each; the path names the book."""
    return read.filter("state = 'ok'").select(F.col("path").alias("book_id"), F.explode("project.frames").alias("f")).select("book_id", "f.*")


def outline(read: DataFrame) -> DataFrame:
    return read.filter("state = 'ok'").select(F.col("path").alias("book_id"), F.posexplode("project.outline.entries").alias("idx", "e")).select("book_id", "idx", "e.*")


def reference(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, title, count, chapter, repeated) of reference lists in either of two shapes: sections, or chapters of sections."""
    section = "struct<label:string,title:string,count:int>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    flat = raw.select("path", F.explode(F.from_json(F.get_json_object("value", "$.sections"), f"array<{section}>")).alias("s"), F.lit(None).cast("string").alias("chapter"))
    chapters = raw.select("path", F.explode(F.from_json(F.get_json_object("value", "$.chapters"), f"array<struct<label:string,title:string,sections:array<{section}>>>")).alias("c")).select("path", F.explode("c.sections").alias("s"), F.col("c.label").alias("chapter"))
    both = flat.unionByName(chapters).select("path", "s.label", "s.title", "s.count", "chapter")
    return both.withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy("path", "label")) > 1)


def lists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lists, of one file or a folder of them, with the file they stand in and their place (survey, visual, notes, queue)."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(F.from_json("value", f"array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in _fields(schema))}>>")).alias("place", "x")).select("file", "place", "x.*")


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a call log; broken lines are kept with ok null."""
    return spark.read.schema(schemas.CALL_LOG).json(path)


def append_log(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no absent values."""

    def bare(v: object) -> object:
        if isinstance(v, dict):
            return {k: bare(x) for k, x in sorted(v.items()) if x is not None}
        return [bare(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(bare(value), ensure_ascii=False, separators=(",", ":"))


def nesting(text: Column) -> Column:
    """How deep a JSON text nests, its strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")))
    return depth["most"]


def snapshots(d: DataFrame, path: str, revision: int) -> None:
    """A table's state as a revision of its own: a reader takes the newest, a failed write leaves none."""
    d.write.mode("errorifexists").parquet(f"{path}/revision={revision}")
