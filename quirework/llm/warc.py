"""WARC archives: written by Spark's text writer, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import bound_batches, store

#: What ends a record, and so what the text writer puts between its lines.
END = "\r\n\r\n"
MAGIC = b"WARC/1.1\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Rows of an archive, at most, and its bytes, about; a record of more than an eighth of them has an archive of its own.
ROWS_PER_FILE, ARCHIVE_BYTES = 4096, 64 << 20
#: Bytes of records that a task of the writer has at least, where there are so many, and bytes of pages that it reads at most, about.
TASK_BYTES, TASK_PAGES = 16 << 20, 256 << 20
#: In a local folder, no file of checksums beside an archive: its records have digests, and each such file is made by three more processes.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_FIELD = re.compile(rb"^([!-9;-~]+):(.*)\r\n", re.M)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits: every 5 of them are 4 letters."""

    def letters(i: Column) -> Column:
        bits = F.conv(F.substr(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("long")
        return F.concat(*[F.substr(F.lit(_ALPHABET), (F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """pages(id, url, payload) with _body, _bytes, _digest, _type and _refers.

    Of the rows with equal payloads of min_bytes at least, the one with the largest id is the response and the others revisit
    it; smaller payloads are responses all. Null payloads count as empty. Rows that repeat the largest id are responses too;
    a row without id revisits if a row with one has its payload, and is a response otherwise. The largest ids are summed
    before they are joined back, by a digest of 256 bits.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), body.alias("_body")).withColumn("_bytes", F.octet_length("_body").cast("long"))
    rows = rows.withColumn("_digest", base32(F.sha1(F.col("_body").cast("binary")))).withColumn("_same", F.sha2(F.col("_body").cast("binary"), 256))
    last = pages.select(F.col(id_col).alias("_id"), F.sha2(body.cast("binary"), 256).alias("_k"), F.octet_length(body).alias("_n")).filter(F.col("_n") >= min_bytes).groupBy("_k").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    # payloads are moved for the join only where those that occur twice are too many to broadcast
    last = store(last, "payloads")
    joined = rows.join(last, F.col("_same") == F.col("_k"), "left")
    revisits = F.col("_last").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_last"))
    return joined.withColumn("_type", F.when(revisits, "revisit").otherwise("response")).withColumn("_refers", F.when(revisits, F.col("_last"))).drop("_k", "_c", "_last", "_same")


def record_id(col: Column) -> Column:
    """A urn of the id, the same wherever it is named."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(col.cast("string"), F.lit("null"))))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))


def write(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", rows_per_file: int = ROWS_PER_FILE, archive_bytes: int = ARCHIVE_BYTES, **how) -> int:
    """Archives of a record per row of pages below path, a folder that any of Spark's file systems may hold; about how many bytes the pages have.

    A record is a line of text that the record end separates from the next, so that Spark's writer and its committer make the
    archives: a lost task leaves nothing behind. A revisit has its headers alone. Line ends and control characters of a url
    become blanks; a null url has no target. An archive is read as one value, so that its bytes are bounded: records of a like
    size are written together, as many to an archive as may be of the greatest of them. Sizes that no record has aren't written,
    and small inputs are written by few tasks: Hadoop's local file system starts four processes a file. Empty table: an empty folder.
    """
    r = plan_records(pages, **how)
    is_revisit = F.col("_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("_body")))
    header = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        F.col("_type"),
        F.lit("\r\nWARC-Record-ID: "),
        record_id(F.col("_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.trim(F.regexp_replace("_url", r"[\x00-\x20\x7f]+", " "))), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nX-Page-Id: "), F.col("_id").cast("string")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("_digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("_bytes").cast("string"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("_refers")), F.lit("\r\nX-Refers-To-Page: "), F.col("_refers").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit(END),
    )
    # sizes are those of the pages, told before they are joined and hashed; the last class, of one record an archive, has no bound
    counts = [rows_per_file]
    while counts[-1] > 1:
        counts.append(max(1, counts[-1] // 8))
    highs = [archive_bytes // n for n in counts[:-1]] + [2**63 - 1]
    classes = list(zip([-1, *highs], highs, counts, strict=False))
    size = F.col("_bytes") + F.coalesce(F.octet_length("_url"), F.lit(0)) + 1024
    payload, url = F.col(how.get("payload", "html")).cast("string"), F.col(how.get("url", "url"))
    sizes = pages.select(F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("_bytes"), url.alias("_url")).select(size.alias("n"))
    found = sizes.agg(*[F.sum(F.when((F.col("n") > low) & (F.col("n") <= high), F.col("n"))) for low, high, _ in classes]).first()
    total = sum(x or 0 for x in found)
    for (low, high, rows), held in zip(classes, found, strict=True):
        if held is None and (total or rows > 1):
            continue
        lines = r.filter((size > low) & (size <= high)).withColumn("_block", block).select(F.concat(header, F.col("_block")).alias("value"))
        tasks = max((held or 0) // TASK_BYTES, total // TASK_PAGES) + 1
        lines.coalesce(tasks).write.mode("append").options(**PLAIN_FILES, lineSep=END, maxRecordsPerFile=rows).text(path)
    return total


def candidates(data: bytes) -> list[tuple[int, int, dict[str, str], int]]:
    """(offset, successor, fields, start of the block) of every place where a record could start, true or not; a block ends 4 bytes before the successor."""
    out = []
    for magic in _MAGIC.finditer(data):
        at = magic.start()
        # a record starts its file or follows the end of another; so no two headers share bytes, however long they are
        end = data.find(b"\r\n\r\n", at) if at == 0 or data[max(0, at - 4) : at] == b"\r\n\r\n" else -1
        if end >= 0:
            fields = {k.decode().lower(): v.strip(b" \t").decode("utf-8", "replace") for k, v in _FIELD.findall(data, magic.end(), end + 2)}
            size = fields.get("content-length", "")
            if size.isascii() and size.isdigit():
                start = end + 4
                after = start + int(size)
                if data[after : after + 4] == b"\r\n\r\n":
                    out.append((at, after + 4, fields, start))
    return out


def whole_number(text: str | None) -> int | None:
    """A signed integer of 64 bits, or none."""
    if not re.fullmatch(r"-?[0-9]{1,19}", text or ""):
        return None
    return n if -(2**63) <= (n := int(text)) < 2**63 else None


def reachable(offset: np.ndarray, successor: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates lie on the chain from start, by pointer jumping: rounds grow with the logarithm of the chain."""
    order = np.argsort(offset, kind="stable")
    at, to = offset[order], successor[order]
    n = len(at)
    # the place of each one's successor; n, which leads to itself, where there is none
    jump = np.searchsorted(at, to)
    jump = np.where((jump < n) & (at[np.minimum(jump, n - 1)] == to), jump, n) if n else jump
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    first = int(np.searchsorted(at, start))
    if first < n and at[first] == start:
        seen[first] = True
        while True:
            more = seen.copy()
            more[jump[seen]] = True
            jump = jump[jump]
            if (more == seen).all():
                break
            seen = more
    out = np.zeros(n, bool)
    out[order] = seen[:n]
    return out


RECORD = "file string, offset long, successor long, record_type string, record_id string, refers_to_id string, target_uri string, page_id long, refers_to_page long, declared_digest string, declared_bytes long, block_bytes long, payload_digest string, payload_bytes long"


def read_candidates(spark: SparkSession, path: str, whole_chains: bool = False) -> DataFrame:
    """A row of RECORD for every place of the archives below path where a record could start; an archive is read by one task.

    Archives of versions 1.0 and 1.1 are read, whole or as gzip members; places are those of the unpacked bytes. With whole_chains it fails at an archive whose chain of records doesn't reach its end.
    """
    bound_batches(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                rows = []
                data = bytes(data)
                found = candidates(data := gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                if whole_chains:
                    ends = np.array([x[1] for x in found], np.int64)
                    on = reachable(np.array([x[0] for x in found], np.int64), ends)
                    if ends[on].max(initial=0) != len(data):
                        raise ValueError(f"{name}: its records end at byte {ends[on].max(initial=0)} of {len(data)}")
                # the parts of an archive are looked at where they are
                view = memoryview(data)
                for at, after, f, start in found:
                    kind = f.get("warc-type")
                    end = after - 4
                    inner = data.find(b"\r\n\r\n", start, end) if f.get("content-type", "").startswith("application/http") else -1
                    payload = view[start if inner < 0 else inner + 4 : end]
                    whole = kind != "revisit"
                    number = lambda k, f=f: whole_number(f.get(k))
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None
                    rows.append((name, at, after, kind, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("x-payload-length"), end - start, digest, len(payload) if whole else None))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter("length > 0").select("path", "content").mapInPandas(scan, RECORD)


def read(spark: SparkSession, path: str, whole_chains: bool = False) -> DataFrame:
    """The true records of the archives below path: those on the chain of boundaries from the start of their archive.

    The magic inside a payload makes a candidate too, but no chain from the start leads there. An archive is cut by its
    writer; the candidates of one are a bounded group, of which only offsets and header fields are moved.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        return g[reachable(g["offset"].to_numpy(np.int64), g["successor"].to_numpy(np.int64))][names]

    # pandas makes floats of longs with nulls, which hold no id above 2^53
    ids = ["page_id", "refers_to_page"]
    kinds = ", ".join(f"{x.split()[0]} string" if x.split()[0] in ids else x for x in RECORD.split(", "))
    found = read_candidates(spark, path, whole_chains).withColumns({x: F.col(x).cast("string") for x in ids})
    return found.groupBy("file").applyInPandas(chain, kinds).withColumns({x: F.col(x).cast("long") for x in ids})


def round_trip(pages: DataFrame, folder: str, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record per row, and whether what was read is what was declared.

    It fails if the records of an archive don't reach its end. A row is short whatever its page: those of TASK_PAGES are one
    partition, and so one file where they are written. Empty table: no rows.
    """
    path = f"{folder}/warc-{uuid.uuid4().hex}"
    total = write(pages, path, **how)
    r = read(pages.sparkSession, path, whole_chains=True)
    return r.coalesce(total // TASK_PAGES + 1).select(
        "page_id",
        F.coalesce("payload_bytes", "declared_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "declared_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
        (F.coalesce(F.col("payload_digest") == F.col("declared_digest"), F.lit(True)) & F.coalesce(F.col("payload_bytes") == F.col("declared_bytes"), F.lit(True))).alias("intact"),
    )
