"""Archives of a book: canonical frames, a deterministic ZIP, and the checks of an importer."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.sources.documents import canonical

#: Limits of an archive.
ENTRIES, PDF_BYTES, JSON_BYTES, ARCHIVE_BYTES, NESTING = 16, 512 << 20, 16 << 20, 600 << 20, 32
FORMAT = 1
NAMES = ("manifest.json", "document.pdf", "frames.json", "outline.json")


def canonical_frames(frames: list[dict]) -> list[dict]:
    """Frames in reading order with five digits; a unit of one loses its unit, a unit's context stands on its first part."""

    def half_up(x: float) -> float:
        import math

        return math.floor(x * 1e5 + 0.5) / 1e5 + 0.0

    def region(r: dict) -> dict:
        return {"page": r["page"], "rect": {k: half_up(r["rect"][k]) for k in ("left", "top", "right", "bottom")}}

    ordered = sorted(frames, key=lambda f: (f["page"], f["rect"]["top"], f["rect"]["left"], f["id"]))
    units: dict[str, list[dict]] = {}
    for f in ordered:
        if f.get("unit"):
            units.setdefault(f["unit"], []).append(f)
    out = []
    for f in ordered:
        parts = units.get(f.get("unit") or "", [])
        g = {k: v for k, v in f.items() if v not in (None, [])} | region(f)
        if len(parts) == 1:
            g.pop("unit", None)
        if len(parts) > 1:
            context: list[dict] = []
            for p in parts:
                for c in p.get("context") or []:
                    if region(c) not in context:
                        context.append(region(c))
            g.pop("context", None)
            if parts[0] is f and context:
                g["context"] = context
        for k in ("continues", "context", "solution"):
            if k in g:
                g[k] = [region(r) for r in g[k]]
        out.append(g)
    return out


def write_bundle(book: dict, frames: list[dict], outline: list[dict], pdf: bytes) -> bytes:
    """The archive's bytes: equal for equal content, since names, order and times are fixed."""
    manifest = {"format": FORMAT, "title": book["title"], "folder": book.get("folder"), "sha256": hashlib.sha256(pdf).hexdigest(), "bytes": len(pdf), "pageCount": book["page_count"], "frames": NAMES[2], "outline": NAMES[3]}
    content = {NAMES[0]: canonical(manifest).encode(), NAMES[1]: pdf, NAMES[2]: canonical(canonical_frames(frames)).encode(), NAMES[3]: canonical(outline).encode()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in NAMES:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == NAMES[1] else zipfile.ZIP_DEFLATED
            z.writestr(info, content[name])
    return out.getvalue()


def _depth(v: object) -> int:
    if isinstance(v, dict):
        return 1 + max(map(_depth, v.values()), default=0)
    return 1 + max(map(_depth, v), default=0) if isinstance(v, list) else 0


def check_bundle(data: bytes) -> list[tuple[int, str]]:
    """(step, code) of whatever an importer would refuse: 1 archive, 2 manifest, 3 document, 5 frames and outline. Step 1 ends the check, the others add up."""
    if len(data) > ARCHIVE_BYTES:
        return [(1, "archive-too-large")]
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
    except (zipfile.BadZipFile, NotImplementedError, OSError):
        return [(1, "archive-unreadable")]
    names = [i.filename for i in infos]
    found = []
    if len(infos) > ENTRIES:
        found.append((1, "too-many-entries"))
    if any(n.startswith("/") or "\\" in n or ".." in n.split("/") or "\0" in n for n in names):
        found.append((1, "unsafe-name"))
    if len(set(names)) < len(names):
        found.append((1, "repeated-entry"))
    found += [(1, f"missing-entry:{n}") for n in NAMES if n not in names]
    if any(i.file_size > (PDF_BYTES if i.filename == NAMES[1] else JSON_BYTES) for i in infos):
        found.append((1, "entry-too-large"))
    if found:
        return found
    parsed = {}
    for name in NAMES:
        try:
            body = z.read(name)
            parsed[name] = body if name == NAMES[1] else json.loads(body)
            if name != NAMES[1] and _depth(parsed[name]) > NESTING:
                found.append((5 if name in NAMES[2:] else 2, f"nesting:{name}"))
        except (zipfile.BadZipFile, ValueError, RecursionError):
            found.append(({NAMES[0]: 2, NAMES[1]: 3}.get(name, 5), f"unreadable:{name}"))
    m = parsed.get(NAMES[0])
    if isinstance(m, dict):
        if not isinstance(m.get("format"), int) or m["format"] > FORMAT:
            found.append((2, "newer-format"))
        if not str(m.get("title") or "").strip():
            found.append((2, "title-missing"))
        pdf = parsed.get(NAMES[1])
        if pdf is not None and (m.get("sha256") != hashlib.sha256(pdf).hexdigest() or m.get("bytes") != len(pdf)):
            found.append((3, "document-differs"))
        frames, outline = parsed.get(NAMES[2]), parsed.get(NAMES[3])
        pages = m.get("pageCount") if isinstance(m.get("pageCount"), int) else 0
        if isinstance(frames, list):
            ids = [f.get("id") for f in frames if isinstance(f, dict)]
            found += [(5, "frame-not-object")] * (len(ids) < len(frames)) + [(5, "duplicate-id")] * (len(set(ids)) < len(ids))
            found += [(5, "page-out-of-range")] * any(isinstance(f, dict) and not 0 <= f.get("page", -1) < pages for f in frames)
            if isinstance(outline, list):
                known = {e.get("id") for e in outline if isinstance(e, dict)}
                found += [(5, "section-unknown")] * any(isinstance(f, dict) and f.get("section") is not None and f["section"] not in known for f in frames)
    return found


def read_bundles(spark: SparkSession, path: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, ok, first_step, codes, frames, outline) of every archive below path; an archive is one task's and bounded by its limits."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, data in zip(b["path"], b["content"], strict=True):
                found = check_bundle(bytes(data))
                z = zipfile.ZipFile(io.BytesIO(bytes(data))) if not found else None
                text = [z.read(n).decode() if z else None for n in NAMES[2:]]
                rows.append((name, not found, found[0][0] if found else None, [c for _, c in found], *text))
            yield pd.DataFrame(rows, columns=["path", "ok", "first_step", "codes", "frames", "outline"]).astype({"first_step": "Int32"})

    kind = "path string, ok boolean, first_step int, codes array<string>, frames string, outline string"
    files = spark.read.format("binaryFile").load(path)
    # what is too large is told without being read
    large = files.filter(f"length > {limit}").select("path", F.lit(False).alias("ok"), F.lit(1).alias("first_step"), F.array(F.lit("archive-too-large")).alias("codes"), F.lit(None).cast("string").alias("frames"), F.lit(None).cast("string").alias("outline"))
    return files.filter(f"length <= {limit}").select("path", "content").mapInPandas(scan, kind).unionByName(large)
