"""Text runs to lines, lines to columns and reading order: a page at a time."""

from __future__ import annotations

import statistics

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quirework.functions.grouped import by_runs

LINES = "book_id string, page int, line_idx int, text string, left double, top double, right double, bottom double, font_size double, column int, chars int, bold boolean"


def boxes(items: DataFrame) -> DataFrame:
    """text_items with top and bottom: ascent from half to 1.1 of the size (.8 where unknown), descent from .1 to .5 (.2)."""
    size = F.col("font_size")
    up = F.least(F.greatest(F.coalesce("ascent", F.lit(0.8)), F.lit(0.5)), F.lit(1.1))
    down = F.least(F.greatest(F.abs(F.coalesce("descent", F.lit(0.2))), F.lit(0.1)), F.lit(0.5))
    return items.withColumn("top", F.col("baseline") - up * size).withColumn("bottom", F.col("baseline") + down * size)


def cluster_rows(rows: list[dict], back: int = 12, least: float = 0.5) -> list[list[dict]]:
    """Boxes by baseline and left edge join the best of the last `back` rows: the one whose largest box overlaps most, half at least."""
    out: list[list[dict]] = []
    lead: list[dict] = []
    for r in sorted(rows, key=lambda r: (r["baseline"], r["left"])):
        best, at = 0.0, -1
        for i in range(len(out) - 1, max(-1, len(out) - 1 - back), -1):
            x = lead[i]
            common = min(x["bottom"], r["bottom"]) - max(x["top"], r["top"])
            share = common / max(1e-9, min(x["bottom"] - x["top"], r["bottom"] - r["top"]))
            if share >= least and share > best:
                best, at = share, i
        if at < 0:
            out.append([r])
            lead.append(r)
        else:
            out[at].append(r)
            if r["font_size"] > lead[at]["font_size"]:
                lead[at] = r
    return out


def occupied(row: list[dict], bridge: float) -> list[tuple[float, float]]:
    """The horizontal stretches that a row's boxes cover, gaps up to `bridge` closed."""
    out: list[tuple[float, float]] = []
    for r in sorted(row, key=lambda r: r["left"]):
        if out and r["left"] - out[-1][1] <= bridge:
            out[-1] = (out[-1][0], max(out[-1][1], r["right"]))
        else:
            out.append((r["left"], r["right"]))
    return out


def find_gutter(rows: list[list[dict]], width: float, steps: int = 240) -> float | None:
    """Where a page of two columns parts: the middle of the widest stretch that most rows leave free with text on both sides."""
    if len(rows) < 6:
        return None
    size = statistics.median([r["font_size"] for row in rows for r in row])
    spans = [occupied(row, 0.6 * size) for row in rows]
    xs = [width * (0.3 + 0.4 * i / steps) for i in range(steps + 1)]
    score = []
    for x in xs:
        crossing = sum(any(a < x < b for a, b in s) for s in spans)
        both = sum(any(b <= x for _, b in s) and any(a >= x for a, _ in s) and not any(a < x < b for a, b in s) for s in spans)
        ok = crossing <= 0.12 * len(rows) and both >= max(4, 0.25 * len(rows))
        score.append(both - 3 * crossing if ok else None)
    known = [s for s in score if s is not None]
    if not known:
        return None
    top, best, i = max(known), (0, 0), 0
    while i < len(score):
        j = i
        while j < len(score) and score[j] == top:
            j += 1
        best = max(best, (j - i, -i))
        i = max(j, i + 1)
    n, start = best[0], -best[1]
    return (xs[start] + xs[start + n - 1]) / 2 if xs[start + n - 1] - xs[start] >= 0.008 * width else None


def split_row(row: list[dict], gutter: float | None, size: float) -> list[list[dict]]:
    """A row's pieces: cut where a gap is over 2.4 of the font size or reaches over the gutter."""
    out: list[list[dict]] = []
    for r in sorted(row, key=lambda r: r["left"]):
        if out:
            end = max(x["right"] for x in out[-1])
            if r["left"] - end > 2.4 * size or (gutter is not None and end <= gutter <= r["left"]):
                out.append([r])
                continue
            out[-1].append(r)
        else:
            out.append([r])
    return out


def join_text(piece: list[dict]) -> str:
    """The runs of a piece from the left; a blank where the gap is over .12 of the size, or after an item's number."""
    text, end = "", None
    for r in sorted(piece, key=lambda r: r["left"]):
        t = r["text"]
        if end is not None and not text.endswith(" ") and not t.startswith(" ") and (r["left"] - end > 0.12 * r["font_size"] or (text.rstrip(".)").isdigit() and text[-1:] in ".)")):
            text += " "
        text, end = text + t, r["right"]
    return " ".join(text.split())


def reading_order(lines: list[dict], gutter: float | None) -> list[dict]:
    """Bands between the lines that span both columns; in a band the left column before the right."""
    lines = sorted(lines, key=lambda r: (r["top"], r["left"]))
    if gutter is None:
        return [r | {"column": 0} for r in lines]
    out, band = [], []
    for r in lines:
        spans = r["left"] < gutter < r["right"]
        if spans:
            out += sorted(band, key=lambda x: x["column"])
            out.append(r | {"column": 0})
            band = []
        else:
            band.append(r | {"column": int(r["left"] >= gutter)})
    return out + sorted(band, key=lambda x: x["column"])


def page_lines(items: list[dict], width: float, height: float) -> list[dict]:
    """The lines of a page in reading order, coordinates as fractions of the page."""
    items = [r for r in items if (r["text"] or "").strip() and r["right"] > r["left"]]
    if not items:
        return []
    rows = cluster_rows(items)
    gutter, size = find_gutter(rows, width), statistics.median([r["font_size"] for r in items])
    lines = []
    for row in rows:
        for piece in split_row(row, gutter, size):
            known = [(len(r["text"]), r["bold"]) for r in piece if r["bold"] is not None and r["bold"] == r["bold"]]
            bold = sum(n for n, b in known if b) >= 0.6 * sum(n for n, _ in known) if known else None
            text = join_text(piece)
            lines.append({"text": text, "left": min(r["left"] for r in piece), "top": min(r["top"] for r in piece), "right": max(r["right"] for r in piece), "bottom": max(r["bottom"] for r in piece), "font_size": max(r["font_size"] for r in piece), "chars": len(text), "bold": bold})
    return [r | {"line_idx": i, "left": r["left"] / width, "right": r["right"] / width, "top": r["top"] / height, "bottom": r["bottom"] / height} for i, r in enumerate(reading_order(lines, gutter))]


def lines_of(items: DataFrame, pages: DataFrame) -> DataFrame:
    """text_items and pages to LINES; each page is a group of its own."""
    size = pages.select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), "width", "height")
    d = boxes(items).join(size, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p"))).drop("_b", "_p")

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        found = page_lines(g.to_dict("records"), float(g["width"].iloc[0]), float(g["height"].iloc[0]))
        if not found:
            return None
        out = pd.DataFrame(found).assign(book_id=g["book_id"].iloc[0], page=int(g["page"].iloc[0]))
        return out[[x.split()[0] for x in LINES.split(", ")]]

    return by_runs(d, ["book_id", "page"], ["item_idx"], run, LINES)


def blocks(lines: DataFrame, gap: float = 1.7) -> DataFrame:
    """lines with block: a new one where the gap to the line above in its column is over `gap` line heights."""
    w = Window.partitionBy("book_id", "page", "column").orderBy("top", "left", "line_idx")
    height = F.greatest(F.col("bottom") - F.col("top"), F.lit(1e-6))
    new = F.coalesce((F.col("top") - F.lag("bottom").over(w) > gap * height).cast("int"), F.lit(1))
    return lines.withColumn("_n", new).withColumn("block", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_n")


def merge_headings(headings: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Headings of one size that stand close under one another become one; their texts are joined."""
    w = Window.partitionBy("book_id", "page").orderBy("top", "left")
    same = (F.abs(F.col("font_size") - F.lag("font_size").over(w)) < 0.1) & (F.col("top") - F.lag("bottom").over(w) < tolerance * (F.col("bottom") - F.col("top")))
    d = headings.withColumn("_n", F.when(same, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy("book_id", "page", "_g").agg(F.array_sort(F.collect_list(F.struct("top", "left", "text"))).alias("_t"), F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("font_size").alias("font_size"), F.max("confidence").alias("confidence"))
    return g.withColumn("text", F.array_join("_t.text", " ")).drop("_t", "_g")


def item_cells(text: str, most_step: int = 3) -> list[tuple[int, str]]:
    """A row of items cut at its rising numbers: (number, text) of each; one piece where fewer than two numbers rise."""
    import re

    marks = [(m.start(), int(m[1])) for m in re.finditer(r"(?:(?<=\s)|^)(\d{1,4})[.)](?=\s)", text)]
    kept: list[tuple[int, int]] = []
    for at, n in marks:
        if not kept or 1 <= n - kept[-1][1] <= most_step:
            kept.append((at, n))
    if len(kept) < 2:
        return [(kept[0][1], text)] if kept and kept[0][0] == 0 else []
    ends = [at for at, _ in kept[1:]] + [len(text)]
    return [(n, text[at:end].strip()) for (at, n), end in zip(kept, ends, strict=True)]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])))
def cells(text: pd.Series) -> pd.Series:
    """item_cells() of a column of lines; null for null."""
    return text.map(lambda t: None if t is None else [{"n": n, "text": x} for n, x in item_cells(t)])


def ink_rows(ink: np.ndarray, below: float = 0.004) -> np.ndarray:
    """Which bands of a page's ink profile are white."""
    return np.asarray(ink, float) < below


def nearest_white(ink: np.ndarray, at: float, reach: float = 0.02) -> float:
    """The middle of the white band that is nearest to a height, within reach; the height itself where there is none."""
    white = np.flatnonzero(ink_rows(ink))
    if not len(white):
        return at
    middles = (white + 0.5) / len(ink)
    best = middles[np.argmin(np.abs(middles - at))]
    return float(best) if abs(best - at) <= reach else at


def headings(lines: DataFrame, accept: float = 0.55) -> DataFrame:
    """lines with confidence: size against the body, weight, number, keyword, brevity, the gap above; those accepted, with depth.

    The body's size of a book is the one that most characters have; depth is the number's, or the rank of the size.
    """
    from quirework.operators.statistics import weighted_mode

    half = F.floor(F.col("font_size") * 2 + 0.5) / 2
    first = F.struct("page", "line_idx")
    body = weighted_mode(lines, ["book_id"], half, F.col("chars"), first).select(F.col("book_id").alias("_b"), F.col("mode").alias("body"))
    w = Window.partitionBy("book_id", "page", "column").orderBy("top", "left", "line_idx")
    d = lines.join(body, F.col("book_id") == F.col("_b")).drop("_b").withColumn("_gap", F.col("top") - F.lag("bottom").over(w))
    ratio = F.col("font_size") / F.col("body")
    numbered = F.regexp_extract("text", r"^(\d{1,3}(?:\.\d{1,3})*)\.?\s+\p{L}", 1)
    score = F.when(ratio >= 1.6, 0.6).when(ratio >= 1.3, 0.45).when(ratio >= 1.12, 0.25).otherwise(0.0)
    score = score + F.when(F.col("bold"), 0.2).otherwise(0.0) + F.when(numbered.contains("."), 0.25).when(numbered != "", 0.2).otherwise(0.0)
    score = score + F.when(F.col("text").rlike(r"^(?i:chapter|section|part|appendix|kapitel|teil)\b"), 0.3).otherwise(0.0) + F.when(F.col("chars") <= 60, 0.1).otherwise(0.0)
    score = score - F.when(F.col("text").rlike(r"[.,;]$"), 0.2).otherwise(0.0) - F.when(F.col("chars") > 120, 0.3).otherwise(0.0) + F.when(F.col("_gap") > (F.col("bottom") - F.col("top")), 0.1).otherwise(0.0)
    found = d.withColumn("confidence", F.least(F.lit(1.0), F.round(score, 2))).filter(F.col("confidence") >= accept)
    rank = F.dense_rank().over(Window.partitionBy("book_id").orderBy(F.col("font_size").desc())) - 1
    return found.withColumn("depth", F.when(numbered != "", F.size(F.split(numbered, r"\.")) - 1).otherwise(rank).cast("int")).drop("_gap")


__all__ = ["LINES", "blocks", "boxes", "cells", "headings", "item_cells", "lines_of", "merge_headings", "nearest_white", "page_lines"]
