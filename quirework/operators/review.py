"""Plans of sheets, batch reports, and the smaller joins of a review."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework import constants as C
from quirework.functions import rects
from quirework.functions.grouped import append_by_runs
from quirework.operators import geometry, statistics


def sheet_plan(items: DataFrame, key: Sequence[str], order: Sequence[str], across: int, down: int) -> DataFrame:
    """items with sheet, row and column, from 0: `across` by `down` pictures on a sheet, in order."""
    i = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    n = across * down
    return items.withColumn("_i", i).withColumn("sheet", F.floor(F.col("_i") / n).cast("int")).withColumn("row", F.floor(F.col("_i") % n / across).cast("int")).withColumn("column", (F.col("_i") % across).cast("int")).drop("_i")


def batch_index(books: DataFrame, gates: DataFrame, summaries: DataFrame) -> DataFrame:
    """(book_id, title, items, answered, open, unconfirmed, status, line): one row a book, with its line of a Markdown table."""
    j = books.join(gates, "book_id", "left").join(summaries, "book_id", "left").na.fill(0, ["items", "answered", "open", "unconfirmed"])
    status = F.when(F.col("perfect"), "PERFECT").when(F.col("items") == 0, "ZERO EXERCISES").when(F.col("open") > 0, "NOT FINISHED").otherwise("AWAITING CONFIRMATION")
    d = j.withColumn("status", status)
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("title", "items", "answered", "open", "unconfirmed", "status")]), F.lit(" |"))
    return d.select("book_id", "title", "items", "answered", "open", "unconfirmed", "status", line.alias("line"))


def upright(items: DataFrame, angle: str = "angle", most: float = 0.17) -> DataFrame:
    """text_items without vertical and rotated runs; a run of stretched glyphs (no size of its own) gets its page's median size."""
    straight = items.filter(F.abs(F.coalesce(angle, F.lit(0.0))) <= most)
    mid = straight.filter("font_size > 0").groupBy(F.col("book_id").alias("_b"), F.col("page").alias("_p")).agg(F.median("font_size").alias("_m"))
    j = straight.join(mid, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")), "left")
    return j.withColumn("font_size", F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(F.col("_m"))).drop("_b", "_p", "_m")


def header_footer(lines: DataFrame, pages: DataFrame, key: Column) -> DataFrame:
    """lines with header_footer, by the keys of a sample of each book's pages: in the band, on as many sampled pages as the rule asks.

    lines(book_id, page, rect, ...); pages(book_id, page_count)."""
    from quirework.functions.lines import in_band

    chosen = pages.select(F.col("book_id").alias("_b"), "page_count", F.explode(statistics.sampled_pages(F.col("page_count"))).alias("_p"))
    sample = lines.filter(in_band(F.col("rect"))).join(chosen, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")))
    keys = statistics.repeated_keys(sample, key, "page", 2, ["book_id"])
    n = pages.select(F.col("book_id").alias("_b"), statistics.header_threshold(F.least(F.col("page_count"), F.lit(C.HEADER_SAMPLE))).alias("_least"))
    kept = keys.join(n, F.col("book_id") == F.col("_b")).filter(F.col("n_pages") >= F.col("_least")).select("book_id", "key")
    banded = F.when(in_band(F.col("rect")), key).otherwise(F.lit("\x00"))
    return statistics.mark_running_lines(lines, kept, banded, ["book_id"])


def running_heads(lines: DataFrame, key: Column, pages: int = C.RUNNING_PAGES, chars: int = C.RUNNING_CHARS) -> DataFrame:
    """lines with running: its key is on `pages` pages of the book and long enough, or the line stands on the row of such a one."""
    long = lines.withColumn("_key", key).filter(F.length("_key") >= chars)
    keys = statistics.repeated_keys(long, F.col("_key"), "page", pages, ["book_id"])
    marked = statistics.mark_running_lines(lines, keys, key, ["book_id"]).withColumnRenamed("header_footer", "_own") if "header_footer" not in lines.columns else statistics.mark_running_lines(lines.drop("header_footer"), keys, key, ["book_id"]).withColumnRenamed("header_footer", "_own")
    heads = marked.filter("_own").select("book_id", "page", F.col("rect.top").alias("lo"), F.col("rect.bottom").alias("hi"))
    rest = marked.filter("NOT _own").withColumn("lo", F.col("rect.top")).withColumn("hi", F.col("rect.bottom"))
    beside = geometry.overlaps(rest.select("book_id", "page", "line_idx", "lo", "hi"), heads, ["book_id", "page"], "lo", "hi", 0.125).select(F.col("a_book_id").alias("book_id"), F.col("a_page").alias("page"), F.col("a_line_idx").alias("line_idx")).distinct().withColumn("_beside", F.lit(True))
    return marked.join(beside, ["book_id", "page", "line_idx"], "left").withColumn("running", F.col("_own") | F.coalesce("_beside", F.lit(False))).drop("_own", "_beside")


def item_rows(items: DataFrame, overlap: float = 0.5) -> DataFrame:
    """items with row and row_size: an item joins the row above if it overlaps the row's first item by half, sideways apart.

    The anchor is the row's first item, so a page is folded in order."""
    added = [T.StructField("row", T.IntegerType()), T.StructField("row_size", T.IntegerType())]

    def run(b: pa.RecordBatch, at: list[int]) -> list[pa.Array]:
        tops, bottoms = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("top", "bottom"))
        out: list[int] = []
        first: list[int] = []  # the place of each item's first of its row
        for i, j in itertools.pairwise(at):
            row = -1
            for k in range(i, j):
                top, bottom = tops[k], bottoms[k]
                if row < 0 or min(bottom, high) - max(top, low) < overlap * min(bottom - top, high - low):
                    row, low, high, start = row + 1, top, bottom, k
                out.append(row)
                first.append(start)
        return [pa.array(out, pa.int32()), pa.array(np.bincount(first)[first], pa.int32())]

    return append_by_runs(items, ["book_id", "page"], ["top", "left"], added, run)


def snap(edge: float, lines: list[tuple[float, float]], rounds: int = 6, margin: float = 0.002) -> float:
    """A divider moved off the lines it would cut, to the nearer side of each, up to `rounds` times."""
    for _ in range(rounds):
        cut = next(((a, b) for a, b in lines if a < edge < b), None)
        if cut is None:
            return edge
        edge = cut[0] - margin if edge - cut[0] < cut[1] - edge else cut[1] + margin
    return edge


def merge_fractions(rows: list[dict], least: float = 0.2, reach: float = 4 / 600) -> list[dict]:
    """Lines of a column that overlap by a fifth of the lower one and stand close sideways become one, with its parts."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: (r["top"], r["left"])):
        for x in reversed(out[-6:]):
            common = min(x["bottom"], r["bottom"]) - max(x["top"], r["top"])
            gap = max(r["left"] - x["right"], x["left"] - r["right"])
            if x.get("column") == r.get("column") and common >= least * min(x["bottom"] - x["top"], r["bottom"] - r["top"]) and gap < reach * max(x["font_size"], r["font_size"]):
                x["parts"] = [*x.get("parts", [{k: x[k] for k in ("text", "left", "top", "right", "bottom")}]), {k: r[k] for k in ("text", "left", "top", "right", "bottom")}]
                x |= {"left": min(x["left"], r["left"]), "top": min(x["top"], r["top"]), "right": max(x["right"], r["right"]), "bottom": max(x["bottom"], r["bottom"]), "text": " ".join(p["text"] for p in sorted(x["parts"], key=lambda p: (p["left"], p["top"])))}
                break
        else:
            out.append(dict(r))
    return out


def union_regions(rows: DataFrame, key: Sequence[str], regions: str) -> DataFrame:
    """(key, regions): the regions of a key's rows, equal ones within the last digit kept once."""
    r = rows.select(*key, F.explode(regions).alias("r")).select(*key, F.struct(F.col("r.page").alias("page"), rects.rounded(F.col("r.rect")).alias("rect")).alias("r")).distinct()
    return r.groupBy(*key).agg(F.sort_array(F.collect_list("r")).alias(regions))


def frame_of(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """wanted(book_id, id, section, label) with found: the frame of that id, else of that section and label."""
    by_id = frames.select(F.col("book_id").alias("_b1"), F.col("id").alias("_id"))
    by_label = frames.filter("authority IS NOT NULL").select(F.col("book_id").alias("_b2"), F.col("section").alias("_s"), F.col("label").alias("_l"), F.col("id").alias("_id2"))
    j = wanted.join(by_id, (F.col("book_id") == F.col("_b1")) & (F.col("id") == F.col("_id")), "left").join(by_label, (F.col("book_id") == F.col("_b2")) & (F.col("section") == F.col("_s")) & (F.col("label") == F.col("_l")), "left")
    return j.withColumn("found", F.coalesce("_id", "_id2")).drop("_b1", "_b2", "_id", "_id2", "_s", "_l")


def outline_diff(current: DataFrame, derived: DataFrame) -> DataFrame:
    """(book_id, key, state): new, changed, same or gone, entries matched by label, or by title where they have none."""
    from quirework.functions.lines import title_key

    key = F.coalesce(F.col("label"), title_key(F.col("title"))).alias("key")
    side = lambda d, n: d.select(F.col("book_id").alias(f"_{n}b"), key.alias(f"_{n}k"), F.struct(title_key(F.col("title")).alias("t"), "page", "depth").alias(f"_{n}v"))
    j = side(current, "c").join(side(derived, "d"), (F.col("_cb") == F.col("_db")) & (F.col("_ck") == F.col("_dk")), "full_outer")
    state = F.when(F.col("_ck").isNull(), "new").when(F.col("_dk").isNull(), "gone").when(F.col("_cv") == F.col("_dv"), "same").otherwise("changed")
    return j.select(F.coalesce("_cb", "_db").alias("book_id"), F.coalesce("_ck", "_dk").alias("key"), state.alias("state"))
