"""Which lines belong to which item of a section, and the regions that frame them."""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework import constants as C
from quirework.functions.grouped import by_runs

OWNED = "book_id string, section string, page int, line_idx int, label string, how string, continues boolean"
REGIONS = "book_id string, section string, label string, ord int, page int, left double, top double, right double, bottom double, n_lines int, figure boolean"
ROW_GAP = (-0.01, 0.045)
SPACE = 0.15


def clusters(values: list[float], tolerance: float = 0.02) -> list[float]:
    """The first value of each cluster of sorted values within tolerance of it."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def column_of(left: float, anchors: list[float], slack: float = 0.02) -> int:
    """The last column that begins at or before a left edge; the first for what stands before all."""
    return max([i for i, a in enumerate(anchors) if a <= left + slack], default=0)


def overlap(a: dict, b: dict) -> float:
    common = min(a["bottom"], b["bottom"]) - max(a["top"], b["top"])
    return common / max(1e-9, min(a["bottom"] - a["top"], b["bottom"] - b["top"]))


def pitch_of(lines: list[dict], usual: float = 0.018) -> float:
    """The median step between successive lines of one left edge, steps under .06."""
    steps = [b["top"] - a["top"] for a, b in zip(lines, lines[1:], strict=False) if a["page"] == b["page"] and abs(a["left"] - b["left"]) < 0.01 and 0 < b["top"] - a["top"] < 0.06]
    return statistics.median(steps) if steps else usual


def owners(lines: list[dict]) -> list[tuple[str | None, str, bool]]:
    """For each line of a section, in reading order: its item's label, how it was found, and whether it goes on from an earlier page or column.

    lines: page, left, top, right, bottom, text, start (label or None), role (text, instruction, heading or furniture). Starts
    own their line. Instructions and headings end what is above them and belong to nobody. Any other line belongs to the item
    on its row that it follows closely, else to the one in its column that it overlaps, else to the one above it in its column
    within a space, else to the last of the page before where nothing has started above it, else to none (an orphan).
    """
    step = pitch_of(lines)
    space = max(SPACE, 8 * step)
    out: list[tuple[str | None, str, bool]] = []
    carried: str | None = None
    page, starts, anchors, floor, last_of = None, [], [], 0.0, {}
    for r in lines:
        if r["page"] != page:
            carried = last_of[max(last_of)][0] if last_of else carried
            page, floor, last_of = r["page"], 0.0, {}
            starts = [x for x in lines if x["page"] == page and x["start"]]
            anchors = clusters([x["left"] for x in starts])
        if r["start"]:
            last_of[column_of(r["left"], anchors)] = (r["start"], r["bottom"])
            out.append((r["start"], "start", False))
            continue
        if r["role"] != "text":
            if r["role"] in ("instruction", "heading"):
                floor, last_of, carried = r["bottom"], {}, None
            out.append((None, r["role"], False))
            continue
        column = column_of(r["left"], anchors)
        row = [s for s in starts if overlap(s, r) >= 0.3 and ROW_GAP[0] <= r["left"] - s["right"] <= ROW_GAP[1]]
        beside = [s for s in starts if column_of(s["left"], anchors) == column and overlap(s, r) >= 0.3]
        if row:
            found = (max(row, key=lambda s: s["right"])["start"], "row", False)
        elif beside:
            found = (beside[0]["start"], "overlap", False)
        elif column in last_of and r["top"] - last_of[column][1] <= space:
            found = (last_of[column][0], "above", False)
        elif column - 1 in last_of and not any(column_of(s["left"], anchors) == column and s["top"] < r["top"] for s in starts) and r["top"] >= floor:
            found = (last_of[column - 1][0], "column", True)
        elif carried and not any(s["top"] < r["top"] for s in starts) and floor == 0.0:
            found = (carried, "page", True)
        else:
            found = (None, "orphan", False)
        if found[0]:
            last_of[column] = (found[0], r["bottom"])
        out.append(found)
    return out


def assign(lines: DataFrame) -> DataFrame:
    """OWNED of lines(book_id, section, page, line_idx, left, top, right, bottom, text, start, role): a section is a group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.astype(object).where(g.notna(), None)
        found = owners(g.to_dict("records"))
        keep = g[["book_id", "section", "page", "line_idx"]].reset_index(drop=True)
        return pd.concat([keep, pd.DataFrame(found, columns=["label", "how", "continues"])], axis=1)

    return by_runs(lines, ["book_id", "section"], ["page", "line_idx"], run, OWNED)


def regions(lines: DataFrame, owned: DataFrame, margin: float = 0.012, above: float = 0.006, below: float = 0.004, most: int = C.MAX_REGIONS) -> DataFrame:
    """REGIONS of owned lines: one for each item, page and column stretch, in order, a margin about them that stops halfway to the neighbours.

    An item is a figure if it is its number alone, or has three lines of which half are short.
    """
    keys = ["book_id", "section", "page", "line_idx"]
    d = lines.join(owned.filter("label IS NOT NULL"), keys)
    order = Window.partitionBy("book_id", "section").orderBy("page", "line_idx")
    new = (~F.col("label").eqNullSafe(F.lag("label").over(order)) | (F.col("page") != F.lag("page").over(order)) | (F.col("continues") & ~F.lag("continues").over(order)) | (F.col("top") < F.lag("top").over(order) - 0.05)).cast("int")
    d = d.withColumn("_n", F.coalesce(new, F.lit(1))).withColumn("_s", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    short = F.count_if(F.length("text") <= 14)
    g = d.groupBy("book_id", "section", "label", "page", "_s").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).cast("int").alias("n_lines"), short.alias("_short"), F.sum(F.length("text")).alias("_chars"))
    at = Window.partitionBy("book_id", "section", "page").orderBy("top", "left")
    # neighbours in the same stretch of the page's width meet halfway
    meets = lambda r: (F.col("left") < F.col(f"{r}.right")) & (F.col("right") > F.col(f"{r}.left"))
    g = g.withColumn("_up", F.lag(F.struct("left", "right", "bottom")).over(at)).withColumn("_down", F.lead(F.struct("left", "right", "top")).over(at))
    top = F.when(meets("_up") & (F.col("_up.bottom") < F.col("top")), F.greatest(F.col("top") - above, (F.col("top") + F.col("_up.bottom")) / 2)).otherwise(F.col("top") - above)
    bottom = F.when(meets("_down") & (F.col("_down.top") > F.col("bottom")), F.least(F.col("bottom") + below, (F.col("bottom") + F.col("_down.top")) / 2)).otherwise(F.col("bottom") + below)
    g = g.withColumn("_t", F.greatest(F.lit(0.0), top)).withColumn("_b", F.least(F.lit(1.0), bottom)).withColumn("ord", F.row_number().over(Window.partitionBy("book_id", "section", "label").orderBy("_s")) - 1)
    figure = ((F.col("n_lines") == 1) & (F.col("_chars") <= F.length("label") + 2)) | ((F.col("n_lines") >= 3) & (F.col("_short") * 2 >= F.col("n_lines")))
    kept = g.filter(F.col("ord") <= most)
    return kept.select("book_id", "section", "label", F.col("ord").cast("int").alias("ord"), "page", F.greatest(F.lit(0.0), F.col("left") - margin).alias("left"), F.col("_t").alias("top"), F.least(F.lit(1.0), F.col("right") + margin).alias("right"), F.col("_b").alias("bottom"), "n_lines", F.coalesce(figure, F.lit(False)).alias("figure"))


def instructions(lines: DataFrame) -> DataFrame:
    """(book_id, section, page, line_idx, named, label): the instruction that governs each item: the last one above it in the section,
    where it names numbers only if the item's is among them."""
    from quirework.functions.labels import named_numbers

    order = Window.partitionBy("book_id", "section").orderBy("page", "line_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("role") == "instruction", F.struct("page", "line_idx", "text")), ignorenulls=True).over(order)
    d = lines.withColumn("_i", last).filter("start IS NOT NULL AND _i IS NOT NULL").withColumn("named", named_numbers(F.col("_i.text")))
    n = F.regexp_extract("start", r"(\d+)", 1).try_cast("int")
    return d.filter((F.size("named") == 0) | F.array_contains("named", n)).select("book_id", "section", F.col("_i.page").alias("page"), F.col("_i.line_idx").alias("line_idx"), "named", F.col("start").alias("label"))
