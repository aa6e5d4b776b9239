"""Proposals: where items start, how far they reach, and which answers belong to them."""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import lines as L
from quirework.functions.grouped import by_runs
from quirework.operators.census import select_sequence

FRAMES = "book_id string, label string, style string, confidence double, page int, left double, top double, right double, bottom double, n_regions int"
ACCEPT, REJECTED = 0.5, 0.2
TITLE_SCORE, TITLE_LEAD = 0.5, 0.15


def start_candidates(lines: DataFrame) -> DataFrame:
    """(book_id, page, line_idx, style, label, confidence, accepted): lines that may start an item.

    The style's confidence, .2 less beyond the body's left edge by .06, .15 less in large type unless a keyword starts it; a
    rising run of three of a style adds .25 (.06 for keywords), of two the half, and a number alone among four loses .15.
    """
    half = F.floor(F.col("font_size") * 2 + 0.5) / 2
    body = lines.groupBy("book_id", half.alias("_size")).agg(F.sum("chars").alias("_c")).groupBy(F.col("book_id").alias("_b")).agg(F.max_by("_size", "_c").alias("_body"))
    middle = lines.filter("chars >= 20").groupBy(F.col("book_id").alias("_b2")).agg(F.median("left").alias("_m"))
    left = lines.filter("chars >= 20").join(middle, F.col("book_id") == F.col("_b2")).filter(F.col("left") <= F.col("_m") + 0.02).groupBy(F.col("book_id").alias("_b2")).agg(F.median("left").alias("_left"))
    d = lines.withColumn("_s", L.start_style(F.trim("text"))).filter("_s IS NOT NULL").select(*lines.columns, "_s.style", "_s.label", "_s.confidence")
    d = d.join(body, F.col("book_id") == F.col("_b")).join(left, F.col("book_id") == F.col("_b2"), "left").withColumn("_n", F.regexp_extract("label", r"(\d+)", 1).try_cast("int"))
    order = Window.partitionBy("book_id", "style").orderBy("page", "column", "top", "line_idx")
    d = d.withColumn("_new", (F.col("_n") != F.lag("_n", 1, -9).over(order) + 1).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy("book_id", "style", "_run"))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("book_id", "style")))
    keyword = F.col("style") == "keyword"
    more = F.when(keyword, 0.06).otherwise(0.25)
    score = F.col("confidence") - F.when(F.col("left") > F.col("_left") + 0.06, 0.2).otherwise(0.0) - F.when((F.col("font_size") >= 1.2 * F.col("_body")) & ~keyword, 0.15).otherwise(0.0)
    score = score + F.when(F.col("_len") >= 3, more).when(F.col("_len") == 2, more / 2).when(F.col("_all") >= 4, -0.15).otherwise(0.0)
    d = d.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 2)).filter(F.col("confidence") >= REJECTED)
    return d.select("book_id", "page", "line_idx", "column", "left", "top", "right", "bottom", "style", "label", "confidence", (F.col("confidence") >= ACCEPT).alias("accepted"))


def item_frames(lines: DataFrame, starts: DataFrame, margin: float = 0.012, most: int = 3) -> DataFrame:
    """FRAMES: from each accepted start to the next in reading order, a region for each page and column, at most `most` more.

    Regions are as wide as the body of their column and a margin; their number is told, the first is given.
    """
    s = starts.filter("accepted").select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), F.col("line_idx").alias("_i"), "style", "label", "confidence")
    d = lines.join(s, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")) & (F.col("line_idx") == F.col("_i")), "left")
    order = Window.partitionBy("book_id").orderBy("page", "line_idx")
    d = d.withColumn("_item", F.count("label").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_item > 0")
    stop = F.max(L.line_class(F.col("text")) == "heading").over(Window.partitionBy("book_id", "_item").orderBy("page", "line_idx").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_stop", stop).filter("NOT _stop")
    width = lines.groupBy(F.col("book_id").alias("_wb"), F.col("column").alias("_wc")).agg(F.percentile("left", 0.05).alias("_l"), F.percentile("right", 0.95).alias("_r"))
    r = d.groupBy("book_id", "_item", "page", "column").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.max("style").alias("style"), F.max("label").alias("label"), F.max("confidence").alias("confidence"))
    r = r.join(width, (F.col("book_id") == F.col("_wb")) & (F.col("column") == F.col("_wc")))
    at = Window.partitionBy("book_id", "_item").orderBy("page", "column")
    r = r.withColumn("_k", F.row_number().over(at)).withColumn("n_regions", F.least(F.count(F.lit(1)).over(Window.partitionBy("book_id", "_item")), F.lit(most + 1)).cast("int"))
    first = r.filter("_k = 1")
    return first.select("book_id", "label", "style", F.round(F.col("confidence") - F.when(F.col("n_regions") > 1, 0.1).otherwise(0.0), 2).alias("confidence"), "page", F.greatest(F.lit(0.0), F.least("left", "_l") - margin).alias("left"), "top", F.least(F.lit(1.0), F.greatest("right", "_r") + margin).alias("right"), "bottom", "n_regions")


def section_items(candidates: DataFrame, max_jump: int = 3) -> DataFrame:
    """candidates(book_id, section, n, suffix, page, top, left) that make a section's sequence; see select_sequence()."""
    names = candidates.columns

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        kept = select_sequence(g.to_dict("records"), max_jump)
        return pd.DataFrame(kept, dtype=object)[names] if kept else None

    return by_runs(candidates, ["book_id", "section"], ["page", "top", "left", "n", "suffix"], run, candidates.schema)


def item_confidence(items: list[dict], pitch: float | None = None) -> list[float]:
    """.9 for each item of a section; less .25 for a weak one, .1 beside a missing number, .15 thin, .05 without instruction."""
    numbers = {x["n"] for x in items}
    pitch = pitch or statistics.median([b["top"] - a["top"] for a, b in zip(items, items[1:], strict=False) if a["page"] == b["page"] and 0 < b["top"] - a["top"] < 0.06] or [0.018])
    out = []
    for x in items:
        c = 0.9 - 0.25 * bool(x.get("weak")) - 0.15 * (x.get("bottom", 1) - x["top"] < min(0.014, pitch)) - 0.05 * (not x.get("instruction"))
        beside = (x["n"] > min(numbers) and x["n"] - 1 not in numbers) or (x["n"] < max(numbers) and x["n"] + 1 not in numbers)
        out.append(round(max(0.1, c - 0.1 * beside), 2))
    return out


def labelled_inline(lines: DataFrame, words: str = "Aufgabe|Exercise|Problem|Exercice|Ejercicio", answers: str = "Lösung|Solution|Answer|Solución") -> DataFrame:
    """(book_id, page, line_idx, role, label) of lines such as '1.2.3 Exercise:' and 'Solution 1.2.3'."""
    item = F.regexp_extract("text", rf"^\s*(\d+(?:\.\d+)+)\s+(?i:{words})\b", 1)
    item2 = F.regexp_extract("text", rf"^\s*(?i:{words})\s+(\d+(?:\.\d+)+)\b", 1)
    answer = F.regexp_extract("text", rf"^\s*(?i:{answers})\s+(\d+(?:\.\d+)+)\b", 1)
    role = F.when(answer != "", "answer").when((item != "") | (item2 != ""), "item")
    return lines.withColumn("role", role).filter("role IS NOT NULL").select("book_id", "page", "line_idx", "role", F.when(F.col("role") == "answer", answer).when(item != "", item).otherwise(item2).alias("label"))


def answer_ranges(key_lines: DataFrame, most: int = 60) -> DataFrame:
    """(book_id, section, n, page, top, by_range): numbers that the lines of a key answer, ranges `1-7.` of up to `most` numbers
    each; an answer of its own beats one of a range."""
    first = F.regexp_extract("text", r"^\s*(\d{1,4})", 1).try_cast("int")
    last = F.regexp_extract("text", r"^\s*\d{1,4}\s*[-–]\s*(\d{1,4})[.):]", 1).try_cast("int")
    single = F.col("text").rlike(r"^\s*\d{1,4}[.)]\s")
    ns = F.when(last.isNotNull() & (last >= first) & (last - first < most), F.sequence(first, last)).when(single, F.array(first))
    d = key_lines.withColumn("by_range", last.isNotNull()).withColumn("n", F.explode(ns))
    w = Window.partitionBy("book_id", "section", "n").orderBy("by_range", "page", "top")
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("book_id", "section", "n", "page", "top", "by_range")


def _title_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(_b, _k, _t): the different titles _k of left and _t of right, of a book _b, that share a word and score `least` or more.

    Of two sets of m and n words that are alike by t, o = t / (1 + t) * (m + n) are common, so that the rarest m - o + 1 and n - o + 1
    of each have one in common: a word of many titles brings none together that have no other. A title within another is looked up
    among the other's pieces of the lengths that titles have.
    """
    t = least - 0.01  # a little less, as scores are rounded
    both = left.select("_b", F.col("_k").alias("_x"), F.lit(True).alias("_l")).unionByName(right.select("_b", F.col("_t").alias("_x"), F.lit(False).alias("_l")))
    titles = both.filter("_x IS NOT NULL").groupBy("_b", "_x").agg(F.max("_l").alias("_left"), F.max(~F.col("_l")).alias("_right")).withColumn("_ws", F.array_distinct(F.split("_x", " ")))
    words = titles.select("_b", "_x", F.explode("_ws").alias("_w"))
    often = words.groupBy(F.col("_b").alias("_wb"), F.col("_w").alias("_ww")).agg(F.count(F.lit(1)).alias("_n"))
    rare = words.join(often, (F.col("_b") == F.col("_wb")) & (F.col("_w") == F.col("_ww"))).groupBy("_b", "_x").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_w"))), lambda x: x["_w"]).alias("_ws"))
    measured = titles.select("_b", "_x", "_left", "_right", F.size("_ws").alias("_m"), F.length("_x").alias("_len"))
    there = measured.groupBy(F.col("_b").alias("_sb")).agg(F.collect_set("_m").alias("_sizes"), F.collect_set("_len").alias("_lens"))
    d = measured.join(rare, ["_b", "_x"]).join(there, F.col("_b") == F.col("_sb")).drop("_sb")

    sized = d.withColumn("_o", F.explode(F.filter("_sizes", lambda n: (n >= t * F.col("_m")) & (n * t <= F.col("_m")))))
    common = F.ceil(t / (1 + t) * (F.col("_m") + F.col("_o")) - 1e-9).cast("int")
    first = sized.withColumn("_w", F.explode(F.slice("_ws", F.lit(1), F.greatest(F.lit(1), F.col("_m") - common + 1))))
    x = first.filter("_left").select("_b", F.col("_x").alias("_k"), "_m", "_o", "_w")
    y = first.filter("_right").select("_b", F.col("_x").alias("_t"), F.col("_o").alias("_m"), F.col("_m").alias("_o"), "_w")
    alike = x.join(y, ["_b", "_m", "_o", "_w"]).select("_b", "_k", "_t")

    def within(outer: DataFrame, inner: DataFrame, a: str, b: str) -> DataFrame:
        at = F.filter(F.flatten(F.transform(F.filter("_lens", lambda n: (n > 0) & (n < F.col("_len"))), lambda n: F.transform(F.sequence(F.lit(1), F.col("_len") - n + 1), lambda i: F.substring(F.col("_x"), i, n)))), lambda p: ~p.startswith(" ") & ~p.endswith(" "))
        pieces = outer.select("_b", F.col("_x").alias(a), "_ws", F.explode(F.array_distinct(at)).alias(b)).filter(F.arrays_overlap(F.split(b, " "), F.col("_ws")))
        return pieces.join(inner.select("_b", F.col("_x").alias(b)), ["_b", b]).select("_b", "_k", "_t")

    return alike.unionByName(within(d.filter("_left"), d.filter("_right"), "_k", "_t")).unionByName(within(d.filter("_right"), d.filter("_left"), "_t", "_k")).distinct()


def match_blocks(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, block, section, how): an answer block's section by its marker, else by the best title of .5 and .15 more than the next."""
    from quirework.operators.reconcile import title_score

    s = sections.select(F.col("book_id").alias("_b"), F.col("label").alias("section"), L.title_key(F.col("title")).alias("_t"))
    by_label = blocks.join(s, (F.col("book_id") == F.col("_b")) & (F.col("marker") == F.col("section"))).select("book_id", "block", "section", F.lit("marker").alias("how"))
    rest = blocks.join(by_label.select("book_id", "block"), ["book_id", "block"], "left_anti").filter("title IS NOT NULL")
    k = rest.withColumn("_k", L.title_key(F.col("title")))
    # whichever two of the sections of a title stand for it: with a second one none is told
    named = s.filter("_t IS NOT NULL").groupBy("_b", "_t").agg(F.array_distinct(F.array(F.min(F.struct("section")), F.max(F.struct("section")))).alias("_s"))
    scored = _title_pairs(k.select(F.col("book_id").alias("_b"), "_k"), named.select("_b", "_t"), TITLE_SCORE - TITLE_LEAD).withColumn("score", title_score(F.col("_k"), F.col("_t")))
    each = scored.join(named, ["_b", "_t"]).select("_b", "_k", F.explode("_s.section").alias("section"), "score").distinct()
    best = each.withColumn("_r", F.row_number().over(Window.partitionBy("_b", "_k").orderBy(F.col("score").desc(), "section"))).filter("_r <= 2").select("_b", F.col("_k").alias("_key"), "section", "score")
    pairs = k.join(best, (F.col("book_id") == F.col("_b")) & (F.col("_k") == F.col("_key"))).select("book_id", "block", "section", "score").distinct()
    w = Window.partitionBy("book_id", "block").orderBy(F.col("score").desc(), "section")
    ranked = pairs.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    by_title = ranked.filter((F.col("_r") == 1) & (F.col("score") >= TITLE_SCORE) & (F.col("score") - F.col("_next") >= TITLE_LEAD)).select("book_id", "block", "section", F.lit("title").alias("how"))
    return by_label.unionByName(by_title)


def parts(lines: DataFrame) -> DataFrame:
    """(book_id, item, style, first_ordinal, length): the best rising run of part marks of each item, of two marks at least.

    lines(book_id, item, page, line_idx, text): an item's own lines.
    """
    from quirework.operators.statistics import rising_runs

    m = lines.withColumn("_m", F.explode(L.part_marks(F.trim("text")))).select("book_id", "item", "page", "line_idx", "_m.style", L.part_ordinal(F.col("_m.style"), F.col("_m.mark")).alias("ordinal")).filter("ordinal IS NOT NULL")
    priority = {name: k for k, (name, _) in enumerate(L.PART_STYLES)}
    return rising_runs(m, ["book_id", "item"], "style", ["page", "line_idx"], "ordinal", priority).filter("length >= 2")
