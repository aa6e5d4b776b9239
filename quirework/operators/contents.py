"""Printed contents, headings of pages and the sections that both make."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.grouped import by_runs

ENTRY = re.compile(r"^\s*(?:(?P<word>chapter|kapitel|part|teil)\s+)?(?P<label>\d{1,3}(?:\.\d{1,3}){0,2}|[IVXLC]{1,6}(?![^\W\d_]))?[.:]?\s*(?P<title>\D.*?)\s*(?P<leader>(?:\.\s?){2,}|\s{3,}|\s)(?P<page>\d{1,4})\s*$", re.I)
ENTRIES = "book_id string, page int, line_idx int, kind string, label string, title string, printed_page int, strong boolean"


def contents_line(text: str) -> dict | None:
    """kind, label, title, printed_page and whether dots lead to the number; None where a line is no entry."""
    m = ENTRY.match(text)
    if not m or len(re.findall(r"[^\W\d_]", m["title"])) < 2:
        return None
    strong = "." in m["leader"]
    label = m["label"]
    if not label and not strong and not m["word"]:
        return None
    kind = "chapter" if m["word"] or (label and "." not in label) else "section" if label else "unnumbered"
    return {"kind": kind, "label": label, "title": " ".join(m["title"].split()).rstrip(" ."), "printed_page": int(m["page"]), "strong": strong}


def contents(lines: DataFrame) -> DataFrame:
    """ENTRIES of lines(book_id, page, line_idx, text): those of contents pages, which hold three entries with leaders, or one
    right after such a page; at most three pages after the last."""

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        out, last = [], None
        for page, rows in g.groupby("page", sort=True):
            found = [(r.line_idx, e) for r in rows.itertuples() if (e := contents_line(r.text or ""))]
            strong = sum(e["strong"] for _, e in found)
            follows = last is not None and page - last == 1
            if strong >= (1 if follows else 3) and (last is None or page - last <= 3):
                last = page
                out += [(g["book_id"].iloc[0], page, i, *e.values()) for i, e in found]
        return pd.DataFrame(out, columns=[x.split()[0] for x in ENTRIES.split(", ")], dtype=object) if out else None

    return by_runs(lines.select("book_id", "page", "line_idx", "text"), ["book_id"], ["page", "line_idx"], run, ENTRIES)


def page_index(entries: DataFrame, numbering: DataFrame) -> DataFrame:
    """entries with index: the page that a printed number stands for, by the book's offset; the number itself, from 0, without one."""
    n = numbering.select(F.col("book_id").alias("_b"), F.col("offset").alias("_o"))
    return entries.join(n, F.col("book_id") == F.col("_b"), "left").withColumn("index", F.coalesce(F.col("printed_page") - F.col("_o"), F.col("printed_page") - 1).cast("int")).drop("_b", "_o")


#: Headings by kind, in the order in which they are tried: pattern, least size against the body.
HEADING_KINDS = (
    ("answers", r"^(?i:answers?|solutions?|answer key|lösungen|solutions des exercices|soluciones)\b", 1.25),
    ("chapter", r"^(?i:chapter|kapitel|chapitre|capítulo)\s+(?:\d+|[ivxlc]+)\b", 1.25),
    ("answers-section", r"^(?i:answers?|solutions?|lösungen)\s+(?:to|for|zu)\s+(?:section\s+)?\d+(?:\.\d+)+", 1.0),
    ("stop", r"^(?i:summary|review|references|bibliography|index|glossary|zusammenfassung|literatur)$", 1.0),
    ("practice-labelled", r"^(?i:exercises?|problems?|practice|aufgaben|übungen|exercices|ejercicios)\s+\d+(?:\.\d+)*", 1.1),
    ("practice", r"^(?i:exercises?|problems?|practice|aufgaben|übungen|exercices|ejercicios)$", 1.25),
    ("lesson", r"^\d{1,3}\.\d{1,3}(?:\.\d{1,3})?\s+\p{Lu}", 1.07),
)


def heading_kind(text: Column, ratio: Column, bold: Column) -> Column:
    """(kind, label): the first kind whose words fit and whose size, or weight where size isn't asked for much, does."""
    out = None
    label = F.regexp_extract(text, r"(\d{1,3}(?:\.\d{1,3})*)", 1)
    for kind, pattern, least in HEADING_KINDS:
        fits = text.rlike(pattern) & ((ratio >= least) | (F.coalesce(bold, F.lit(False)) & F.lit(least <= 1.1)))
        hit = F.struct(F.lit(kind).alias("kind"), F.nullif(label, F.lit("")).alias("label"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def scan_headings(lines: DataFrame, body: DataFrame) -> DataFrame:
    """lines that are headings, with kind and label; body(book_id, body) is the size of the running text."""
    b = body.select(F.col("book_id").alias("_b"), F.col("body").alias("_body"))
    d = lines.join(b, F.col("book_id") == F.col("_b")).withColumn("_h", heading_kind(F.trim("text"), F.col("font_size") / F.col("_body"), F.col("bold")))
    return d.filter("_h IS NOT NULL").select(*lines.columns, "_h.kind", "_h.label")


def sections(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(book_id, label, title, page, top, confidence, end_page): labels of the contents and of lesson and practice headings.

    Confidence .35, .3 more for a lesson heading, .15 more where the contents' page agrees and .2 less where it doesn't, .1 for
    a practice heading, .2 less out of order; .2 to .99. A section ends where the next begins.
    """
    c = entries.filter("kind = 'section'").groupBy("book_id", "label").agg(F.min_by("title", F.struct("page", "line_idx")).alias("listed_title"), F.min("index").alias("listed"))
    at = F.struct("page", "top")
    h = headings.filter("kind IN ('lesson', 'practice-labelled') AND label IS NOT NULL").groupBy("book_id", "label").agg(
        F.min_by("page", at).alias("page"), F.min_by("top", at).alias("top"), F.max((F.col("kind") == "lesson").cast("int")).alias("lesson"), F.max((F.col("kind") == "practice-labelled").cast("int")).alias("practice"), F.min_by("text", at).alias("text")
    )
    j = h.join(c, ["book_id", "label"], "full_outer").withColumn("page", F.coalesce("page", "listed")).withColumn("top", F.coalesce("top", F.lit(0.0)))
    order = Window.partitionBy("book_id").orderBy(F.transform(F.split("label", r"\."), lambda x: x.try_cast("int")), "label")
    before = F.max("page").over(order.rowsBetween(Window.unboundedPreceding, -1))
    score = F.lit(0.35) + F.when(F.col("lesson") == 1, 0.3).otherwise(0.0) + F.when(F.col("listed") == F.col("page"), 0.15).when(F.col("listed").isNotNull(), -0.2).otherwise(0.0) + F.when(F.col("practice") == 1, 0.1).otherwise(0.0) - F.when(F.col("page") < before, 0.2).otherwise(0.0)
    d = j.withColumn("confidence", F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.99), score)), 2)).withColumn("title", F.coalesce("listed_title", F.trim(F.regexp_replace("text", r"^[\d.]+\s*", ""))))
    return d.withColumn("end_page", F.lead("page").over(order)).select("book_id", "label", "title", "page", "top", "confidence", "end_page")


def number_bookmarks(outline: DataFrame) -> DataFrame:
    """outline with label: a chapter's number at the chapter level, chapter.section below it, where titles carry no numbers.

    The chapter level of a book is the depth with most entries whose printed labels the count meets, the least of equals.
    """
    w = Window.partitionBy("book_id").orderBy("idx")
    found = None
    printed = F.regexp_extract("title", r"^(\d{1,3}(?:\.\d{1,3})?)\b", 1)
    for level in (0, 1):
        chapter = F.count_if(F.col("depth") == level).over(w.rowsBetween(Window.unboundedPreceding, 0))
        d = outline.withColumn("_c", chapter).withColumn("_s", F.count_if(F.col("depth") == level + 1).over(Window.partitionBy("book_id", "_c").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
        label = F.when(F.col("depth") == level, F.col("_c").cast("string")).when((F.col("depth") == level + 1) & (F.col("_c") > 0), F.concat_ws(".", F.col("_c").cast("string"), F.col("_s").cast("string")))
        d = d.withColumn("label", label).withColumn("level", F.lit(level)).withColumn("_hit", (printed == F.col("label")).cast("int")).drop("_c", "_s")
        found = d if found is None else found.unionByName(d)
    votes = found.groupBy(F.col("book_id").alias("_b"), F.col("level").alias("_l")).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("n"))
    best = votes.groupBy("_b").agg(F.max_by("_l", F.struct("n", -F.col("_l"))).alias("_level"))
    return found.join(best, (F.col("book_id") == F.col("_b")) & (F.col("level") == F.col("_level"))).drop("_b", "_level", "_hit")
