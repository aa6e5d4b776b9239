"""Checks of framed items against the text of their pages. Each emits (book_id, code, severity, ref, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework import constants as C
from quirework.functions import labels
from quirework.functions import lines as L
from quirework.operators import census, geometry, sequences

OUT = ("book_id", "code", "severity", "ref", "page")
#: Codes in their order, with severity.
CODES = {
    "label-not-first": "error", "label-in-word": "warning", "no-text": "warning", "solution-label-missing": "error", "solution-no-text": "info", "overlap": "error", "duplicate-region": "error", "context-overlaps-frame": "warning", "region-size": "warning",
    "section-unknown": "error", "section-page": "error", "gap": "warning", "duplicate": "error", "non-numeric-label": "info", "order": "warning", "no-solution": "warning", "label-outlier": "warning", "span-gap": "error", "numbered-text-left-behind": "error", "answer-left-behind": "error", "text-left-behind": "warning",
    "answer-clipped": "warning", "region-holds-item": "error", "region-open-end": "warning", "continuation-limit": "warning", "inline-section": "info", "continuation-order": "error", "context-range": "error", "context-missing": "error", "context-not-nearest": "warning", "context-inconsistent": "warning", "context-group-end": "warning",
    "furniture-in-region": "warning", "solution-section-mismatch": "error", "solution-order": "warning", "edge-on-ink": "warning", "edge-interlocked": "info", "stray-frame": "warning", "numbered-run-uncovered": "warning",
}


def _out(d: DataFrame, code: Column | str, ref: Column, page: Column) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    severity = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return d.select("book_id", code.alias("code"), severity[code].alias("severity"), ref.cast("string").alias("ref"), page.cast("int").alias("page"))


def ref(section: str = "section", label: str = "label") -> Column:
    return F.concat_ws(":", F.col(section), F.col(label))


def region_texts(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(book_id, page, id, role, n_lines, text) of regions(book_id, page, id, role, rect): their lines in reading order."""
    j = geometry.lines_in_regions(lines.select("book_id", "page", "line_idx", "text", "rect"), regions.select("book_id", "page", "id", "role", "ord", "rect"), ["book_id", "page"])
    g = j.groupBy(F.col("r_book_id").alias("book_id"), F.col("r_page").alias("page"), F.col("r_id").alias("id"), F.col("r_role").alias("role"), F.col("r_ord").alias("ord")).agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct(F.col("l_line_idx").alias("i"), F.col("l_text").alias("t")))).alias("_t"))
    texts = g.withColumn("text", F.array_join("_t.t", "\n")).drop("_t")
    keys = ["book_id", "page", "id", "role", "ord"]
    return regions.select(*keys).join(texts, keys, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0))).withColumn("text", F.coalesce("text", F.lit("")))


def check_text(texts: DataFrame, items: DataFrame) -> DataFrame:
    """An item's first region begins with its label, not within a word; its answers name it; regions hold text."""
    i = items.select("book_id", "id", "section", "label")
    d = texts.join(i, ["book_id", "id"]).withColumn("_first", F.trim(F.element_at(F.split("text", "\n"), 1)))
    has = d["text"].contains(d["label"])
    starts = labels.starts_with(F.col("_first"), F.col("label"))
    in_word = F.col("_first").startswith(F.col("label")) & ~starts
    item = F.when(F.col("n_lines") == 0, "no-text").when(in_word, "label-in-word").when(~starts & F.col("label").rlike(r"\d"), "label-not-first")
    answer = F.when(F.col("n_lines") == 0, "solution-no-text").when(~has, "solution-label-missing")
    code = F.when((F.col("role") == "item") & (F.col("ord") == 0), item).when((F.col("role") == "solution") & (F.col("ord") == 0), answer)
    return _out(d.withColumn("_code", code).filter("_code IS NOT NULL"), F.col("_code"), ref(), F.col("page"))


def check_places(regions: DataFrame) -> DataFrame:
    """overlap, duplicate-region and region-size of items' regions."""
    r = regions.filter("role = 'item'").select("book_id", "page", "id", F.coalesce("unit", "id").alias("unit"), "rect")
    over = geometry.overlapping_regions(r, ["book_id", "page"], "id", "unit", "rect")
    size = geometry.size_faults(regions.filter("role = 'item'").select("book_id", "page", "id", "unit", "ord", "rect"))
    return _out(over, F.col("code"), F.col("a"), F.col("page")).unionByName(_out(size, F.col("code"), F.col("id"), F.col("page")))


def check_sequences(items: DataFrame, sections: DataFrame) -> DataFrame:
    """section-unknown, section-page, gap, duplicate, non-numeric-label, order, no-solution and label-outlier of items(book_id, id, section, label, page, left, top, has_answer)."""
    d = items.withColumn("_n", F.get(labels.numbers(F.col("label")), F.size(labels.numbers(F.col("label"))) - 1)).withColumn("_key", F.concat_ws("\x00", "book_id", "section"))
    s = sections.select("book_id", F.col("label").alias("section"), F.col("page").alias("start_page"), "end_page")
    placed = d.join(s, ["book_id", "section"], "left")
    code = F.when(F.col("start_page").isNull(), "section-unknown").when((F.col("page") < F.col("start_page")) | (F.col("page") > F.col("end_page")), "section-page")
    parts = [_out(placed.withColumn("_c", code).filter("_c IS NOT NULL"), F.col("_c"), ref(), F.col("page"))]
    whole = d.filter(labels.suffix(F.col("label")) == "")
    section = d.select("_key", "book_id", "section").distinct()
    named = lambda g: g.join(section, "_key")
    none = F.lit(None).cast("int")
    parts.append(_out(named(sequences.gaps(whole, "_key", "_n")), "gap", F.concat(F.col("section"), F.lit(":"), F.col("gap_from").cast("string")), none))
    parts.append(_out(named(sequences.duplicates(d, "_key", "label")), "duplicate", ref(), none))
    parts.append(_out(d.filter("_n IS NULL"), "non-numeric-label", ref(), F.col("page")))
    parts.append(_out(named(sequences.outliers(whole.select("_key", "label", "_n", "page"), "_key", "_n")), "label-outlier", ref(), F.col("page")))
    cover = named(sequences.coverage(d, "_key", F.coalesce(F.col("has_answer"), F.lit(False))).filter("severity <> 'none'"))
    parts.append(_out(cover, "no-solution", F.col("section"), none))
    columns = sequences.lag_islands(whole, ["_key", "page"], "left", C.COLUMN_GAP, ["top", "id"])
    column = ["_key", "page", "island"]
    # a number alone in its column is in order
    several = columns.select("_key", "book_id", "section", "label", "page", "island", "top", "id", F.col("_n").cast("double").alias("_n")).filter("_n IS NOT NULL").withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy(*column)) > 1).filter("_several").drop("_several")
    lis = sequences.out_of_order(several, column, ["top", "id"], "_n")
    parts.append(_out(lis.filter("NOT in_order"), "order", ref(), F.col("page")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_coverage(lines: DataFrame, regions: DataFrame, zones: DataFrame) -> DataFrame:
    """Lines of a zone(book_id, section, page, top, bottom) that no region covers by half, in blocks: numbered-text-left-behind where one starts an item, else text-left-behind."""
    flat = lines.select("book_id", "page", "line_idx", "text", "rect", F.col("rect")["top"].alias("lo"), F.col("rect")["bottom"].alias("hi"), "header_footer")
    plain = flat.filter(~F.coalesce("header_footer", F.lit(False))).withColumn("_kind", L.line_class(F.col("text"))).filter("_kind NOT IN ('furniture', 'heading', 'symbol', 'caption')")
    z = zones.select("book_id", "section", "page", F.col("top").alias("lo"), F.col("bottom").alias("hi"))
    in_zone = geometry.overlaps(plain, z, ["book_id", "page"], "lo", "hi", 0.125).filter((F.col("a_lo") + F.col("a_hi")) / 2 >= F.col("b_lo")).filter((F.col("a_lo") + F.col("a_hi")) / 2 <= F.col("b_hi"))
    here = in_zone.select(*[F.col(f"a_{c}").alias(c) for c in plain.columns], F.col("b_section").alias("section")).dropDuplicates(["book_id", "page", "line_idx"])
    share = geometry.covered_share(here.select("book_id", "page", "line_idx", "rect"), regions.select("book_id", "page", "rect"), ["book_id", "page"], "line_idx").withColumnRenamed("id", "line_idx")
    left = here.join(share, ["book_id", "page", "line_idx"]).filter("share < 0.5")
    w = Window.partitionBy("book_id", "section", "page").orderBy("lo", "line_idx")
    new = F.coalesce((F.col("lo") - F.lag("hi").over(w) > C.BLOCK_GAP * (F.col("hi") - F.col("lo"))).cast("int"), F.lit(1))
    numbered = F.when(labels.item_start(F.trim("text")).isNotNull(), 1).otherwise(0)
    b = left.withColumn("_new", F.greatest(new, numbered)).withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_num", numbered)
    g = b.groupBy("book_id", "section", "page", "_b").agg(F.max("_num").alias("_num"), F.min_by("text", "lo").alias("text"))
    return _out(g, F.when(F.col("_num") == 1, "numbered-text-left-behind").otherwise("text-left-behind"), F.concat_ws(":", "section", L.excerpt(F.col("text"), 24)), F.col("page"))


def check_inside(texts: DataFrame, items: DataFrame) -> DataFrame:
    """region-holds-item: a region whose later line starts another item of the section; furniture-in-region: a printed head within."""
    i = items.select("book_id", "id", "section", "label")
    d = texts.filter("role = 'item'").join(i, ["book_id", "id"]).select("book_id", "id", "section", "label", "page", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    others = i.select("book_id", "section", F.col("label").alias("_other"))
    start = labels.item_start(F.trim("line"))
    later = d.filter("at > 0").withColumn("_other", start).filter(F.col("_other").isNotNull() & (F.col("_other") != F.col("label")))
    held = later.join(others, ["book_id", "section", "_other"], "left_semi")
    heads = d.filter(L.is_printed_head(F.trim("line")))
    return _out(held, "region-holds-item", ref(), F.col("page")).unionByName(_out(heads, "furniture-in-region", ref(), F.col("page"))).distinct()


def check_context(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """context-range: an instruction names numbers without the item's; context-missing: one of its section names the item and isn't attached.

    contexts(book_id, section, item_id, text, attached): instructions and, where attached, whose.
    """
    n = F.get(labels.numbers(F.col("label")), F.size(labels.numbers(F.col("label"))) - 1)
    i = items.select("book_id", "section", F.col("id").alias("item_id"), "label", "page").withColumn("_n", n)
    named = labels.named_numbers(F.col("text"))
    wrong = contexts.filter("attached").join(i, ["book_id", "section", "item_id"]).withColumn("_named", named).filter((F.size("_named") > 0) & ~F.array_contains("_named", F.col("_n")))
    free = contexts.select("book_id", "section", "text").distinct().withColumn("_n", F.explode(named)).join(i, ["book_id", "section", "_n"])
    have = contexts.filter("attached").select("book_id", "section", "item_id", "text")
    missing = free.join(have, ["book_id", "section", "item_id", "text"], "left_anti")
    return _out(wrong, "context-range", ref(), F.col("page")).unionByName(_out(missing, "context-missing", ref(), F.col("page")))


def check_neighbour_contexts(items: DataFrame) -> DataFrame:
    """context-inconsistent: both neighbours of a section share a context that an item lacks; context-group-end where only the one before has it.

    items(book_id, section, id, label, page, top, context_key)."""
    w = Window.partitionBy("book_id", "section").orderBy("page", "top", "id")
    d = items.withColumn("_a", F.lag("context_key").over(w)).withColumn("_b", F.lead("context_key").over(w))
    both = F.col("_a").isNotNull() & F.col("_a").eqNullSafe(F.col("_b")) & ~F.col("context_key").eqNullSafe(F.col("_a"))
    end = F.col("context_key").isNull() & F.col("_a").isNotNull() & F.col("_b").isNull()
    code = F.when(both, "context-inconsistent").when(end, "context-group-end")
    return _out(d.withColumn("_c", code).filter("_c IS NOT NULL"), F.col("_c"), ref(), F.col("page"))


def check_continuations(regions: DataFrame) -> DataFrame:
    r = regions.filter("role = 'item'")
    return _out(geometry.region_order(r, ["book_id", "id"], "ord"), "continuation-order", F.col("id"), F.col("page"))


def check_key(answers: DataFrame, markers: DataFrame) -> DataFrame:
    """solution-section-mismatch: the last section marker above an answer is another section's; solution-order: answers of a section that don't rise.

    answers(book_id, section, label, page, top); markers(book_id, page, top, section)."""
    from quirework.operators.trees import locate

    m = markers.select("book_id", "page", "top", F.col("section").alias("mark"))
    d = locate(answers, m, ["book_id"], ["page", "top"], "mark")
    other = d.filter(F.col("located").isNotNull() & (F.col("located") != F.col("section")))
    n = F.get(labels.numbers(F.col("label")), F.size(labels.numbers(F.col("label"))) - 1).cast("double")
    lis = sequences.out_of_order(answers.withColumn("_n", n).filter("_n IS NOT NULL"), ["book_id", "section"], ["page", "top"], "_n")
    return _out(other, "solution-section-mismatch", ref(), F.col("page")).unionByName(_out(lis.filter("NOT in_order"), "solution-order", ref(), F.col("page")))


def check_runs(labels_found: DataFrame) -> DataFrame:
    """numbered-run-uncovered of labels(book_id, family, n, page, ord, left, covered)."""
    u = census.uncovered(census.census(labels_found))
    return _out(u, "numbered-run-uncovered", F.format_string("%d-%d", "first_n", "last_n"), F.col("first_page"))


def check_strays(frames: DataFrame) -> DataFrame:
    """stray-frame: items without authority in a book that has items with it."""
    books = frames.filter("authority IS NOT NULL").select("book_id").distinct()
    stray = frames.filter("authority IS NULL AND kind = 'exercise'").join(books, "book_id", "left_semi")
    return _out(stray, "stray-frame", F.col("id"), F.col("page"))


def pages_to_read(regions: DataFrame, reach: int = 2) -> DataFrame:
    """(book_id, page): the pages that a check of the regions needs, and their neighbours."""
    return regions.select("book_id", F.explode(F.sequence(F.greatest(F.col("page") - reach, F.lit(0)), F.col("page") + reach)).alias("page")).distinct()


def check_spans(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """span-gap: text between two regions of one item on a page, covered by none of its regions."""
    own = regions.filter("role = 'item'").select("book_id", "page", "id", F.col("rect.top").alias("top"), F.col("rect.bottom").alias("bottom"), F.col("rect.left").alias("left"), F.col("rect.right").alias("right"))
    w = Window.partitionBy("book_id", "id", "page").orderBy("top")
    gaps_ = own.withColumn("_end", F.lag("bottom").over(w)).filter(F.col("_end") < F.col("top")).select("book_id", "page", "id", F.col("_end").alias("lo"), F.col("top").alias("hi"), "left", "right")
    l = lines.filter(~F.coalesce("header_footer", F.lit(False))).select("book_id", "page", "line_idx", "rect", F.col("rect.top").alias("lo"), F.col("rect.bottom").alias("hi"))  # noqa: E741
    j = geometry.overlaps(l, gaps_, ["book_id", "page"], "lo", "hi", 0.125)
    middle, centre = (F.col("a_lo") + F.col("a_hi")) / 2, (F.col("a_rect.left") + F.col("a_rect.right")) / 2
    hit = j.filter((middle > F.col("b_lo")) & (middle < F.col("b_hi")) & (centre >= F.col("b_left")) & (centre <= F.col("b_right")))
    return _out(hit.select(F.col("a_book_id").alias("book_id"), F.col("b_id").alias("id"), F.col("a_page").alias("page")).distinct(), "span-gap", F.col("id"), F.col("page"))


def check_open_ends(lines: DataFrame, regions: DataFrame, pitch: float = 1.2, reach: float = 0.8) -> DataFrame:
    """region-open-end: a line goes on right under a region, within 1.2 of its height, whose last line reaches as far as the region does."""
    inside = geometry.lines_in_regions(lines.select("book_id", "page", "line_idx", "text", "rect"), regions.filter("role = 'item'").select("book_id", "page", "id", "rect"), ["book_id", "page"])
    w = Window.partitionBy("r_book_id", "r_page", "r_id").orderBy(F.col("l_rect.bottom").desc())
    last = inside.withColumn("_r", F.row_number().over(w)).filter("_r = 1").filter(F.col("l_rect.right") - F.col("l_rect.left") >= reach * (F.col("r_rect.right") - F.col("r_rect.left")))
    covered = inside.select(F.col("l_book_id").alias("book_id"), F.col("l_page").alias("page"), F.col("l_line_idx").alias("line_idx")).distinct()
    free = lines.filter(~F.coalesce("header_footer", F.lit(False))).join(covered, ["book_id", "page", "line_idx"], "left_anti").filter(labels.item_start(F.trim("text")).isNull() & ~L.line_class(F.col("text")).isin("heading", "furniture"))
    f = free.select("book_id", "page", "rect", F.col("rect.top").alias("lo"), F.col("rect.bottom").alias("hi"))
    under = last.select(F.col("r_book_id").alias("book_id"), F.col("r_page").alias("page"), F.col("r_id").alias("id"), F.col("l_rect").alias("rect"), F.col("l_rect.bottom").alias("lo"), (F.col("l_rect.bottom") + pitch * (F.col("l_rect.bottom") - F.col("l_rect.top"))).alias("hi"))
    j = geometry.overlaps(f, under, ["book_id", "page"], "lo", "hi", 0.125).filter((F.col("a_lo") >= F.col("b_lo") - 1e-9) & (F.abs(F.col("a_rect.left") - F.col("b_rect.left")) < 0.08))
    return _out(j.select(F.col("a_book_id").alias("book_id"), F.col("b_id").alias("id"), F.col("a_page").alias("page")).distinct(), "region-open-end", F.col("id"), F.col("page"))


def check_limits(regions: DataFrame, most: int = C.MAX_REGIONS) -> DataFrame:
    """continuation-limit: items that use every region they may."""
    g = regions.filter("role = 'item'").groupBy("book_id", "id").agg(F.count(F.lit(1)).alias("_n"), F.max("page").alias("page")).filter(F.col("_n") > most)
    return _out(g, "continuation-limit", F.col("id"), F.col("page"))


def check_answers(lines: DataFrame, regions: DataFrame, bands: DataFrame) -> DataFrame:
    """answer-left-behind: numbered lines of an answer band that no answer holds; answer-clipped: an edge of an answer through a line.

    bands(book_id, page, section, top, bottom)."""
    answers = regions.filter("role = 'solution'")
    left = check_coverage(lines, answers, bands.select("book_id", "section", "page", "top", "bottom")).filter("code = 'numbered-text-left-behind'")
    clipped = geometry.cut_lines(lines.select("book_id", "page", "line_idx", "rect"), answers.select("book_id", "page", "id", "rect"), ["book_id", "page"])
    cut = clipped.select(F.col("b_book_id").alias("book_id"), F.col("b_id").alias("id"), F.col("b_page").alias("page")).distinct()
    return _out(left, "answer-left-behind", F.col("ref"), F.col("page")).unionByName(_out(cut, "answer-clipped", F.col("id"), F.col("page")))


def check_inline(lines: DataFrame, regions: DataFrame, zones: DataFrame, items: int = 3, percent: int = 60) -> DataFrame:
    """inline-section: a section of fewer than three items, or of whose lines less than three fifths are covered."""
    inside = geometry.lines_in_regions(lines.select("book_id", "page", "line_idx", "rect"), regions.filter("role = 'item'").select("book_id", "page", "id", "rect"), ["book_id", "page"]).select(F.col("l_book_id").alias("book_id"), F.col("l_page").alias("page"), F.col("l_line_idx").alias("line_idx"), F.col("r_id").alias("id")).dropDuplicates(["book_id", "page", "line_idx"])
    z = zones.select("book_id", "page", "section", F.col("top").alias("lo"), F.col("bottom").alias("hi"))
    l = lines.select("book_id", "page", "line_idx", F.col("rect.top").alias("lo"), F.col("rect.bottom").alias("hi"))  # noqa: E741
    j = geometry.overlaps(l, z, ["book_id", "page"], "lo", "hi", 0.125).select(F.col("a_book_id").alias("book_id"), F.col("a_page").alias("page"), F.col("a_line_idx").alias("line_idx"), F.col("b_section").alias("section")).distinct().join(inside, ["book_id", "page", "line_idx"], "left")
    g = j.groupBy("book_id", "section").agg(F.count(F.lit(1)).alias("_n"), F.count("id").alias("_c"), F.count_distinct("id").alias("_items"), F.min("page").alias("page"))
    return _out(g.filter((F.col("_items") < items) | (F.col("_c") * 100 < F.col("_n") * percent)), "inline-section", F.col("section"), F.col("page"))


def check_nearest_context(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """context-not-nearest: between an item's context and the item another instruction of its section stands that isn't attached to it.

    contexts(book_id, section, item_id, page, top, attached); items(book_id, section, id, label, page, top)."""
    at = lambda p, t: F.col(p) * 10.0 + F.col(t)
    i = items.select("book_id", "section", F.col("id").alias("item_id"), "label", F.col("page").alias("item_page"), at("page", "top").alias("_item"))
    own = contexts.filter("attached").withColumn("_own", at("page", "top")).groupBy("book_id", "section", "item_id").agg(F.max("_own").alias("_own")).join(i, ["book_id", "section", "item_id"])
    others = contexts.select("book_id", "section", F.struct(at("page", "top").alias("at"), F.col("item_id").alias("whose")).alias("o")).groupBy("book_id", "section").agg(F.collect_set("o").alias("_all"))
    j = own.join(others, ["book_id", "section"])
    between = F.exists("_all", lambda o: (o["at"] > F.col("_own")) & (o["at"] < F.col("_item")))
    return _out(j.filter(between), "context-not-nearest", ref(), F.col("item_page"))


def check_edges(regions: DataFrame, pictures: DataFrame) -> DataFrame:
    """edge-on-ink: an edge of a region cuts dark pixels; edge-interlocked: it does and there is no clean place near.

    pictures(book_id, page, bits, width, height): a page's picture meets the regions of that page in one task."""
    import pandas as pd

    from quirework.functions import ink
    from quirework.functions.grouped import by_runs

    j = regions.select("book_id", "page", "id", "rect.left", "rect.top", "rect.right", "rect.bottom").join(pictures.select("book_id", "page", "bits", "width", "height"), ["book_id", "page"])

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        dark = ink.unpacked(bytes(g["bits"].iloc[0]), int(g["width"].iloc[0]), int(g["height"].iloc[0]))
        out = []
        for r in g.itertuples():
            rect = (r.left, r.top, r.right, r.bottom)
            for side in ("left", "top", "right", "bottom"):
                if ink.is_cut(ink.edge(dark, rect, side)):
                    clean = ink.clean_edge(dark, rect, side)
                    out.append((r.book_id, r.page, r.id, side, "edge-on-ink" if clean is not None else "edge-interlocked", clean))
        return pd.DataFrame(out, columns=["book_id", "page", "id", "side", "code", "suggested"], dtype=object) if out else None

    found = by_runs(j, ["book_id", "page"], ["id"], run, "book_id string, page int, id string, side string, code string, suggested double")
    return _out(found, F.col("code"), F.concat_ws(":", "id", "side"), F.col("page"))


def _with_place(rows: DataFrame) -> DataFrame:
    from quirework.operators.gate import ordered

    return ordered(rows.withColumn("message", F.lit("")), list(CODES)).drop("message")


def verify(
    items: DataFrame,
    regions: DataFrame,
    sections: DataFrame,
    lines: DataFrame | None = None,
    zones: DataFrame | None = None,
    bands: DataFrame | None = None,
    contexts: DataFrame | None = None,
    markers: DataFrame | None = None,
    answers: DataFrame | None = None,
    runs: DataFrame | None = None,
    pictures: DataFrame | None = None,
    codes: tuple[str, ...] = tuple(CODES),
) -> DataFrame:
    """All findings on the books of items, (book_id, code, severity, ref, page, place): every check whose tables are there, in order.

    items(book_id, id, section, label, page, left, top, has_answer, authority, kind[, context_key]); regions(book_id, page, id, unit,
    role, ord, rect); sections(book_id, label, page, end_page); lines(book_id, page, line_idx, text, rect, header_footer); the others
    as their checks take them. Each check is a plan of its own over the same tables; findings are joined by union, each once, and
    sorted within a book by severity, code, page and ref.
    """
    parts = [check_places(regions), check_sequences(items, sections), check_continuations(regions), check_limits(regions), check_strays(items)]
    if "context_key" in items.columns:
        parts.append(check_neighbour_contexts(items))
    if lines is not None:
        texts = region_texts(lines, regions)
        parts += [check_text(texts, items), check_inside(texts, items), check_spans(lines, regions), check_open_ends(lines, regions)]
        if zones is not None:
            parts += [check_coverage(lines, regions, zones), check_inline(lines, regions, zones)]
        if bands is not None:
            parts.append(check_answers(lines, regions, bands))
    if contexts is not None:
        parts.append(check_context(contexts, items))
        if {"page", "top"} <= set(contexts.columns):
            parts.append(check_nearest_context(contexts, items))
    if markers is not None and answers is not None:
        parts.append(check_key(answers, markers))
    if runs is not None:
        parts.append(check_runs(runs))
    if pictures is not None:
        parts.append(check_edges(regions, pictures))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _with_place(out.filter(F.col("code").isin(*codes)).distinct())
