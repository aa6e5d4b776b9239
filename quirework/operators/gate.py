"""Findings, acknowledgements and the gate that judges a book."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.grouped import by_runs

SEVERITIES = ("error", "warning", "info")
FINDING = ("book_id", "source", "code", "severity", "ref", "page", "message")


def findings(source: DataFrame, book: Column, code: Column, severity: Column, ref: Column, page: Column, message: Column, origin: str) -> DataFrame:
    """Rows of any check in the one shape that all findings have."""
    return source.select(book.cast("string").alias("book_id"), F.lit(origin).alias("source"), code.alias("code"), severity.alias("severity"), ref.cast("string").alias("ref"), page.cast("int").alias("page"), message.alias("message"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def ordered(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Findings with place: by severity, the rank of their code, page, ref and message within a book."""
    rank = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("code"))
    w = Window.partitionBy("book_id").orderBy(severity_rank(F.col("severity")), rank, F.col("page").asc_nulls_last(), F.col("ref").asc_nulls_last(), "message")
    return rows.withColumn("place", F.row_number().over(w))


def summary(rows: DataFrame) -> DataFrame:
    """(book_id, errors, warnings, infos)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s + "s")
    return rows.groupBy("book_id").agg(*[n(s) for s in SEVERITIES])


def note_matches(note: dict, finding: dict) -> bool:
    """By code, and by ref or the section it begins with, and by page, as far as a note names them."""
    ref = note.get("ref")
    if note["code"] != finding["code"]:
        return False
    if ref is not None and finding["ref"] != ref and not str(finding["ref"] or "").startswith(str(ref) + ":"):
        return False
    return note.get("page") is None or note["page"] == finding["page"]


def judge_book(found: list[dict], notes: list[dict]) -> tuple[list[int | None], list[str]]:
    """For each finding the note that takes it, and each note's state: used, unused, refused or stale.

    Notes are judged in their order; a finding is taken once. A note whose count differs from what is left for it is stale and
    takes nothing; one without reason is refused.
    """
    taken: list[int | None] = [None] * len(found)
    states = []
    for i, note in enumerate(notes):
        if not (note.get("reason") or "").strip():
            states.append("refused")
            continue
        hits = [k for k, f in enumerate(found) if taken[k] is None and note_matches(note, f)]
        count = note.get("count")
        if count is not None and count == count and int(count) != len(hits):
            states.append("stale")
            continue
        for k in hits:
            taken[k] = i
        states.append("used" if hits else "unused")
    return taken, states


def judge(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """findings and notes of a book, in order, with state: open, acknowledged or unconfirmed for a finding; used, unused, refused or stale for a note.

    A book is a group: what a note takes depends on the notes before it. Findings of a code that no note of the book names are
    open and stay out of the group.
    """
    kinds = "book_id string, kind string, ord long, code string, ref string, page int, severity string, reason string, count int, confirmed boolean"
    f = rows.withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy("code", F.col("page").asc_nulls_last(), F.col("ref").asc_nulls_last(), "message")).cast("long"))
    f = f.select("book_id", F.lit("finding").alias("kind"), "ord", "code", "ref", "page", "severity", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("count"), F.lit(None).cast("boolean").alias("confirmed"))
    n = notes.select("book_id", F.lit("note").alias("kind"), F.col("note_idx").cast("long").alias("ord"), "code", "ref", F.col("page").cast("int").alias("page"), F.lit(None).cast("string").alias("severity"), "reason", F.col("count").cast("int").alias("count"), "confirmed")
    named = n.select("book_id", "code").distinct()
    asked, rest = f.join(named, ["book_id", "code"], "left_semi"), f.join(named, ["book_id", "code"], "left_anti")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.astype(object).where(g.notna(), None)
        fs, ns = g[g["kind"] == "finding"], g[g["kind"] == "note"]
        notes_ = ns.to_dict("records")
        taken, states = judge_book(fs.to_dict("records"), notes_)
        state = ["open" if t is None else "acknowledged" if notes_[t]["confirmed"] else "unconfirmed" for t in taken]
        return pd.concat([fs.assign(state=state), ns.assign(state=states)])

    return by_runs(asked.unionByName(n), ["book_id"], ["kind", "ord"], run, kinds + ", state string").unionByName(rest.withColumn("state", F.lit("open")))


def gate(judged: DataFrame, proofs: DataFrame) -> DataFrame:
    """(book_id, open, unconfirmed, acknowledged, perfect): proofs(book_id, visual, survey, ink) tells which reviews are complete."""
    n = lambda s: F.count_if((F.col("kind") == "finding") & (F.col("state") == s)).alias(s)
    g = judged.groupBy("book_id").agg(n("open"), n("unconfirmed"), n("acknowledged"))
    j = proofs.join(g, "book_id", "left").na.fill(0, ["open", "unconfirmed", "acknowledged"])
    done = F.coalesce(F.col("visual") & F.col("survey") & F.col("ink"), F.lit(False))
    return j.select("book_id", "open", "unconfirmed", "acknowledged", ((F.col("open") == 0) & (F.col("unconfirmed") == 0) & done).alias("perfect"))


def acknowledgement_issues(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, note_idx, issue): no reason, evidence whose quote isn't on its page, confirmation by nobody else."""
    text = pages.select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), F.lower(F.regexp_replace("text", r"\s+", " ")).alias("_t"))
    j = notes.join(text, (F.col("book_id") == F.col("_b")) & (F.col("evidence.page") == F.col("_p")), "left")
    quote = F.lower(F.regexp_replace(F.trim("evidence.quote"), r"\s+", " "))
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no-reason"),
            F.when(F.col("evidence.quote").isNotNull() & ~F.coalesce(F.col("_t").contains(quote), F.lit(False)), "quote-not-on-page"),
            F.when(F.coalesce(F.col("confirmed"), F.lit(False)) & (F.col("confirmed_by").isNull() | F.col("confirmed_by").eqNullSafe(F.col("by"))), "same-identity"),
        )
    )
    return j.select("book_id", "note_idx", F.explode(found).alias("issue"))


def canonical_hash(rows: DataFrame, key: Sequence[str], ident: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, n, sha256): digest of a key's rows as JSON of sorted fields, rows in order of their ids."""
    row = F.to_json(F.struct(*sorted(fields)))
    g = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*ident, row.alias("_j")))).alias("_l"))
    return g.select(*key, F.size("_l").cast("long").alias("n"), F.sha2(F.concat(F.lit("["), F.array_join("_l._j", ","), F.lit("]")), 256).alias("sha256"))


def delivery(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(book_id, status): what a delivery claims against what a second run finds.

    claims(book_id, started, claimed_perfect, claimed_items, claimed_hash); facts(book_id, readable, items, open, unconfirmed, hash).
    """
    j = claims.join(facts, "book_id", "left")
    status = (
        F.when(~F.coalesce(F.col("started"), F.lit(False)), "NOT STARTED")
        .when(~F.coalesce(F.col("readable"), F.lit(False)), "UNREADABLE")
        .when(F.col("items") == 0, "ZERO EXERCISES")
        .when((F.col("claimed_items") != F.col("items")) | ~F.col("claimed_hash").eqNullSafe(F.col("hash")) | (F.col("claimed_perfect") & (F.col("open") > 0)), "MISMATCH")
        .when(F.col("open") > 0, "NOT FINISHED")
        .when(F.col("unconfirmed") > 0, "AWAITING CONFIRMATION")
        .otherwise("PERFECT")
    )
    return j.select("book_id", status.alias("status"))


def survey(ranges: DataFrame, frames: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, page, code) of pages 0 .. page_count - 1: named by no range, by several, or in another way than what stands on them.

    ranges(book_id, from, to, kind): kinds exercises and both have items, answers and both have answers, the others neither;
    frames(book_id, page, role) of item or answer.
    """
    ends = ranges.join(books.select(F.col("book_id").alias("_b"), "page_count"), F.col("book_id") == F.col("_b"))
    bad = (F.col("from") > F.col("to")) | (F.col("from") < 0) | (F.col("to") >= F.col("page_count"))
    faulty = ends.filter(bad).select("book_id", F.col("from").alias("page"), F.lit("survey-range").alias("code"))
    named = ends.filter(~bad).select("book_id", "kind", F.explode(F.sequence("from", "to")).alias("page")).groupBy("book_id", "page").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind").isin("exercises", "both")).alias("wants_items"), F.max(F.col("kind").isin("answers", "both")).alias("wants_answers"))
    there = frames.groupBy("book_id", "page").agg(F.max(F.col("role") == "item").alias("items"), F.max(F.col("role") == "answer").alias("answers"))
    all_pages = books.select("book_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"))
    j = all_pages.join(named, ["book_id", "page"], "left").join(there, ["book_id", "page"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    codes = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "survey-missing"),
            F.when(F.col("n") > 1, "survey-overlap"),
            F.when((F.col("n") == 1) & ((has("wants_items") & ~has("items")) | (has("wants_answers") & ~has("answers"))), "survey-uncovered"),
            F.when((F.col("n") == 1) & ((~has("wants_items") & has("items")) | (~has("wants_answers") & has("answers"))), "survey-unmarked"),
        )
    )
    return j.select("book_id", "page", F.explode(codes).alias("code")).unionByName(faulty)


def visual(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(book_id, ref, code) of a visual record against the items(book_id, ref, text, has_context, answer_text, label).

    One entry per item, all fields told, the first three words printed in the region, the instruction flag true, the answer
    beginning with what is told.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    w = Window.partitionBy("book_id", "ref")
    e = entries.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_f", F.row_number().over(w.orderBy("entry_idx")))
    j = e.filter("_f = 1").join(items, ["book_id", "ref"], "full_outer")
    words = F.array_join(F.slice(F.split(fold(F.col("starts_with")), " "), 1, 3), " ")
    codes = F.array_compact(
        F.array(
            F.when(F.col("entry_idx").isNull(), "visual-missing"),
            F.when(F.col("text").isNull() & F.col("entry_idx").isNotNull(), "visual-unknown"),
            F.when(F.col("_n") > 1, "visual-repeated"),
            F.when(F.col("entry_idx").isNotNull() & (F.col("starts_with").isNull() | F.col("ok").isNull() | F.col("instruction").isNull()), "visual-incomplete"),
            F.when(F.col("starts_with").isNotNull() & ~fold(F.col("text")).contains(words), "visual-words"),
            F.when(F.col("instruction") != F.col("has_context"), "visual-instruction"),
            F.when(F.col("answer_starts_with").isNotNull() & ~F.coalesce(fold(F.col("answer_text")).startswith(fold(F.col("answer_starts_with"))), F.lit(False)), "visual-answer"),
            F.when(F.col("ok") == F.lit(False), "visual-defect"),
        )
    )
    return j.select("book_id", "ref", F.explode(codes).alias("code"))


def stride(n: int, count: int) -> list[int]:
    """count of n places at an even stride, the first and the last among them; all where there are no more."""
    return list(range(n)) if n <= count else sorted({k * n // count for k in range(count - 1)} | {n - 1}) if count > 1 else [n - 1][:count]


class Picks:
    """Items chosen up to a cap, with the reasons that add up for each."""

    def __init__(self, most: int):
        self.most, self.reasons = most, {}

    def take(self, item: dict | None, why: str) -> None:
        if item is None:
            return
        if item["id"] in self.reasons:
            self.reasons[item["id"]].append(why)
        elif len(self.reasons) < self.most:
            self.reasons[item["id"]] = [why]

    def rest(self, items: list[dict]) -> list[dict]:
        left = [x for x in items if x["id"] not in self.reasons]
        return [left[k] for k in stride(len(left), self.most - len(self.reasons))] if left and len(self.reasons) < self.most else []


def review_picks(ends: dict[str, list[tuple[object, int, int]]], total: int, most: int = 40) -> list[tuple[int, list[str]]]:
    """(place, reasons) of at most `most` of `total` items in reading order, places from 0: every layout kind's first, each
    chapter's and each section's first and last (an even stride of sections where there is no room for all), then an even stride
    over the rest. ends: by layout, chapter and section, each value with its first and last place, in order of the first."""
    picks = Picks(most)
    for name, a, _ in ends["layout"]:
        picks.take({"id": a}, f"layout {name}: first")
    for key in ("chapter", "section"):
        found = ends[key]
        if key == "section" and found:
            found = [found[k] for k in stride(len(found), max(0, most - len(picks.reasons)) // 2)]
        for name, a, b in found:
            picks.take({"id": a}, f"{key} {name}: first")
            if b != a:
                picks.take({"id": b}, f"{key} {name}: last")
    taken, room = sorted(picks.reasons), most - len(picks.reasons)
    for place in stride(total - len(taken), room) if room > 0 else []:
        for t in taken:
            place += t <= place
        picks.take({"id": place}, "stride")
    return list(picks.reasons.items())


def review_sample(items: list[dict], most: int = 40) -> list[tuple[str, list[str]]]:
    """review_picks() of items(id, layout, chapter, section) in reading order, by id."""
    ends: dict[str, list] = {}
    for key in ("layout", "chapter", "section"):
        seen: dict = {}
        for i, x in enumerate(items):
            if x[key] is not None:
                seen.setdefault(x[key], [i, i])[1] = i
        ends[key] = [(name, a, b) for name, (a, b) in seen.items()]
    return [(items[i]["id"], why) for i, why in review_picks(ends, len(items), most)]


def answer_sample(items: list[dict], sampled: list[tuple[str, list[str]]], most: int = 20) -> list[tuple[str, list[str]]]:
    """(id, reasons) of the answers to review among items(id, layout, chapter, answer_lines, answer_at), answer_at null without an answer.

    The answers of the sample's layout kinds; the one of most lines, if it has two; one without text; each chapter's first
    in the key; those of the other sampled items; then an even stride over the rest.
    """
    answered = [x for x in items if x["answer_at"] is not None]
    by_id, why, picks = {x["id"]: x for x in answered}, dict(sampled), Picks(most)
    for i, reasons in sampled:
        if reasons[0].startswith("layout"):
            picks.take(by_id.get(i), "of a layout kind")
    longest = max(answered, key=lambda x: x["answer_lines"], default=None)
    if longest and longest["answer_lines"] >= 2:
        picks.take(longest, "most lines")
    picks.take(next((x for x in answered if x["answer_lines"] == 0), None), "a picture alone")
    for name in dict.fromkeys(x["chapter"] for x in answered):
        picks.take(min((x for x in answered if x["chapter"] == name), key=lambda x: x["answer_at"]), "first of a chapter's key")
    for i in why:
        if i in by_id:
            picks.take(by_id[i], "of a sampled item")
    for x in picks.rest(answered):
        picks.take(x, "stride")
    return list(picks.reasons.items())


def stratified_sample(items: DataFrame, order: Sequence[str], most: int = 40) -> DataFrame:
    """(book_id, id, place, first_reason, reasons) of each book's review sample.

    Only the ends of layouts, chapters and sections reach the group, by their places, which are counted by ranges of the order:
    the group's size follows the sections of a book, not its items, and no task meets a book as a whole.
    """
    from quirework.operators.sequences import ranked

    d = ranked(items, ["book_id"], order, "_n").withColumn("_n", F.col("_n") - 1)
    parts = [d.groupBy("book_id").agg(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("value"), F.count(F.lit(1)).alias("a"), F.lit(0).cast("long").alias("b"))]
    for key in ("layout", "chapter", "section"):
        parts.append(d.filter(F.col(key).isNotNull()).groupBy("book_id", F.lit(key).alias("kind"), F.col(key).cast("string").alias("value")).agg(F.min("_n").alias("a"), F.max("_n").alias("b")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [r for r in zip(g["kind"], g["value"], g["a"].tolist(), g["b"].tolist(), strict=True)]
        ends = {key: [r[1:] for r in rows if r[0] == key] for key in ("layout", "chapter", "section")}
        found = review_picks(ends, next(r[2] for r in rows if r[0] == "total"), most)
        return pd.DataFrame([(g["book_id"].iloc[0], n, k + 1, why[0], "; ".join(why)) for k, (n, why) in enumerate(found)], columns=["book_id", "_n", "place", "first_reason", "reasons"], dtype=object)

    book = items.schema["book_id"]
    schema = T.StructType([book, T.StructField("_n", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("first_reason", T.StringType()), T.StructField("reasons", T.StringType())])
    picked = by_runs(union(parts), ["book_id"], ["a", "kind"], run, schema)
    return d.select("book_id", "_n", "id").join(picked, ["book_id", "_n"]).select("book_id", "id", "place", "first_reason", "reasons")
