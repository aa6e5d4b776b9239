"""Census of numbered runs: chains of rising labels, stitched over pages, judged and compared with what is framed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework import constants as C
from quirework.functions.grouped import by_runs

RUNS = "book_id string, family string, run_id int, first_n int, last_n int, n_items int, step int, missing int, first_page int, last_page int, coverage double"


def fragments(items: list[dict], back: int = C.PAGES_BACK, column: float = C.COLUMN_TOLERANCE) -> list[list[dict]]:
    """Chains of one family in reading order: an item goes on with the open chain that it fits by step 1 or 2 (then that step
    for good), the nearest in pages, then in column, then in place; chains are open for `back` pages."""
    chains: list[dict] = []
    done: list[dict] = []
    for x in items:
        best, fit = None, None
        done += [c for c in chains if x["page"] - c["items"][-1]["page"] > back]
        chains = [c for c in chains if x["page"] - c["items"][-1]["page"] <= back]
        for c in chains:
            last = c["items"][-1]
            d = x["n"] - last["n"]
            if d not in (1, 2) or (c["step"] and d != c["step"]):
                continue
            rank = (x["page"] - last["page"], abs(x["left"] - last["left"]) > column, x["pos"] - last["pos"])
            if best is None or rank < best:
                best, fit = rank, (c, d)
        if fit:
            fit[0]["items"].append(x)
            fit[0]["step"] = fit[1]
        else:
            chains.append({"items": [x], "step": 0})
    return [c["items"] for c in done + chains]


def stitched(parts: list[list[dict]], back: int = C.PAGES_BACK) -> list[list[dict]]:
    """Fragments that go on with one another, by at most two steps and pages, joined; each is used once, the nearest first."""
    parts = sorted(parts, key=lambda p: p[0]["pos"])
    follows: dict[int, int] = {}
    used: set[int] = set()
    for i, a in enumerate(parts):
        step = a[1]["n"] - a[0]["n"] if len(a) > 1 else 1
        options = []
        for j, b in enumerate(parts):
            if j == i or j in used or not a[0]["page"] <= b[0]["page"] <= a[-1]["page"] + back or b[0]["pos"] <= a[0]["pos"]:
                continue
            other = b[1]["n"] - b[0]["n"] if len(b) > 1 else step
            if b[0]["n"] - a[-1]["n"] in (step, 2 * step) and other == step:
                options.append((abs(b[0]["pos"] - a[-1]["pos"]), j))
        if options:
            follows[i] = min(options)[1]
            used.add(follows[i])
    out = []
    for i in range(len(parts)):
        if i not in used:
            whole, k = list(parts[i]), i
            while k in follows:
                k = follows[k]
                whole += parts[k]
            out.append(whole)
    return out


def segments(run: list[dict], least: int = C.MIN_RUN) -> Iterator[tuple[list[dict], int]]:
    """A run cut where more than one number is missing, or more than a tenth of the span so far (one at least), or the step
    changes; numbers that repeat go. Pieces of `least` items and their step."""
    diffs = [b["n"] - a["n"] for a, b in zip(run, run[1:], strict=False) if b["n"] > a["n"]]
    step = 2 if diffs and sum(d in (2, 4) for d in diffs) >= 0.7 * len(diffs) else 1
    pieces, missing = [[run[0]]], 0
    for x in run[1:]:
        piece = pieces[-1]
        d = x["n"] - piece[-1]["n"]
        if d == 0:
            continue
        gaps = d // step - 1
        if d > 0 and d % step == 0 and gaps <= 1 and missing + gaps <= max(1, math.ceil((len(piece) + missing + gaps) / 10)):
            piece.append(x)
            missing += gaps
        else:
            pieces.append([x])
            missing = 0
    for p in pieces:
        if len(p) >= least:
            yield p, step


def census(labels: DataFrame, least: int = C.MIN_RUN) -> DataFrame:
    """RUNS of labels(book_id, family, n, page, ord, left, covered): a book's labels of one family are a group."""
    names = [x.split()[0] for x in RUNS.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame | None:
        items = [r | {"pos": r["page"] * 100_000 + r["ord"]} for r in g.to_dict("records")]
        out = []
        for whole in stitched(fragments(items)):
            for p, step in segments(whole, least):
                span = (p[-1]["n"] - p[0]["n"]) // step + 1
                out.append((items[0]["book_id"], items[0]["family"], len(out), p[0]["n"], p[-1]["n"], len(p), step, span - len(p), p[0]["page"], p[-1]["page"], sum(bool(x["covered"]) for x in p) / len(p)))
        return pd.DataFrame(out, columns=names, dtype=object) if out else None

    return by_runs(labels.filter("n IS NOT NULL"), ["book_id", "family"], ["page", "ord"], run, RUNS)


def verdicts(runs: DataFrame) -> DataFrame:
    """runs with verdict: years, contents, short-items or run."""
    years = (F.col("first_n") >= 1800) & (F.col("last_n") <= 2100)
    contents = (F.col("first_page") == F.col("last_page")) & (F.col("coverage") == 0) & (F.col("n_items") >= 15) & (F.col("step") == 1) & (F.col("first_n") == 1) & (F.col("family") == "bare")
    return runs.withColumn("verdict", F.when(years, "years").when(contents, "contents").when(F.col("n_items") < C.MIN_RUN, "short-items").otherwise("run"))


def uncovered(runs: DataFrame) -> DataFrame:
    """Runs of which less than 0.8 is framed: of five items, or of eight where the book has three covered runs."""
    judged = verdicts(runs).filter("verdict = 'run'")
    covered = judged.groupBy(F.col("book_id").alias("_b")).agg(F.count_if(F.col("coverage") >= 0.8).alias("_n"))
    j = judged.join(covered, F.col("book_id") == F.col("_b")).drop("_b")
    least = F.when(F.col("_n") >= 3, C.MIN_RUN_COVERED).otherwise(C.MIN_RUN)
    return j.filter((F.col("coverage") < 0.8) & (F.col("n_items") >= least)).drop("_n").withColumn("code", F.lit("numbered-run-uncovered"))


def select_sequence(rows: list[dict], max_jump: int = 3, tolerance: float = 0.02) -> list[dict]:
    """The items of a section among candidates(n, suffix, page, top, left): aligned, each label once, chained without long jumps.

    Lefts are clustered by their first value; candidates a little to the right of a well-filled cluster go. Of a label that
    repeats the one nearest to its neighbours' pages stays. Chains break at jumps over max_jump; the longest stays, and every
    one of two and more.
    """
    if not rows:
        return []
    lefts: list[list[float]] = []
    for x in sorted(r["left"] for r in rows):
        if lefts and x - lefts[-1][0] <= tolerance:
            lefts[-1].append(x)
        else:
            lefts.append([x])
    strong = [c[0] for c in lefts if len(c) >= max(3, 0.08 * len(rows)) or len(rows) <= 3]
    kept = [r for r in rows if not any(0.012 < r["left"] - s <= 0.09 for s in strong)]
    by_label: dict[tuple, list[dict]] = {}
    for r in kept:
        by_label.setdefault((r["n"], r["suffix"]), []).append(r)
    sure = {k[0]: v[0]["page"] for k, v in by_label.items() if len(v) == 1}

    def distance(r: dict) -> int:
        near = [abs(sure[m] - r["page"]) for m in range(r["n"] - 2, r["n"] + 3) if m in sure and m != r["n"]]
        return min(near, default=0)

    one = [min(v, key=lambda r: (distance(r), r["page"], r["top"])) for v in by_label.values()]
    one.sort(key=lambda r: (r["n"], r["suffix"]))
    chains: list[list[dict]] = []
    for r in one:
        if chains and r["n"] - chains[-1][-1]["n"] <= max_jump:
            chains[-1].append(r)
        else:
            chains.append([r])
    longest = max(chains, key=len)
    return [r for c in chains if c is longest or len(c) >= 2 for r in c]


def kept_dividers(heights: list[float], top: float = 0.0, bottom: float = 1.0, least: float = 0.01) -> list[float]:
    """Heights from the top, each at least that far below the one kept before, the top and above the bottom."""
    out: list[float] = []
    for h in sorted(min(max(h, top), bottom) for h in heights):
        if h - (out[-1] if out else top) >= least:
            out.append(h)
    while out and bottom - out[-1] < least:
        out.pop()
    return out
