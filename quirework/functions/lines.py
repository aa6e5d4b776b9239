"""What a line of text is: keys, classes and patterns, as one cascade of native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework import constants as C
from quirework.functions.labels import item_start

#: Everyday imperatives that open an instruction, chosen for this library.
VERBS = "find|solve|evaluate|simplify|determine|compute|calculate|show|prove|verify|explain|describe|sketch|graph|write|use|factor|expand|differentiate|integrate|estimate|express|give|state|list|identify|complete|decide|consider|let"
INSTRUCTION = rf"^(?i:(?:in (?:exercises|problems|questions) \d)|(?:for (?:each|all|every one) of the following\b)|(?:the following (?:exercises|problems|questions)\b)|(?:(?:{VERBS})\b.*[.:]$))"
CAPTION = r"^(?i:figure|fig\.|table|abbildung|abb\.|tabelle|figura|tableau)\s*\d"
EQUATION_TAG = r"^\(\d{1,3}(?:\.\d{1,3})?\)$"
HEADING = r"^(?i:chapter|section|part|appendix|kapitel|abschnitt|teil|chapitre|capítulo)\s+(?:\d+|[ivxlc]+)\b"


def header_key(line: Column) -> Column:
    """Lower case, runs of digits as #, white space squeezed: equal for the running lines of different pages."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "#"), r"[ \t\n\x0B\f\r]+", " "))


def in_band(rect: Column) -> Column:
    """In the band at the top or bottom of a page where headers and footers stand."""
    return (rect["bottom"] <= C.BAND_TOP) | (rect["top"] >= C.BAND_BOTTOM)


def is_instruction(line: Column) -> Column:
    return line.rlike(INSTRUCTION)


def is_page_reference(line: Column) -> Column:
    """A contents line: leader dots and a number, a list of pages, or a bare number."""
    return line.rlike(r"(?:\.\s?){3,}\s*\d+$|,\s*\d{1,4}(?:\s*[-–]\s*\d{1,4})?$|^\d{1,4}$")


def is_printed_head(line: Column) -> Column:
    """At least four fifths capitals among its letters, with a page number at one end."""
    letters, capitals = F.regexp_count(line, F.lit(r"[A-Za-z]")), F.regexp_count(line, F.lit("[A-Z]"))
    return (letters >= 3) & (capitals * 5 >= letters * 4) & line.rlike(r"^\d+\s|\s\d+$")


def line_class(line: Column) -> Column:
    """furniture, symbol, heading, item, instruction, caption or text: the first that fits."""
    t = F.trim(line)
    return (
        F.when(is_printed_head(t) | t.rlike(r"^\d{1,4}$"), "furniture")
        .when(t.rlike(EQUATION_TAG) | ~t.rlike(r"[A-Za-z0-9À-ɏ]"), "symbol")
        .when(t.rlike(HEADING), "heading")
        .when(item_start(t).isNotNull(), "item")
        .when(t.rlike(CAPTION), "caption")
        .when(is_instruction(t), "instruction")
        .otherwise("text")
    )


def start_style(line: Column) -> Column:
    """How a line starts an item, with its first confidence: (style, label, confidence), null for other lines."""
    styles = [
        ("keyword", r"^(?i:exercises?|problems?|questions?|aufgaben?|exercices?|ejercicios?)\s+(\d+[a-z]?)", 0.9),
        ("number-dot", r"^(\d{1,4})\.(?=\s|$)", 0.55),
        ("number-paren", r"^(\d{1,4})\)(?=\s|$)", 0.5),
        ("paren-number", r"^\((\d{1,4})\)(?=\s|$)", 0.4),
        ("section", r"^§\s*(\d+)", 0.3),
        ("heading-number", r"^(\d{1,3}(?:\.\d{1,3})+)\s+\p{Lu}", 0.25),
    ]
    out = None
    for name, pattern, confidence in styles:
        label = F.regexp_extract(line, pattern, 1)
        lowered = F.when(F.lit(name == "number-dot") & line.rlike(r"^\d{1,4}\.\s+\p{Ll}"), confidence - 0.05).otherwise(confidence)
        hit = F.struct(F.lit(name).alias("style"), label.alias("label"), lowered.alias("confidence"))
        out = F.when(label != "", hit) if out is None else out.when(label != "", hit)
    return out


#: Census labels by family: how they are printed, and the number in group 1.
FAMILIES = {"dot": r"^(\d{1,4})\.(?!\d)", "paren": r"^(\d{1,4})\)", "both": r"^\((\d{1,4})\)", "bracket": r"^\[(\d{1,4})\]", "bare": r"^(\d{1,4})(?=\s+\p{L})"}


def census_label(line: Column) -> Column:
    """(family, n) of a line that starts with a printed number, null otherwise."""
    out = None
    for name, pattern in FAMILIES.items():
        n = F.regexp_extract(line, pattern, 1)
        hit = F.struct(F.lit(name).alias("family"), n.cast("int").alias("n"))
        out = F.when(n != "", hit) if out is None else out.when(n != "", hit)
    return out


def item_label(line: Column, pattern: str) -> Column:
    """A label by the caller's own pattern: its group 1."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def is_web_address(text: Column) -> Column:
    return text.rlike(r"^https?://[^\s/$.?#][^\s]*$")


def clean_title(text: Column) -> Column:
    """Without control characters, white space squeezed, leaders and a trailing page number gone."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(t, r"\s*(?:\.\s?){3,}\s*\d*\s*$", ""))


def title_key(text: Column) -> Column:
    """For comparison: lower case, & as and, letters and digits alone, without a chapter's prefix."""
    t = F.regexp_replace(F.lower(clean_title(text)), "&", " and ")
    t = F.regexp_replace(t, r"^(?:chapter|kapitel|section|part)\s+[0-9ivx]+[.:]?\s+", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def title_from_file(name: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(base, r"[_\-\s]+", " "))


def excerpt(text: Column, most: int = 60) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


#: Licence and author lines: (field, pattern with the value in group 1, value instead).
CREDITS = (
    ("license", r"(creativecommons\.org/licenses/[a-z\-]+/[0-9.]+)", None),
    ("license", r"\b(CC BY(?:-(?:NC|ND|SA))*(?: [0-9.]+)?)", None),
    ("license", r"((?:Apache|MIT|GNU General Public|GNU Lesser General Public|Mozilla Public) License)", None),
    ("rights", r"(?i)(all rights reserved)", "all rights reserved"),
    ("author", r"(?i)(?:copyright|\(c\)|©)\s*(?:\d{4}\s*)?(?:by\s+)?([A-Za-z][A-Za-z .]{2,40})", None),
)


def credits(line: Column) -> Column:
    """The (field, value) pairs that a line tells of licence, rights and author."""
    found = []
    for field, pattern, instead in CREDITS:
        value = F.regexp_extract(line, pattern, 1)
        found.append(F.when(value != "", F.struct(F.lit(field).alias("field"), (F.lit(instead) if instead else value).alias("value"))))
    return F.array_compact(F.array(*found))


#: How parts of an item are marked, the first letter or number in group 1; of equal runs the earlier style wins.
PART_STYLES = (("letter", r"^\(([a-z])\)"), ("roman", r"^\(([ivx]{1,5})\)"), ("number", r"^\((\d{1,2})\)"), ("letter-dot", r"^([a-z])[.)](?=\s)"), ("number-dot", r"^(\d{1,2})[.)](?=\s)"))


def part_marks(line: Column) -> Column:
    """The (style, mark) readings of a line that may begin a part: (i) is a letter and a Roman number."""
    found = []
    for name, pattern in PART_STYLES:
        mark = F.regexp_extract(line, pattern, 1)
        found.append(F.when(mark != "", F.struct(F.lit(name).alias("style"), mark.alias("mark"))))
    return F.array_compact(F.array(*found))


def part_ordinal(style: Column, mark: Column) -> Column:
    """Which part a mark claims to be: a is 1, ii is 2, 3 is 3."""
    romans = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv")
    roman = F.array_position(F.array(*[F.lit(r) for r in romans]), mark).cast("int")
    return F.when(style.startswith("letter"), F.ascii(mark) - 96).when(style == "roman", F.nullif(roman, F.lit(0))).otherwise(mark.try_cast("int"))
