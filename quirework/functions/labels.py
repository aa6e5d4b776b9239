"""Labels of numbered items: normal form, parts, order and the places where text shows them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

from quirework import constants as C

DASHES = "‐‑‒–—―−"


def normalized(label: Column) -> Column:
    """Trimmed, white space squeezed, without one closing full stop or a closing bracket that nothing opens."""
    t = F.trim(F.regexp_replace(label, r"[\s ]+", " "))
    t = F.when(t.rlike(r"[^.]\.$"), F.regexp_replace(t, r"\.$", "")).otherwise(t)
    return F.when(t.endswith(")") & ~t.contains("("), F.regexp_replace(t, r"\)$", "")).otherwise(t)


def problem(label: Column) -> Column:
    t = normalized(label)
    return F.when(label.isNull() | (F.trim(label) == ""), "label-missing").when((F.length(t) > C.MAX_LABEL) | ~t.rlike(r"[\p{L}\p{N}]"), "bad-label").when(t != label, "label-style")


@pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility form, every dash a hyphen, white space squeezed. The one text function that Spark lacks."""
    table = str.maketrans(dict.fromkeys(DASHES, "-"))
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(table).split()))


@pandas_udf(StringType())
def slugged(text: pd.Series) -> pd.Series:
    """Letters and digits of the decomposed text, marks dropped, the rest hyphens: a section's id from its title."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return "-".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in plain).split())[: C.MAX_SECTION] or None

    return text.map(one)


def numbers(label: Column) -> Column:
    """The dotted numbers of a label as an array, null where it has none; arrays compare element by element, shorter first."""
    head = F.regexp_extract(label, r"^(\d{1,9}(?:\.\d{1,9})*)", 1)
    return F.when(head != "", F.transform(F.split(head, r"\."), lambda x: x.cast("int")))


def suffix(label: Column) -> Column:
    return F.regexp_extract(label, r"^\d[\d.]*(.*)$", 1)


def order(label: Column) -> Column:
    """Sorts labels by number, then by suffix; labels without number come last, by text."""
    return F.struct(numbers(label).isNull().alias("no_number"), numbers(label).alias("numbers"), suffix(label).alias("suffix"), label.alias("label"))


def is_part_of(label: Column, whole: Column) -> Column:
    """12a is part of 12, and 3.1 of 3."""
    rest = F.substr(label, F.length(whole) + 1)
    return label.startswith(whole) & (F.length(label) > F.length(whole)) & ~rest.rlike(r"^\d")


#: Item starts: number with stop or bracket, bracketed number or letter, dotted number of three parts.
ITEM = r"^(?:(\d{1,4}[a-z]?)[.)](?!\d)|\((\d{1,4}[a-z]?|[a-z])\)|(\d+\.\d+\.\d+)(?![\d.]))"


def item_start(line: Column) -> Column:
    """The label that a line starts with as an item does, or null."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(line, ITEM, i), F.lit("")) for i in (1, 2, 3)])
    return found


def starts_with(line: Column, label: Column) -> Column:
    """Whether a line starts with a label, bare or in brackets, and nothing that would go on with it."""
    plain = F.regexp_replace(line, r"^\(", "")
    after = F.substr(plain, F.length(label) + 1, F.lit(1))
    return plain.startswith(label) & ((after == "") | ~after.rlike(r"[\p{L}\p{N}]"))


def named_numbers(text: Column, most: int = 200) -> Column:
    """The numbers that a text names: '3 and 4', '1, 3, 5', and ranges '5 - 10' of at most `most` numbers; sorted, each once."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\d{1,4})\s*(?:-|–|to|bis)\s*(\d{1,4})"), 0)
    ends = F.transform(pairs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\d+"), 0), lambda x: x.cast("int")))
    ranges = F.flatten(F.transform(F.filter(ends, lambda e: (F.get(e, F.lit(1)) >= F.get(e, F.lit(0))) & (F.get(e, F.lit(1)) - F.get(e, F.lit(0)) < most)), lambda e: F.sequence(F.get(e, F.lit(0)), F.get(e, F.lit(1)))))
    rest = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(\d{1,4})\s*(?:-|–|to|bis)\s*(\d{1,4})", " "), F.lit(r"(?<![\d.])\d{1,4}(?![\d.]*\d)"), 0), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(ranges, rest)))


ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman_value(text: str) -> int | None:
    """The number that a Roman numeral in its regular form stands for."""
    t, n = text.lower(), 0
    rest = t
    for value, sign in ROMAN:
        while rest.startswith(sign):
            n, rest = n + value, rest[len(sign) :]
    return n if t and not rest and roman(n) == t else None


def roman(n: int) -> str:
    out = ""
    for value, sign in ROMAN:
        count, n = divmod(n, value)
        out += sign * count
    return out


@pandas_udf(IntegerType())
def numeral(text: pd.Series) -> pd.Series:
    """Digits or a Roman numeral as a number."""
    return text.map(lambda t: None if not t else int(t) if t.isascii() and t.isdigit() else roman_value(t)).astype("Int32")


def successor(label: str) -> str:
    """5 -> 6, 5a -> 5b, 1.9 -> 1.10, z -> aa."""
    import re

    m = re.fullmatch(r"(.*?)(\d+)", label)
    if m:
        return f"{m[1]}{int(m[2]) + 1}"
    head, last = label[:-1], label[-1:]
    if last and last.lower() != "z" and last.isascii() and last.isalpha():
        return head + chr(ord(last) + 1)
    return head + ("aa" if last == "z" else "AA") if last in ("z", "Z") else label + "2"
