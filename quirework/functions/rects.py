"""Rectangles as structs of left, top, right, bottom in fractions of a page, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework import constants as C

RECT = "struct<left:double,top:double,right:double,bottom:double>"
SIDES = ("left", "top", "right", "bottom")


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("double").alias("left"), top.cast("double").alias("top"), right.cast("double").alias("right"), bottom.cast("double").alias("bottom"))


def round_half_up(x: Column, digits: int = C.DECIMALS) -> Column:
    """Halves go up, towards the greater number, and minus zero is zero."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f + 0.0


def width(r: Column) -> Column:
    return F.greatest(r["right"] - r["left"], F.lit(0.0))


def height(r: Column) -> Column:
    return F.greatest(r["bottom"] - r["top"], F.lit(0.0))


def area(r: Column) -> Column:
    return width(r) * height(r)


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle, or null where there is none with an area."""
    x = rect(F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"]), F.least(a["right"], b["right"]), F.least(a["bottom"], b["bottom"]))
    return F.when((x["left"] < x["right"]) & (x["top"] < x["bottom"]), x)


def bounds(a: Column, b: Column) -> Column:
    """The least rectangle that holds both."""
    return rect(F.least(a["left"], b["left"]), F.least(a["top"], b["top"]), F.greatest(a["right"], b["right"]), F.greatest(a["bottom"], b["bottom"]))


def contains(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return (b["left"] >= a["left"] - tolerance) & (b["top"] >= a["top"] - tolerance) & (b["right"] <= a["right"] + tolerance) & (b["bottom"] <= a["bottom"] + tolerance)


def equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    same = F.lit(True)
    for s in SIDES:
        same = same & (F.abs(a[s] - b[s]) <= tolerance)
    return same


def shared(a: Column, b: Column) -> Column:
    """Common area as a share of the smaller rectangle; 0 where there is none."""
    x = intersection(a, b)
    return F.coalesce(area(x) / F.least(area(a), area(b)), F.lit(0.0))


def rounded(r: Column) -> Column:
    return rect(*[round_half_up(r[s]) for s in SIDES])


def clamped(r: Column) -> Column:
    return rect(*[F.least(F.greatest(r[s], F.lit(0.0)), F.lit(1.0)) for s in SIDES])


def shifted(r: Column, dx: Column, dy: Column) -> Column:
    """Moved, but no farther than the page's edges."""
    x = F.least(F.greatest(dx, -r["left"]), 1 - r["right"])
    y = F.least(F.greatest(dy, -r["top"]), 1 - r["bottom"])
    return rect(r["left"] + x, r["top"] + y, r["right"] + x, r["bottom"] + y)


def enlarged(r: Column, least_width: float = C.LEAST_WIDTH, least_height: float = C.LEAST_HEIGHT) -> Column:
    """Grown about its middle to the least size, then moved back onto the page."""
    dx, dy = F.greatest(F.lit(least_width) - (r["right"] - r["left"]), F.lit(0.0)) / 2, F.greatest(F.lit(least_height) - (r["bottom"] - r["top"]), F.lit(0.0)) / 2
    g = rect(r["left"] - dx, r["top"] - dy, r["right"] + dx, r["bottom"] + dy)
    return shifted(g, F.when(g["left"] < 0, -g["left"]).when(g["right"] > 1, 1 - g["right"]).otherwise(F.lit(0.0)), F.when(g["top"] < 0, -g["top"]).when(g["bottom"] > 1, 1 - g["bottom"]).otherwise(F.lit(0.0)))


def problem(r: Column) -> Column:
    """rect-inverted, rect-off-page, rect-too-small or, within the clamp, rect-clamped; null for a sound one."""
    far = F.lit(False)
    near = F.lit(False)
    for s in SIDES:
        far = far | (r[s] < -C.CLAMP) | (r[s] > 1 + C.CLAMP)
        near = near | (r[s] < 0) | (r[s] > 1)
    return (
        F.when(r["left"].isNull() | r["top"].isNull() | r["right"].isNull() | r["bottom"].isNull(), "bad-rect")
        .when((r["left"] >= r["right"]) | (r["top"] >= r["bottom"]), "rect-inverted")
        .when(far, "rect-off-page")
        .when((width(r) < C.LEAST_WIDTH) | (height(r) < C.LEAST_HEIGHT), "rect-too-small")
        .when(near, "rect-clamped")
    )


def parsed(text: Column) -> Column:
    """A rectangle from 'l,t,r,b', '[l,t,r,b]' or an object of four sides; null otherwise."""
    inner = F.split(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), r"\s*,\s*")
    listed = F.transform(inner, lambda x: x.try_cast("double"))
    from_list = F.when((F.size(listed) == 4) & ~F.exists(listed, lambda x: x.isNull()), rect(*[F.get(listed, F.lit(i)) for i in range(4)]))
    from_object = F.from_json(text, RECT)
    return F.when(F.trim(text).startswith("{"), F.when(from_object["bottom"].isNotNull(), from_object)).otherwise(from_list)


def formatted(r: Column) -> Column:
    return F.concat_ws(",", *[round_half_up(r[s]).cast("string") for s in SIDES])
