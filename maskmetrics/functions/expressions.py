"""Column expressions of the engine."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of blue, green and red in the integer gray conversion, over 2 ** 15.
GRAY = {"b": 3735, "g": 19235, "r": 9798}


def gray(b: Column, g: Column, r: Column) -> Column:
    """Gray level of 8-bit channels, rounded to an integer."""
    total = b.cast("int") * GRAY["b"] + g.cast("int") * GRAY["g"] + r.cast("int") * GRAY["r"]
    return F.shiftright(total + (1 << 14), 15)


def finite(x: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What full case folding makes of single characters: those that stay one, and those that become several."""
    found = {c: c.casefold() for c in map(chr, range(0x110000)) if c != c.casefold()}
    return {c: f for c, f in found.items() if len(f) == 1}, {c: f for c, f in found.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """A text by full case folding, as names are compared; ``lower`` alone keeps apart what differs by more than case, such as ``ß`` and ``SS``."""
    one, several = _folds()
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several.items()])
    spread = F.when(text.rlike(f"[{''.join(several)}]"), F.aggregate(pairs, text, lambda t, p: F.replace(t, p["c"], p["f"]))).otherwise(text)
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(spread, "".join(one), "".join(one.values())))


def same_name(a: Column, b: Column) -> Column:
    """Equality of class names without regard to case."""
    return folded(a) == folded(b)


def unescaped(part: Column) -> Column:
    """A part of a file's address with its escapes undone; a plus sign is not one."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def path_parts(origin: Column) -> Column:
    """The names along a file's address, by which files are put in order."""
    return F.transform(F.split(origin, "/"), unescaped)


def file_name(origin: Column) -> Column:
    """The last name of a file's address."""
    return unescaped(F.element_at(F.split(origin, "/"), -1))


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def local_iso(ts: Column) -> Column:
    """A time stamp in the session's zone, to the second, with its offset."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ssxxx")


def compactness(area: Column, perimeter: Column) -> Column:
    """``4 pi A / P ** 2``, at most 1; null without a perimeter."""
    return F.when(perimeter > 0, F.least(F.lit(1.0), 4 * F.pi() * area / (perimeter * perimeter)))


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
