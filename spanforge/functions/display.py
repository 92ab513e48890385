"""Text for tables of fixed width and previews, as columns: one line, display width, cutting, escapes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.columns import _c


@lru_cache(maxsize=1)
def _wide() -> str:
    """A character class of what takes two places: East Asian width W or F by the Unicode tables of this Python."""
    ranges: list[list[int]] = []
    for cp in range(0x110000):
        if unicodedata.east_asian_width(chr(cp)) in "WF":
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def one_line(text) -> Column:
    """Words by one space each; white space is all that Unicode or U+001C to U+001F count. Null stays null."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?U)[\s\x1C-\x1F]+", " "), "^ | $", "")


def display_width(text) -> Column:
    """Places that a text takes on a terminal, wide characters two."""
    return F.char_length(_c(text)) + F.regexp_count(_c(text), F.lit(_wide()))


def padded(text, width: int) -> Column:
    """Spaces behind up to ``width`` places; wider texts stay as they are."""
    return F.concat(_c(text), F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - display_width(text))))


def cut(text, width: int) -> Column:
    """One line of at most ``width`` places, an ellipsis for what is cut off."""
    line = one_line(text)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.char_length(line), F.lit(max(1, width))))), lambda i: F.substring(line, i, F.lit(1)))
    # an ellipsis takes one place; the first character that does not fit ends the text
    start = F.struct(F.lit(0).alias("used"), F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(a: Column, ch: Column) -> Column:
        used = a["used"] + F.when(ch.rlike(_wide()), 2).otherwise(1)
        full = a["full"] | (used > width - 1)
        return F.struct(F.when(full, a["used"]).otherwise(used).alias("used"), F.when(full, a["out"]).otherwise(F.concat(a["out"], ch)).alias("out"), full.alias("full"))

    return F.when(display_width(line) <= width, line).when(line.isNotNull(), F.concat(F.aggregate(chars, start, step)["out"], F.lit("…")))


def clipped(text, most: int) -> Column:
    """At most ``most`` characters, an ellipsis in the last place of longer texts."""
    return F.when(F.char_length(_c(text)) <= most, _c(text)).otherwise(F.concat(F.substring(_c(text), 1, most - 1), F.lit("…")))


def escaped(text, limit: int) -> Column:
    """A text in ASCII with backslash escapes, at most ``limit`` characters; a cut one ends in three dots if the limit exceeds 3."""

    def one(ch: Column) -> Column:
        cp = F.ascii(ch)
        hexed = F.lower(F.hex(cp.cast("long")))
        return (
            F.when(ch == "\\", F.lit("\\\\")).when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r")).when(ch == "\t", F.lit("\\t")).when((cp >= 32) & (cp < 127), ch)
            .when(cp < 256, F.concat(F.lit("\\x"), F.lpad(hexed, 2, "0"))).when(cp < 65536, F.concat(F.lit("\\u"), F.lpad(hexed, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(hexed, 8, "0")))
        )

    # each character gives one or more, so limit + 1 of them decide
    n = F.when(_c(text).isNotNull(), F.least(F.char_length(_c(text)), F.lit(limit + 1)))
    whole = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: one(F.substring(_c(text), i, F.lit(1)))), "")).when(n == 0, F.lit(""))
    short = F.substring(whole, 1, limit) if limit <= 3 else F.concat(F.substring(whole, 1, limit - 3), F.lit("..."))
    return F.when(F.char_length(whole) <= limit, whole).otherwise(short)
